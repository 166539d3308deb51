"""Work that grows with the input: bounded tasks, one reading of shared rows, results by plain loops."""

import datetime as d
import random

import pytest
from candlewick.operators import calibration, execution, monitor, regimes
from candlewick.plans import desk_queries, job_queries
from candlewick.streaming import jobs, live
from pyspark.sql import functions as F

START = d.datetime(2024, 1, 1)


def test_exposure_equals_a_loop_without_a_join(spark, tmp_path):
    """Over three triggers; a join would meet every fill with all prices of its range."""
    rng = random.Random(4)
    at = lambda m: START + d.timedelta(minutes=m)
    fills = [(i, f"P{rng.randrange(3)}", rng.choice("AB"), at(rng.randrange(4000)), float(rng.choice([-20, 10, 30])), float(rng.randint(50, 90))) for i in range(600)]
    prices = [(s, at(60 * h), float(rng.randint(50, 90))) for s in "AB" for h in range(70) if rng.random() < 0.4]
    fs, ps = "event_id long, portfolio string, symbol string, ts timestamp, qty double, price double", "symbol string, ts timestamp, price double"
    for low, high in ((0, 1500), (1500, 2600), (2600, 9999)):
        in_part = lambda t, low=low, high=high: at(low) <= t < at(high)
        spark.createDataFrame([f for f in fills if in_part(f[3])], fs).write.mode("append").parquet(f"{tmp_path}/fills")
        spark.createDataFrame([p for p in prices if in_part(p[1])], ps).write.mode("append").parquet(f"{tmp_path}/prices")
        stream = live.stream_exposure(spark.readStream.schema(fs).parquet(f"{tmp_path}/fills"), spark.readStream.schema(ps).parquet(f"{tmp_path}/prices"), "2 hours", limits={"gross": 9000.0})
        out = jobs.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/state", jobs.ROCKS)
    assert "Join" not in stream._jdf.queryExecution().analyzed().toString()
    held, cash, peak, dead, want = {}, {}, {}, {}, {}
    for i, p, s, t, qty, price in sorted(fills, key=lambda f: (f[3], f[0])):
        near = [(u, x) for z, u, x in prices if z == s and t - d.timedelta(hours=2) < u <= t]
        mine = held.setdefault(p, {})
        mine[s] = (mine.get(s, (0.0, 0.0))[0] + qty, max(near)[1] if near else price)
        cash[p] = cash.get(p, 100_000.0) - qty * price
        worth = [q * m for q, m in mine.values()]
        value = cash[p] + sum(worth)
        peak[p] = max(peak.get(p, 100_000.0), value)
        gross, fall = sum(map(abs, worth)), (value - peak[p]) / peak[p]
        level = live.LEVELS[int(live.risk_level(gross, sum(worth), gross / value, max(map(abs, worth)), fall, live.LIMITS | {"gross": 9000.0}))]
        dead[p] = dead.get(p, False) or level == "red"
        want[i] = (p, t, gross, sum(worth), value, fall, level, dead[p])
    last = min(max(f[3] for f in fills), max(p[1] for p in prices)) - d.timedelta(minutes=130)
    got = {r["event_id"]: (r["portfolio"], r["ts"], r["gross"], r["net"], r["value"], pytest.approx(r["drawdown"]), r["level"], r["killed"]) for r in out.collect()}
    assert got == {i: w for i, w in want.items() if w[1] < last} and {w[6] for w in want.values()} >= {"green", "red"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unknown_sizes(spark):
    """As with large tables: nothing is sent to all tasks because it looks small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_histograms_do_not_gather_a_key(spark, unknown_sizes):
    x = spark.range(100).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("value"))
    h = monitor.histogram(x, x.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), ["key"], 10)
    assert "SortMergeJoin" not in plan(h) and sorted(r["n"] for r in h.collect()) == [10] * 10


def test_rows_of_the_predictor_are_worked_out_once(spark, monkeypatch):
    """Five calibrations read what was cut, not the line items."""
    seen, whole = [], calibration.isotonic
    monkeypatch.setattr(calibration, "isotonic", lambda x, *a: seen.append(plan(x)) or whole(x, *a))
    got = job_queries.r18_isotonic(spark, "/root/testdata/sf0.001").collect()
    assert (bool(got), all("parquet" not in p.lower() for p in seen)) == (bool(seen), True)
    frame = job_queries.predictor_rows(spark, "/root/testdata/sf0.01")
    assert "parquet" not in plan(frame).lower() and frame.count() == calibration.training_frame(regimes.detect(job_queries.series(spark, "/root/testdata/sf0.01"))).count()


def test_risk_is_given_back_in_parts(spark, tmp_path, monkeypatch):
    """Parts of seven rows: the state goes from part to part and from trigger to trigger."""
    monkeypatch.setattr(jobs, "PART", 7)
    rng = random.Random(6)
    rows = [(i, f"P{i % 2}", START + d.timedelta(seconds=rng.randrange(500)), float(rng.randint(-3000, 2900))) for i in range(120)]
    rng.shuffle(rows)
    schema = "event_id long, portfolio string, ts timestamp, change double"
    for part in ([r for r in rows if r[2] < START + d.timedelta(seconds=250)], [r for r in rows if r[2] >= START + d.timedelta(seconds=250)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.run_once(jobs.stream_risk(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    want, state = {}, {}
    for i, p, t, change in sorted(rows, key=lambda r: (r[2], r[0])):
        now, peak, dead = state.get(p, (100_000.0, 100_000.0, False))
        now, peak = now + change, max(peak, now + change)
        state[p] = (now, peak, dead or now / peak - 1 < -0.1)
        want[i] = (p, t, *state[p])
    assert {r["event_id"]: (r["portfolio"], r["ts"], r["equity"], r["peak"], r["killed"]) for r in out.collect()} == want


def test_average_cost_sorts_days_and_not_histories(spark):
    rng = random.Random(9)
    fills = [("P", s, START + d.timedelta(hours=7 * i), float(rng.choice([-30, -10, 10, 20])), float(rng.randint(5, 50))) for s in ("A", None) for i in range(90)]
    x = execution.average_cost(spark.createDataFrame(fills, "portfolio string, symbol string, ts timestamp, qty double, price double"))
    sorts = [line for line in plan(x).splitlines() if " Sort [" in line and "qty#" in line]
    assert sorts and all("_day#" in line for line in sorts)
    got = {r["symbol"]: r for r in x.collect()}
    for s in ("A", None):
        q = avg = real = 0.0
        for _, _, _, f, px in (x for x in fills if x[1] == s):
            if q * f >= 0:
                avg = (avg * q + px * f) / (q + f)
            else:
                real += min(abs(f), abs(q)) * (px - avg) * (1 if q > 0 else -1)
                avg = px if abs(f) > abs(q) else avg
            q += f
        assert (got[s]["qty"], got[s]["avg_price"], got[s]["realized"]) == pytest.approx((q, avg if q else 0.0, real), rel=1e-9)


def test_orders_are_not_gathered_by_symbol(spark, unknown_sizes):
    assert "SortMergeJoin" not in plan(desk_queries.parents(spark, "/root/testdata/sf0.001"))
