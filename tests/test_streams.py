"""Streams with several state variables: restarts, open bars, order of arrival, replayed batches."""

import datetime as d
import os
import random

import pytest
from candlewick.operators import monitor, signals
from candlewick.streaming import jobs, live
from pyspark.sql import functions as F

BARS = "symbol string, tf string, ts timestamp, close double, seq long"
TFS = ("5min", "hourly")
PARAMS = [(0, "5min", 3, 2, 45.0, 60.0, 5, 2, 1), (0, "hourly", 2, 1, 60.0, 70.0, 4, 1, 0), (1, "5min", 5, 1, 50.0, 55.0, 0, 0, 0), (1, "hourly", 3, 2, 65.0, 80.0, 9, 1, 2)]


def bars_of(seed=1, n=150):
    rng = random.Random(seed)
    start, rows = d.datetime(2024, 1, 1), []
    for s in ("A", "B"):
        for tf, minutes in (("5min", 5), ("hourly", 60)):
            for i in range(n if tf == "5min" else n // 12 + 1):
                if rng.random() < 0.9:
                    rows.append((s, tf, start + d.timedelta(minutes=minutes * i), round(rng.uniform(90, 110), 2), 1))
    return rows


def params(spark):
    return spark.createDataFrame(PARAMS, "param_id long, tf string, mn1 int, mn2 int, entry double, exit double, on int, off int, start int")


def loop(rows, water):
    """The plain machine: closed bars one by one, by the times at which they close."""
    out = set()
    for symbol in ("A", "B"):
        for p in (0, 1):
            rule = {r[1]: r for r in PARAMS if r[0] == p}
            series = {tf: {"closes": [], "rsi": [], "signal": None} for tf in TFS}
            ends = sorted({(ts + d.timedelta(minutes=5 if tf == "5min" else 60)) for s, tf, ts, _, _ in rows if s == symbol})
            pos = 0
            for end in ends:
                if end >= water:
                    break
                for tf in TFS:
                    for s, t, ts, close, _ in rows:
                        if s == symbol and t == tf and ts + d.timedelta(minutes=5 if tf == "5min" else 60) == end:
                            x, (_, _, mn1, mn2, entry, exit_, on, off, first) = series[tf], rule[tf]
                            x["closes"].append(close)
                            moves = [b - a for a, b in zip(x["closes"][:1] + x["closes"], x["closes"], strict=False)][-mn1:]
                            gain, lose = sum(m for m in moves if m > 0), -sum(m for m in moves if m < 0)
                            x["rsi"].append(100 - 100 / (1 + gain / lose) if lose > 0 else 0.0)
                            smooth = sum(x["rsi"][-mn2:]) / len(x["rsi"][-mn2:])
                            i = len(x["closes"]) - 1
                            turn = on + off == 0 or (i - first) % (on + off) < on
                            x["signal"] = (smooth < entry and turn, smooth > exit_ or not turn)
                if all(len(series[tf]["closes"]) >= 2 for tf in TFS):
                    enter, leave = all(series[tf]["signal"][0] for tf in TFS), any(series[tf]["signal"][1] for tf in TFS)
                    pos = (1 if enter else 0) if not pos else (0 if leave else 1)
                    out.add((symbol, p, end, enter, leave, pos))
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_live_signals_restart_from_their_state(spark, tmp_path, parts):
    rows = bars_of()
    water = max(r[2] for r in rows)
    # Bars are sent when they open, with another close, and again when they are known.
    sent = sorted([(s, tf, ts, c + 1, 0) for s, tf, ts, c, _ in rows] + rows, key=lambda r: r[2])
    cuts = [sent[0][2] + (water - sent[0][2]) * k / parts for k in range(1, parts)]
    bounds = [d.datetime(1999, 1, 1), *cuts, d.datetime(2999, 1, 1)]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = [r for r in sent if low <= r[2] < high]
        random.Random(parts).shuffle(part)
        spark.createDataFrame(part, BARS).repartition(3).write.mode("append").parquet(f"{tmp_path}/bars")
        stream = spark.readStream.schema(BARS).parquet(f"{tmp_path}/bars")
        out = jobs.run_once(live.multi_timeframe_signals(stream, params(spark), TFS), f"{tmp_path}/out", f"{tmp_path}/state", jobs.ROCKS)
    got = {(r["symbol"], r["param_id"], r["ts"], r["enter"], r["leave"], r["pos"]) for r in out.collect()}
    want = loop(rows, water)
    assert got == want and len({p for *_, p in want}) == 2
    batch = signals.live_positions(spark.createDataFrame(rows, BARS), params(spark), sorted({(r[2], r[3]) for r in PARAMS}), TFS, F.lit(water))
    assert {(r["symbol"], r["param_id"], r["ts"], r["enter"], r["leave"], r["pos"]) for r in batch.collect()} == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_exposure_by_hand(spark, tmp_path):
    at = lambda m: d.datetime(2024, 1, 1) + d.timedelta(minutes=m)
    fills = [(1, "P", "A", at(10), 10.0, 100.0), (2, "P", "B", at(20), -5.0, 200.0), (3, "P", "A", at(70), 10.0, 90.0), (4, "P", "A", at(5000), 1.0, 1.0)]
    prices = [("A", at(0), 99.0), ("A", at(60), 80.0), ("B", at(5000), 1.0), ("A", at(5000), 1.0)]
    spark.createDataFrame(fills, "event_id long, portfolio string, symbol string, ts timestamp, qty double, price double").write.parquet(f"{tmp_path}/fills")
    spark.createDataFrame(prices, "symbol string, ts timestamp, price double").write.parquet(f"{tmp_path}/prices")
    f = spark.readStream.schema("event_id long, portfolio string, symbol string, ts timestamp, qty double, price double").parquet(f"{tmp_path}/fills")
    p = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(f"{tmp_path}/prices")
    out = jobs.run_once(live.stream_exposure(f, p, "1 hours", limits={"gross": 2200.0}, start=10_000.0), f"{tmp_path}/out", f"{tmp_path}/state", jobs.ROCKS)
    got = [(r["event_id"], r["gross"], r["net"], r["value"], r["level"], r["killed"]) for r in out.orderBy("event_id").collect()]
    # 10 A at 100, marked at 99; 5 B sold at 200, no price within an hour; 10 A more at 90, all 20 marked at 80.
    assert got == [(1, 990.0, 990.0, 9990.0, "green", False), (2, 1990.0, -10.0, 9990.0, "yellow", False), (3, 2600.0, 600.0, 9700.0, "red", True)]


def test_levels_take_the_worst():
    limits = live.LIMITS
    assert [live.risk_level(*x, limits) for x in ((0, 0, 0, 0, 0), (950_000, 0, 0, 0, 0), (0, -600_000, 0, 0, 0), (0, 0, 0, 150_000, 0), (0, 0, 1.5, 0, 0), (0, 0, 0, 0, -0.2), (2e6, 0, 0, 0, 0))] == [0, 1, 2, 2, 3, 3, 3]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    rng = random.Random(3)
    ticks = [(i, d.datetime(2024, 1, 1) + d.timedelta(minutes=17 * i), "A", rng.gauss(0, 1), 1) for i in range(900)]
    df = spark.createDataFrame(ticks, "event_id long, ts timestamp, symbol string, price double, user_id long")
    df.write.parquet(f"{tmp_path}/ticks")
    past = df.filter("ts < '2024-01-04'").select(F.col("symbol").alias("key"), F.col("price").alias("value"))
    ranges = past.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    sink = jobs.drift_sink(monitor.histogram(past, ranges, ["key"], 10), str(tmp_path / "drift"))
    run = lambda: jobs.run_batches(jobs.stream_drift(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/ticks"), ranges, "2 days", "1 day", 10), sink, str(tmp_path / "state"))
    run()
    rows = sorted(map(tuple, spark.read.parquet(str(tmp_path / "drift" / "metrics")).collect()), key=repr)
    assert len(rows) > 5
    last = max((n for n in os.listdir(tmp_path / "state" / "commits") if n.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        path = tmp_path / "state" / "commits" / name
        if path.exists():
            path.unlink()
    run()  # the last batch runs once more
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "drift" / "metrics")).collect()), key=repr) == rows


def test_histograms_equal_the_divergence_of_values(spark):
    rng = random.Random(8)
    x = spark.createDataFrame([("k", s, rng.gauss(0.3 * s, 1)) for s in (0, 1) for _ in range(400)], "key string, sample int, value double")
    ranges = x.filter("sample = 0").groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    h = lambda s: monitor.histogram(x.filter(F.col("sample") == s), ranges, ["key"])
    a, b = monitor.histogram_drift(h(0), h(1), ["key"]).first()["kl"], monitor.kl_divergence(x).first()["kl"]
    assert a == pytest.approx(b)
