"""Market operators on small tables: hand-made edges, loop equivalence, invariance, plans."""

import random

import pytest
from pyspark.sql import functions as F

from candlewick.functions import exprs
from candlewick.operators import calibration, checks, execution, features, metrics, monitor, regimes, resample, search, signals
from candlewick.plans import all_queries, all_sql
from candlewick.sources import bars as B
from candlewick.sources.store import FeatureStore, VersionedStore

BAR = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double"


def make(spark, closes, symbol="A", opens=None):
    import datetime as d

    closes = [float(c) for c in closes]
    rows = [(symbol, "daily", d.datetime(2020, 1, 1) + d.timedelta(days=i), float((opens or closes)[i]), c + 1, c - 1, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def loop(opens, entry, exit_, cost=0.0006):
    """The plain state machine with fills at the next open."""
    equity, pos, price, trades, curve, n = 1000.0, 0, None, 0, [], len(opens)
    for i in range(n):
        if not pos and entry[i] and i < n - 1:
            pos, price = 1, opens[i + 1] * (1 + cost)
        elif pos and exit_[i]:
            out = (opens[i + 1] if i < n - 1 else opens[i]) * (1 - cost)
            equity, pos, trades = equity * out / price, 0, trades + 1
        curve.append(equity * opens[i] / price if pos and i < n - 1 else equity)
    if pos:
        equity, trades = equity * opens[-1] * (1 - cost) / price, trades + 1
        curve[-1] = equity
    return trades, curve


def test_positions_equal_the_loop(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(30):
        n = rng.randint(1, 60)
        opens = [rng.uniform(50, 150) for _ in range(n)]
        e, x = ([rng.random() < p for _ in range(n)] for p in (0.3, 0.3))
        want[str(s)] = loop(opens, e, x)
        rows += [(str(s), i, opens[i], e[i], x[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, i long, open double, entry boolean, exit boolean").withColumn("ts", F.timestamp_seconds("i"))
    filled = signals.fills(signals.positions(df, ["symbol"]), ["symbol"])
    trades = {r["symbol"]: r["count"] for r in signals.trades(filled, ["symbol"]).groupBy("symbol").count().collect()}
    curve = signals.equity(filled, ["symbol"]).orderBy("symbol", "ts").collect()
    for s, (n, eq) in want.items():
        assert trades.get(s, 0) == n
        assert [r["equity"] for r in curve if r["symbol"] == s] == pytest.approx(eq)


def test_rsi_edges(spark):
    up = features.Pipeline("p", [features.rsi(3)]).compute(make(spark, [1.0, 2, 3, 4])).orderBy("ts").collect()
    assert [r["rsi_3"] for r in up] == [None, None, 100.0, 100.0]
    flat = features.Pipeline("p", [features.rsi(3), features.bollinger(3)]).compute(make(spark, [5.0] * 4)).orderBy("ts").collect()
    assert flat[-1]["rsi_3"] is None and flat[-1]["bb_position_3"] is None
    own = signals.expanding_rsi(make(spark, [1.0, 2, 3]), 3, "r", ["symbol"]).orderBy("ts").collect()
    assert [r["r"] for r in own] == [0.0, 0.0, 0.0]


def test_missing_column_gives_null_feature(spark):
    x = features.Pipeline("p", [features.volume_ma(2), features.returns(1)]).compute(make(spark, [1.0, 2]).drop("volume"))
    assert [r["volume_ma_2"] for r in x.collect()] == [None, None]
    p = features.Pipeline("p", [features.rsi(3)])
    assert p.config()["version"] == features.Pipeline("p", [features.rsi(3)]).config()["version"] and p.catalog(spark).count() == 1
    with pytest.raises(ValueError, match="volume"):
        B.require_columns(make(spark, [1.0]).drop("volume"), "volume")


def test_one_sort_for_all_features(spark):
    p = features.Pipeline("s", [features.returns(1), features.returns(5), features.volume_ma(20), features.true_range()])
    plan = p.compute(make(spark, [1.0, 2]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_same_result_for_any_partitioning(spark):
    b = make(spark, [float(x) for x in random.Random(1).sample(range(50, 150), 60)])
    p = features.Pipeline("s", [features.rsi(14), features.adx(5)])
    one = p.compute(b.coalesce(1)).orderBy("ts").collect()
    assert p.compute(b.repartition(7)).orderBy("ts").collect() == one


def test_cycle_and_empty_cycle(spark):
    x = spark.range(6).select(signals.cycle(F.col("id"), F.lit(2), F.lit(1), F.lit(4)).alias("a"), signals.cycle(F.col("id"), F.lit(0), F.lit(0), F.lit(0)).alias("b")).collect()
    assert [r["a"] for r in x] == [False, True, True, False, True, True] and all(r["b"] for r in x)


def test_checks_and_empty_symbol(spark):
    bad = make(spark, [1.0, -2.0, 9.0]).unionByName(make(spark, [1.0]))
    uni = spark.createDataFrame([("A", "daily"), ("Z", "daily")], "symbol string, tf string")
    r = {(x["symbol"], x["check_name"]): x["passed"] for x in checks.suite(bad, uni).collect()}
    assert r["Z", "not_empty"] is False and r["A", "positive_prices_close"] is False and r["A", "no_duplicate_timestamps"] is False and r["A", "not_empty"]
    s = {x["symbol"]: x["has_critical"] for x in checks.summary(checks.suite(bad, uni)).collect()}
    assert s == {"A": True, "Z": True}


def test_split_and_dividend(spark):
    b = make(spark, [10.0, 20.0, 30.0])
    sp = spark.createDataFrame([("A", "2020-01-02", 2.0)], "symbol string, date string, ratio double").withColumn("date", F.to_date("date"))
    assert [r["close"] for r in checks.adjust_splits(b, sp).orderBy("ts").collect()] == [5.0, 20.0, 30.0]
    dv = spark.createDataFrame([("A", "2020-01-02", 5.0), ("A", "2021-01-01", 1.0)], "symbol string, ex_date string, amount double").withColumn("ex_date", F.to_date("ex_date"))
    assert [r["close"] for r in checks.adjust_dividends(b, dv).orderBy("ts").collect()] == [7.5, 20.0, 30.0]


def test_next_bar_takes_the_first_at_or_after(spark):
    b = make(spark, [1.0, 2, 3])
    o = spark.createDataFrame([("A", "2020-01-01 00:00:00", 1), ("A", "2020-01-01 05:00:00", 2), ("A", "2021-01-01 00:00:00", 3)], "symbol string, t string, parent_id long").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    assert {r["parent_id"]: r["bar"]["close"] for r in execution.next_bar(o, b).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}


def test_average_cost_flips(spark):
    f = spark.createDataFrame([("P", "A", 1, 10.0, 5.0), ("P", "A", 2, -15.0, 7.0), ("P", "A", 3, 5.0, 6.0)], "portfolio string, symbol string, k long, qty double, price double").withColumn("ts", F.timestamp_seconds("k")).drop("k")
    r = execution.average_cost(f).first()
    assert (r["qty"], r["avg_price"], r["realized"]) == (0.0, 0.0, 25.0)


def test_draws_and_bootstrap_repeat(spark):
    base = resample.numbered(spark.createDataFrame([("A", i, float(i % 7 - 3)) for i in range(40)], "symbol string, i long, v double"), "v", "i")
    a, b = (sorted(map(tuple, resample.stationary_bootstrap(base.repartition(k), 5).collect())) for k in (1, 3))
    assert a == b and len(a) == 200
    shuffled = resample.permutation(base, 3).groupBy("sim").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()
    assert all(r["x"] == sorted(float(i % 7 - 3) for i in range(40)) for r in shuffled)


def test_shape_matches_pandas(spark):
    import pandas as pd

    x = [float(2**i) for i in range(10)]
    base = resample.numbered(spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "symbol string, i long, v double"), "v", "i")
    r = resample.shape(base).first()
    assert (r["skew"], r["kurt"]) == pytest.approx((pd.Series(x).skew(), pd.Series(x).kurt())) and r["z_skew"] > 1.96 and r["z_kurt"] > 1


def test_window_scores_equal_direct(spark):
    rng = random.Random(2)
    rows = [("A", 0, i, rng.gauss(0, 0.01)) for i in range(50)]
    ret = spark.createDataFrame(rows, "symbol string, param_id long, i long, ret double")
    w = spark.createDataFrame([("A", 0, 0, 20, 20, 35), ("A", 1, 10, 30, 30, 50)], "symbol string, window_id int, train_from long, train_to long, test_from long, test_to long")
    import statistics as st

    for r in search.window_scores(ret, w).collect():
        a, b = (0, 20) if r["window_id"] == 0 else (10, 30)
        x = [v[3] for v in rows[a:b]]
        assert r["train_score"] == pytest.approx(st.mean(x) / st.stdev(x) * 252**0.5)


def test_regime_ties_and_no_points(spark):
    x = regimes.labels(spark.createDataFrame([(0.2,) * 5, (0.0, 0.5, 0.5, 0.0, 0.0)], ", ".join(f"p_{k} double" for k in regimes.REGIMES)))
    got = [(r["regime"], round(r["confidence"], 6)) for r in x.collect()]
    assert got[0] == ("bull", 0.0) and got[1][0] == "bear"


def test_pbr_scenarios(spark):
    rows = [("overfit", 3.0, 25, 8.0, 50, 0.15, 0.60, None, None, None), ("robust", 1.5, 150, 4.0, 5, 0.65, 0.75, 0.85, None, None), ("regime", 1.8, 100, 5.0, 10, 0.55, 0.70, 0.80, "high_volatility", 1.07)]
    df = spark.createDataFrame(rows, "k string, sharpe double, trades long, params double, models long, wf double, stay double, confidence double, regime string, dispersion double")
    p = {r["k"]: r["pbr"] for r in regimes.pbr(df).collect()}
    assert p["robust"] > p["regime"] > p["overfit"]


def test_alerts_and_prometheus(spark):
    m = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "name string, value double")
    rules = spark.createDataFrame([("a", 3.0, "==", "w")], "name string, threshold double, comparison string, severity string")
    assert [r["message"] for r in monitor.alerts(m, rules).collect()] == ["a == 3.0"]
    x = spark.createDataFrame([("a", {"k": "v"}, 1.5), ("b", {}, 2.0)], "name string, tags map<string,string>, value double")
    assert {r["value"] for r in monitor.prometheus(x).collect()} == {'a{k="v"} 1.5', "b 2.0"}


def test_store_round_trip(spark, tmp_path):
    s = VersionedStore(spark, str(tmp_path))
    b = make(spark, [1.0, 2.0, 3.0])
    v1, v2 = s.write(b.limit(1)), s.write(b)
    assert v1 != v2 and s.versions("raw").count() == 2 and s.read().count() == 3 and s.read(version=v1).count() == 1
    assert all(r["intact"] for r in s.integrity().collect())
    fs = FeatureStore(s)
    fs.register(features.Pipeline("r", [features.returns(1)]))
    fs.compute_and_store(b, "r")
    assert fs.get("r", start="2020-01-02").count() == 2


def test_calibration_measures(spark):
    x = spark.createDataFrame([(0.05, 0), (1.0, 1), (0.95, 1)], "p double, y int")
    r = calibration.reliability(x).orderBy("bin").collect()
    assert [c["bin"] for c in r] == [0, 9] and r[0]["brier"] == pytest.approx((0.0025 + 0.0025) / 3)


def test_normal_cdf(spark):
    r = spark.range(1).select(exprs.norm_cdf(F.lit(1.96)).alias("a"), exprs.norm_cdf(F.lit(0.0)).alias("b")).first()
    assert r["a"] == pytest.approx(0.9750021, abs=1e-6) and r["b"] == pytest.approx(0.5, abs=1e-6)


def test_metrics_of_a_flat_curve(spark):
    e = make(spark, [1000.0] * 5).select("symbol", "ts", F.col("close").alias("equity"))
    r = metrics.equity_metrics(e, ["symbol"]).first()
    assert (r["gain_pct"], r["sortino"], r["max_drawdown_pct"], r["profit_factor"]) == (0.0, 0.0, 0.0, 1.0)


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
