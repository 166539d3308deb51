"""Scores and ladders against values worked out by hand."""

import datetime as d
import math
import random

import numpy as np
import pandas as pd
import pytest
from candlewick.operators import calibration, checks, execution, features, metrics, monitor, regimes, resample, search, signals
from candlewick.sources.store import AppendTable, VersionedStore
from pyspark.sql import functions as F


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_liquidity_score(spark):
    got = values(spark, "v double, s double, m double", [(2e6, 10.0, 5e9), (50e6, 0.0, 50e9), (0.0, 200.0, 0.0)], features.liquidity_score(F.col("v"), F.col("s"), F.col("m")))
    assert [x for (x,) in got] == [8 + 36 + 10, 100.0, 0.0]


def test_drawdown_zones(spark):
    got = values(spark, "d double", [(0.0,), (-0.049,), (-0.05,), (-0.2,), (-0.3,), (-0.7,), (-1.0,)], metrics.zone(F.col("d")))
    assert [x for (x,) in got] == [1, 1, 2, 3, 4, 5, 5]


def test_probabilistic_sharpe(spark):
    rows = [
        (1, 20, 0.01, 0.02, 0.0, 0.0, 20), (2, 100, 0.01, 0.0, 0.0, 0.0, 100), (3, 100, -0.01, 0.0, 0.0, 0.0, 100), (4, 101, 0.001, 0.02, 0.0, 1.0, 101),
        (5, 400, 0.01, 0.02, 0.0, 1.0, 10), (6, 50, 1.0, 1.0, 10.0, -20.0, 50),
    ]
    m = spark.createDataFrame(rows, "k long, n long, mean double, sd double, skew double, kurt double, t long")
    got = {r["k"]: r for r in metrics.probabilistic_sharpe(m, ["k"], trades="t").collect()}
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    assert (got[1]["psr"], got[2]["psr"], got[3]["psr"]) == (0.5, 0.95, 0.05)
    assert got[4]["psr"] == pytest.approx(cdf(0.05 / math.sqrt(1 / 100)), abs=1e-6)  # a variance of (1 - 0) / 100, yearly on both sides
    assert got[5]["psr"] == pytest.approx(cdf(0.5 / math.sqrt(1 / 9)), abs=1e-6)  # ten trades: z 1.5, within 2
    assert got[6]["sharpe"] == 10.0 and got[6]["psr"] == pytest.approx(cdf(10 / (2.5 * 2.5 * math.sqrt(252 / 49))), abs=1e-6)


@pytest.mark.parametrize(("first", "second", "score"), [(-1, -1, 0.9), (2, -1, 0.8), (0.9, 0.2, 0.7), (0.5, 0.3, 0.5), (0.3, 0.5, 0.2), (0.4, 0.3, 0.3), (0.5, -0.1, 0.7), (2, 1.8, 0.4 if abs(2 - 1.8) >= 0.2 else 0.3)])
def test_overfit_ladder(spark, first, second, score):
    wave = [1.0, -1.0] * 10
    sd = math.sqrt(20 / 19)
    rows = [(1, i, first * sd + x) for i, x in enumerate(wave)] + [(1, 20 + i, second * sd + x) for i, x in enumerate(wave)]
    got = metrics.overfit(spark.createDataFrame(rows, "k long, ts long, ret double"), ["k"]).first()
    assert got["s1"] == pytest.approx(first, abs=1e-6) and got["pbo"] == score


def test_composite(spark):
    c = metrics.composite(*map(F.col, ("psr", "pbo", "turn", "dd", "t")))
    got = values(spark, "psr double, pbo double, turn double, dd double, t long", [(0.8, 0.2, 150.0, -0.1, 30), (0.8, 0.2, 300.0, -0.9, 10), (0.001, 0.9, 1000.0, -1.0, 0)], c)
    assert [x for (x,) in got] == pytest.approx([0.56 - 0.04 - 0.01, 0.56 - 0.04 - 0.025 - 0.05 - 0.15, 0.0007 - 0.18 - 0.05 - 0.05 - 0.3])


def test_display_score_and_forward_size(spark):
    got = values(spark, "c double, s double, t double, v double", [(0.5, 0.9, 0.06, 0.05), (1.0, 1.0, -0.06, 0.6), (1.0, 1.0, None, 0.2)], regimes.display_score(*map(F.col, "cstv")))
    assert [x for (x,) in got] == pytest.approx([0.5**0.3 * 0.9**0.3 * 0.8**0.2 * 0.9**0.2, 0.3**0.2 * 0.2**0.2, 0.6**0.4])
    size = regimes.forward_size(*map(F.col, "sabc"))
    got = values(spark, "s double, a string, b string, c double", [(1.5, "bear", "bull", 0.5), (0.2, "bull", "crisis", 1.0), (1.9, "crisis", "bull", 1.0)], size)
    assert [x for (x,) in got] == pytest.approx([1.5 * (1 + 0.7 * 0.5 * 0.3), 0.2 * (1 - 0.3), 2.0])


def test_volume_profile_and_pre_trade_defaults(spark):
    o = spark.createDataFrame([(1, "A", "buy", 1000.0, 0.5, 10.0, "2024-01-02 16:00:00", "2024-01-02 16:30:00")], "parent_id long, symbol string, side string, qty double, urgency double, limit_price double, a string, b string")
    o = o.withColumns({"start_ts": F.col("a").cast("timestamp"), "end_ts": F.col("b").cast("timestamp")})
    assert [r["qty"] for r in execution.vwap(o).orderBy("slice").collect()] == pytest.approx([75.0, 75.0])
    assert sum(execution.HOURLY.values()) == pytest.approx(1.0)
    rows = [("buy", 100.0, 0.0, 10.0, 1e4, 1e3), ("buy", 90.0, 0.0, 10.0, 1e4, 300.0), ("buy", 90.0, 0.0, 10.0, 1e4, 361.0)]
    got = execution.pre_trade(spark.createDataFrame(rows, "side string, qty double, position double, price double, portfolio_value double, adv double")).collect()
    assert [r["reason"] for r in got] == [None, "adv_share", None]
    assert execution.pre_trade(spark.createDataFrame([("buy", 101.0, 0.0, 10.0, 1e4, 1e4)], "side string, qty double, position double, price double, portfolio_value double, adv double")).first()["reason"] == "concentration"


def test_pine_set(spark):
    closes = [100.0 + 10 * math.sin(i / 7) + i / 10 for i in range(140)]
    bars = spark.createDataFrame([("A", "daily", i, x, x, x, x, 1.0) for i, x in enumerate(closes)], "symbol string, tf string, ts long, open double, high double, low double, close double, volume double")
    p = features.Pipeline("pine", [features.pine_set()])
    got = {r["ts"]: r for r in p.compute(bars).collect()}
    assert got[5]["pine_roc"] == 0 and got[5]["pine_ann_return"] == 0 and got[5]["pine_vol_trend"] == 0
    assert got[50]["pine_roc"] == pytest.approx(closes[50] / closes[30] - 1)
    rets = [closes[i] / closes[i - 1] - 1 for i in range(31, 51)]
    mean = sum(rets) / 20
    assert got[50]["pine_vol"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in rets) / 20 * 252))
    falls = {i: closes[i] / max(closes[i - 59 : i + 1]) - 1 for i in range(59, 140)}
    assert got[117]["pine_max_drawdown"] is None and got[130]["pine_max_drawdown"] == pytest.approx(min(falls[i] for i in range(71, 131)))


DAY = d.datetime(2020, 1, 1)


def test_slices_are_away_from_the_market(spark):
    o = spark.createDataFrame([(1, "A", s, 100.0, u, 50.0) for s in ("buy", "sell") for u in (0.5, 0.9)], "parent_id long, symbol string, side string, qty double, urgency double, limit_price double").withColumns({"start_ts": F.lit(DAY), "end_ts": F.lit(DAY + d.timedelta(minutes=5))})
    got = {(r["side"], r["order_type"]): r["limit_price"] for r in execution.twap(o).collect()}
    assert got == {("buy", "limit"): pytest.approx(49.995), ("sell", "limit"): pytest.approx(50.005), ("buy", "market"): None, ("sell", "market"): None}


def test_regime_machine_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(signals, "SCAN", 7)
    rng, rows, want = random.Random(4), [], {}
    for k in "ABC":
        pos = 0
        for i in range(120 if k == "A" else 5):
            regime, conf, pbr = rng.choice(["bull", "bear", "crisis", "low_volatility", None]), rng.choice([0.3, 0.5, 0.7, None]), rng.choice([0.3, 0.45, 0.6])
            up, down, c = regime == "bull", regime in ("bear", "crisis"), 0.5 if conf is None else conf
            if pos == 0:
                pos = 1 if up and c > 0.6 and pbr > 0.5 else -1 if down and c > 0.6 and pbr > 0.4 else 0
            elif pos == 1:
                pos = 0 if not up or c < 0.4 else 1
            else:
                pos = 0 if not down or c < 0.4 else -1
            rows.append((k, DAY + d.timedelta(days=i), regime, conf, pbr))
            want[k, i] = pos
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, regime string, confidence double, pbr double").repartition(3)
    got = {(r["symbol"], (r["ts"] - DAY).days): r["pos"] for r in signals.regime_positions(df, ["symbol"]).collect()}
    assert got == want and set(want.values()) == {-1, 0, 1}


def test_a_short_is_held_from_bear_into_crisis(spark):
    rows = [("bear", 0.7), ("crisis", 0.5), ("bear", 0.39), ("bull", 0.9), ("bear", 0.9), ("bear", 0.9)]
    df = spark.createDataFrame([("A", DAY + d.timedelta(days=i), r, c, 0.9) for i, (r, c) in enumerate(rows)], "symbol string, ts timestamp, regime string, confidence double, pbr double")
    assert [r["pos"] for r in signals.regime_positions(df, ["symbol"]).orderBy("ts").collect()] == [-1, -1, 0, 1, 0, -1]


def test_walk_forward_starts_anew_and_takes_returns(spark):
    """Two windows of 6 and 3 days. RSI of 2 with entry below 50 and exit above 50: falls are bought, rises are sold."""
    closes = [10, 9, 11, 9, 11, 9, 11, 9, 11, 9, 11, 9, 11, 12]
    bars = spark.createDataFrame([("A", DAY + d.timedelta(days=i), float(c), float(c)) for i, c in enumerate(closes)], "symbol string, ts timestamp, open double, close double")
    params = spark.createDataFrame([(0, 1, 50.0, 50.0, 0, 0, 0)], "param_id long, mn1 int, entry double, exit double, on int, off int, start int")
    w = search.walk_forward_days(bars, params, [1], least_trades=1, train=6, test=3, least_train=6, least_test=3).orderBy("window_id").collect()

    def loop(x, cost=0.0006):
        equity, pos, price, trades = 1000.0, 0, 0.0, 0
        for i, c in enumerate(x):
            rsi = 0  # of one move: no loss gives 0, a loss alone gives 0
            if not pos and rsi < 50 and i + 1 < len(x):
                pos, price = 1, x[i + 1] * (1 + cost)
            elif pos and rsi > 50:
                equity, pos, trades = equity * (x[i + 1] if i + 1 < len(x) else c) * (1 - cost) / price, 0, trades + 1
        if pos:
            equity, trades = equity * x[-1] * (1 - cost) / price, trades + 1
        return 100 * (equity / 1000 - 1), trades

    assert [r["window_id"] for r in w] == [0, 1]
    for r in w:
        a = 3 * r["window_id"]
        assert (r["train_return"], r["train_trades"]) == (pytest.approx(loop(closes[a : a + 6])[0]), 1)
        assert (r["test_return"], r["test_trades"]) == (pytest.approx(loop(closes[a + 6 : a + 9])[0]), 1)
        assert r["degradation_pct"] == pytest.approx(100 * (r["train_return"] - r["test_return"]) / abs(r["train_return"]))


def test_walk_forward_summary(spark):
    rows = [("A", 10.0, 5.0), ("A", 30.0, -1.0), ("B", -10.0, 2.0), ("B", -10.0, 4.0), ("C", 0.0, 1.0)]
    got = {r["symbol"]: r for r in search.walk_forward_summary(spark.createDataFrame(rows, "symbol string, train_return double, test_return double")).collect()}
    assert (got["A"]["efficiency"], got["A"]["consistency"], got["A"]["degradation_pct"], got["A"]["overfit"]) == (pytest.approx(0.1), 0.5, pytest.approx(90.0), True)
    assert (got["B"]["efficiency"], got["B"]["degradation_pct"], got["B"]["overfit"]) == (pytest.approx(-0.3), pytest.approx(-130.0), True)
    assert (got["C"]["efficiency"], got["C"]["degradation_pct"]) == (0.0, 0.0)
    assert got["A"]["out_of_sample_growth"] == pytest.approx(math.log(1.05 * 0.99))


def test_search_over_timeframes_sees_the_coarse_bar_of_the_day(spark):
    """A day without a daily bar cannot be entered and must be left; the second timeframe's phases stand on the first's best."""
    rng = random.Random(2)
    hours = [(DAY + d.timedelta(hours=h), round(100 + rng.uniform(-5, 5), 2)) for h in range(24 * 12)]
    days = [(DAY + d.timedelta(days=k), round(100 + rng.uniform(-5, 5), 2)) for k in range(12) if k != 5]
    bars = spark.createDataFrame([("A", "hourly", t, c, c) for t, c in hours] + [("A", "daily", t, c, c) for t, c in days], "symbol string, tf string, ts timestamp, open double, close double")
    cycles = search.grid(spark, on=[3, 30], off=[1], start=[0])
    rsis = search.grid(spark, mn1=[2, 3], mn2=[1, 2], entry=[60.0], exit=[70.0])
    base = {"mn1": 2, "mn2": 1, "entry": 60.0, "exit": 70.0, "on": 30, "off": 1, "start": 0}
    found = search.timeframe_search(bars, ("daily", "hourly"), cycles, rsis, base, [(2, 1), (2, 2), (3, 1), (3, 2)]).collect()
    assert len(found) == 8

    def rsi(closes, a, b):
        moves = [0.0] + [y - x for x, y in zip(closes, closes[1:], strict=False)]
        out = []
        for i in range(len(closes)):
            w = moves[max(0, i - a + 1) : i + 1]
            gain, loss = sum(m for m in w if m > 0), -sum(m for m in w if m < 0)
            out.append(100 - 100 / (1 + gain / loss) if loss > 0 else 0.0)
        return [sum(out[max(0, i - b + 1) : i + 1]) / len(out[max(0, i - b + 1) : i + 1]) for i in range(len(out))]

    def trades(daily, hourly):
        series = {}
        for tf, rows, p in (("d", days, daily), ("h", hours, hourly)):
            r = rsi([c for _, c in rows], p["mn1"], p["mn2"])
            cy = [(i - p["start"]) % (p["on"] + p["off"]) < p["on"] for i in range(len(rows))]
            series[tf] = {t: (x < p["entry"] and y, x > p["exit"] or not y) for (t, _), x, y in zip(rows, r, cy, strict=True)}
        pos, n = 0, 0
        for i, (t, _) in enumerate(hours):
            day = series["d"].get(t.replace(hour=0), (False, True))
            enter, leave = day[0] and series["h"][t][0], day[1] or series["h"][t][1]
            if not pos and enter and i + 1 < len(hours):
                pos = 1
            elif pos and leave:
                pos, n = 0, n + 1
        return n + pos

    best = {}
    for tf in ("daily", "hourly"):
        for r in (x for x in found if x["tf"] == tf):
            p = {k: r[k] for k in base}
            assert r["trades"] == trades(p if tf == "daily" else best["daily"], p if tf == "hourly" else base)
        best[tf] = {k: max((x for x in found if x["tf"] == tf), key=lambda x: (x["score"], -x["param_id"]))[k] for k in base}


def test_intervals_of_means_and_user_statistics(spark):
    rng = random.Random(6)
    x = [rng.gauss(0, 1) for _ in range(40)]
    v = spark.createDataFrame([("A", i, float(a), None if i == 3 else float(a) * 2) for i, a in enumerate(x)], "symbol string, sim long, a double, b double")
    r = resample.mean_intervals(v, ["a", "b"], 120).first()
    picks = resample.draws(9, np.arange(120)[:, None], np.arange(40)[None, :]) % 40
    means = np.array(x)[picks].mean(axis=1)
    assert (r["a_low"], r["a_high"]) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    twice = np.array([np.nan if i == 3 else 2 * a for i, a in enumerate(x)])[picks]
    assert r["b_low"] == pytest.approx(np.percentile(np.nanmean(twice, axis=1), 2.5))
    base = resample.numbered(spark.createDataFrame([("A", i, a) for i, a in enumerate(x)], "symbol string, i long, v double"), "v", "i")
    own = {s["sim"]: s["value"] for s in resample.user_statistic(base, np.mean, 60).collect()}
    native = {s["sim"]: s["m"] for s in resample.bootstrap(base, 60).groupBy("sim").agg(F.avg("x").alias("m")).collect()}
    assert own == pytest.approx(native)


def test_verdicts_and_grades(spark):
    got = values(spark, "k long, n long", [(4, 4), (2, 4), (1, 4), (0, 0)], resample.verdict(F.col("k"), F.col("n")))
    assert [x for (x,) in got] == ["highly_robust", "moderately_robust", "not_robust", "highly_robust"]
    s, g = resample.risk_grade(*(F.col(k) for k in "abcde"))
    got = values(spark, "a double, b double, c double, d double, e double", [(1.5, 10.0, -5.0, 0.8, 0.1), (0.7, 30.0, -15.0, 0.6, 0.4), (0.0, 50.0, -50.0, 0.1, 1.0), (1.5, 30.0, -15.0, 0.6, 0.4)], s, g)
    assert got == [(10, "excellent"), (5, "moderate"), (0, "poor"), (6, "good")]


def test_volatility_bins_and_performance(spark):
    n = 100
    rng = random.Random(1)
    rows = [("A", "daily", DAY + d.timedelta(days=i), rng.gauss(0, 0.01 + 0.0002 * i)) for i in range(n)]
    x = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, ret double")
    got = [r["vol_bin"] for r in regimes.volatility_bins(x).orderBy("ts").collect()]
    vol = pd.Series([r[3] for r in rows]).rolling(60).std()
    want = pd.cut(vol, bins=vol.quantile([0, 0.33, 0.67, 1.0]), labels=range(3), include_lowest=True)
    assert [None if pd.isna(w) else int(w) for w in want] == got
    p = regimes.by_regime(x.withColumn("label", F.lit("one")), "label").first()
    ret = pd.Series([r[3] for r in rows])
    assert (p["n"], p["sharpe"]) == (n, pytest.approx(ret.mean() / ret.std()))


def test_details_of_checks_and_the_bar_count(spark):
    def run(n):
        closes = [100.0 + (i % 2) for i in range(n - 1)] + [300.0]
        rows = [("A", "daily", DAY + d.timedelta(days=i if i < 5 else i + 3), c, c, c, c, None if i == 0 else 1.0) for i, c in enumerate(closes)]
        df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double")
        return {r["check_name"]: r for r in checks.suite(df).collect()}, pd.Series(closes).pct_change().dropna()

    got, ret = run(30)  # 30 bars are 29 returns
    z = (ret - ret.mean()).abs() / ret.std()
    assert (got["no_statistical_outliers"]["n"], got["no_statistical_outliers"]["detail"]) == (int((z > 5).sum()), pytest.approx(z.max())) and (z > 5).any()
    assert got["no_nulls_volume"]["detail"] == pytest.approx(100 / 30) and got["no_extreme_moves_close"]["detail"] == pytest.approx(ret.abs().max())
    assert got["no_unexpected_gaps"]["detail"] == 4 * 86400
    assert run(29)[0]["no_statistical_outliers"]["n"] == 0


def test_few_returns_are_not_degraded(spark):
    x = spark.createDataFrame([("A", DAY + d.timedelta(days=i), 0.01 if i < 50 else -0.01 - i * 1e-5) for i in range(62)], "symbol string, ts timestamp, ret double")
    r = monitor.sharpe_decay(x, ["symbol"]).first()
    assert (r["recent"], r["degraded"]) == (0.0, False)


def test_an_append_is_whole_or_not_there(spark, tmp_path):
    t = AppendTable(spark, f"{tmp_path}/t", "a long")
    assert t.read().count() == 0
    t.append(spark.range(3).withColumnRenamed("id", "a"))
    name = t.stage(spark.range(5).withColumnRenamed("id", "a"))  # a failure between the two steps
    assert t.read().count() == 3
    t.commit(name)
    assert t.read().count() == 8
    assert search.append_results(spark.range(2).withColumnRenamed("id", "a"), f"{tmp_path}/t").count() == 10


def test_a_version_without_its_commit_is_not_read(spark, tmp_path, monkeypatch):
    bars = lambda n: spark.createDataFrame([("A", "daily", DAY + d.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(n)], "symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double")
    s = VersionedStore(spark, str(tmp_path))
    v = s.write(bars(2))
    monkeypatch.setattr(AppendTable, "commit", lambda self, name: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        s.write(bars(5))
    assert s.read().count() == 2 and s.versions().count() == 1 and s.read(version=v).count() == 2 and all(r["intact"] for r in s.integrity().collect())


def test_grouped_features_do_not_hang_on_their_groups(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([("A", "daily", DAY + d.timedelta(days=i), rng.random()) for i in range(50)], "symbol string, tf string, ts timestamp, close double")
    run = lambda rows: [r["m"] for r in features.grouped_feature(df, "m", lambda g: g["close"].rolling(4, min_periods=1).max(), 3, rows).orderBy("ts").collect()]
    assert run(1000) == run(7) == run(4) and len(run(7)) == 50
    with pytest.raises(ValueError, match="longer"):
        run(3)


def test_next_bar_looks_into_later_days(spark):
    bar = lambda t: ("A", t, 1.0, 1.0, 1.0, float(t.day * 100 + t.hour))
    times = [DAY.replace(hour=9), DAY.replace(hour=15), DAY + d.timedelta(days=3, hours=9)]
    bars = spark.createDataFrame([bar(t) for t in times], "symbol string, ts timestamp, open double, high double, low double, close double")
    asked = [DAY, DAY.replace(hour=9), DAY.replace(hour=10), DAY.replace(hour=16), DAY + d.timedelta(days=1), DAY + d.timedelta(days=9)]
    o = spark.createDataFrame([("A", t, k) for k, t in enumerate(asked)] + [("B", DAY, 9)], "symbol string, ts timestamp, parent_id long")
    got = {r["parent_id"]: r["bar"] and r["bar"]["ts"] for r in execution.next_bar(o, bars).collect()}
    assert got == {0: times[0], 1: times[0], 2: times[1], 3: times[2], 4: times[2], 5: times[2], 9: None}


def test_isotonic_equals_pooled_violators(spark):
    """Adjacent groups whose means fall are pooled until none do."""
    rng = random.Random(3)
    x = [(round(rng.random(), 2), float(rng.random() < 0.5)) for _ in range(60)]
    groups = []
    for p in sorted({p for p, _ in x}):
        ys = [y for q, y in x if q == p]
        groups.append([p, p, sum(ys), len(ys)])
        while len(groups) > 1 and groups[-2][2] / groups[-2][3] >= groups[-1][2] / groups[-1][3]:
            low, high = groups[-2], groups.pop()
            groups[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(spark.createDataFrame(x, "p double, y double"))
    want = {p: s / n for low, high, s, n in groups for p, _ in x if low <= p <= high}
    got = {r["p"]: r["prediction"] for r in model.transform(spark.createDataFrame(x, "p double, y double")).collect()}
    assert got == pytest.approx(want)


def test_boosted_probabilities(spark, monkeypatch):
    from candlewick.operators import calibration

    monkeypatch.setattr(calibration, "ROUNDS", 3)
    rng = random.Random(5)
    rows = []
    for i in range(150):
        a, b = rng.random(), rng.random()
        rows.append(("A", DAY + d.timedelta(days=i), "bull", "bull" if a > 0.6 else "bear" if b > 0.5 else "crisis", i < 120, a, b))
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, regime string, label string, train boolean, a double, b double")
    model = calibration.fit_regime_model(frame, "boosted")
    out = calibration.forecast(model, frame).collect()
    assert all(r["p_bull"] + r["p_bear"] + r["p_crisis"] == pytest.approx(1) and r["confidence"] == max(r["p_bull"], r["p_bear"], r["p_crisis"]) for r in out)
    assert all(r["confidence"] == r[f"p_{r['predicted']}"] for r in out) and sum(r["predicted"] == r["label"] for r in out) > 140
    top = calibration.importances(model, spark).collect()
    assert {r["feature"] for r in top} == {"a", "b"} and sum(r["importance"] for r in top) == pytest.approx(1)


def test_runs_are_compared_by_the_names_that_occur(spark):
    rows = spark.createDataFrame([(1, "b.c", 2.0), (1, "a", 1.0), (2, "a", 3.0), (2, None, 9.0)], "run_id long, name string, value double")
    got = monitor.compare_runs(rows, None, "metric")
    assert got.columns == ["run_id", "metric_a", "metric_b.c"]
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, 2.0), (2, 3.0, None)]
    assert monitor.compare_runs(rows.limit(0), None, "metric").columns == ["run_id"]


def test_statistics_begin_after_the_warm_bars(spark):
    ret = {1: 0.5, 2: 0.5, 3: -0.1, 4: 0.2, 5: 0.3, 6: -0.5, 7: 0.1, 8: 0.1}
    label = {1: "bull", 2: "bull", 3: "bull", 4: "bull", 5: "bear", 6: "bull", 7: "bull", 8: "bull"}
    run = {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3, 7: 3, 8: 3}
    x = spark.createDataFrame([("A", i, i, ret[i], label[i], run[i]) for i in ret], "symbol string, ts long, i int, ret double, regime string, run long")
    got = {r["regime"]: r for r in regimes.statistics(x, warm=2).collect()}
    bull = [-0.1, 0.2, -0.5, 0.1, 0.1]
    assert (got["bull"]["n"], got["bull"]["win_rate"], got["bull"]["avg_duration"]) == (5, 0.6, 2)  # the run of bars 3 and 4; the last is open
    assert got["bull"]["max_drawdown"] == pytest.approx(-0.5)  # from 0.9 * 1.2; the first loss has no peak before it
    assert got["bull"]["sharpe"] == pytest.approx(np.mean(bull) * 252 / (np.std(bull, ddof=1) * math.sqrt(252)))
    assert (got["bear"]["n"], got["bear"]["sharpe"], got["bear"]["avg_duration"]) == (1, 0.0, 1)


def test_statistics_have_every_regime(spark):
    ret = [None, 0.1, -0.2, 0.3, 0.1]
    rows = [(s, i + 1, i + 1, ret[i], "bear" if i < 2 else "bull", 1 if i < 2 else 2) for s, n in (("A", 5), ("B", 2), (None, 5)) for i in range(n)]
    x = spark.createDataFrame(rows, "symbol string, ts long, i int, ret double, regime string, run long")
    got = {(r["symbol"], r["regime"]): tuple(r)[2:] for r in regimes.statistics(x, warm=2).collect()}
    assert set(got) == {(s, k) for s in ("A", "B", None) for k in regimes.REGIMES}
    assert {k for k, v in got.items() if v != (0, 0.0, 0.0, 0.0, 0.0, 0, 0.0)} == {("A", "bull"), (None, "bull")}  # the bear bars are too early
    assert got["A", "bull"] == got[None, "bull"] and (got["A", "bull"][0], got["A", "bull"][3]) == (3, 0.0)
    one = {r["regime"]: r for r in regimes.statistics(x, warm=4).filter("symbol = 'A'").collect()}["bull"]
    assert (one["n"], one["ann_vol"], one["sharpe"]) == (1, None, 0.0)


def test_rates_of_detected_changes(spark):
    true = ["a"] * 10 + ["b"] * 10 + ["a"] * 20
    found = ["a"] * 12 + ["b"] * 4 + ["a"] * 14 + ["b"] * 10  # changes at 12 (near 10), 16 and 30 (near none); 20 is missed
    rows = [("A", "d", i, t, f) for i, (t, f) in enumerate(zip(true, found, strict=True))] + [("B", "d", i, "a", "a") for i in range(5)]
    x = spark.createDataFrame(rows, "symbol string, tf string, ts long, t string, f string")
    got = {r["symbol"]: (r["false_rate"], r["true_rate"], r["missed_rate"]) for r in regimes.transition_rates(x, "t", "f").collect()}
    assert got["A"] == pytest.approx((2 / 3, 1 / 3, 1 / 2)) and got["B"] == (0.0, 0.0, 0.0)
    assert {r["symbol"]: r["latency"] for r in regimes.latency(x, "t", "f").collect()} == {"A": (2 + 10) / 2, "B": 0.0}


def test_episodes_lie_below_the_threshold(spark):
    equity = [100.0, 99.5, 98.0, 97.0, 98.5, 99.2, 100.0, 90.0, 95.0]
    x = spark.createDataFrame([("A", i, e) for i, e in enumerate(equity)], "symbol string, ts long, equity double")
    got = [(r["start_ts"], r["length"], r["recovery"]) for r in metrics.episodes(x, ["symbol"]).orderBy("episode").collect()]
    assert got == [(2, 3, 2), (7, 2, 2)]  # 99.5 and 99.2 are less than a hundredth down; the second is open


def test_engine_year_counts_equity_points(spark):
    x = spark.createDataFrame([("A", i, e) for i, e in enumerate([100.0, 110.0, 121.0])] + [("B", i, 5.0) for i in range(3)], "symbol string, ts long, equity double")
    got = {r["symbol"]: r for r in metrics.engine_metrics(x, ["symbol"], year=6.0).collect()}
    assert got["A"]["annual_return"] == pytest.approx(1.21**2 - 1) and (got["B"]["annual_return"], got["B"]["sharpe"]) == (0.0, 0.0)


def test_superior_ability_and_sharpe_interval_equal_loops(spark):
    rng = random.Random(5)
    data = {s: [rng.gauss(0.2, 1.0) for _ in range(40)] for s in "AB"}
    base = resample.numbered(spark.createDataFrame([(s, i, v) for s, xs in data.items() for i, v in enumerate(xs)], "symbol string, ts long, v double"), "v", "ts")
    t = lambda m, xs: m / np.std(xs, ddof=1) * math.sqrt(len(xs))
    best = max(t(np.mean(xs), xs) for xs in data.values())
    drawn: dict = {}
    for r in resample.stationary_bootstrap(base, 50).collect():
        drawn.setdefault(r["sim"], {}).setdefault(r["symbol"], []).append(r["x"])
    tops = [max(t(np.mean(xs) - np.mean(data[s]), xs) for s, xs in by.items()) for by in drawn.values()]
    got = resample.superior_ability(base, 50).first()
    assert got["t"] == pytest.approx(best) and got["p"] == pytest.approx(np.mean([x >= best for x in tops]))
    sharpe = lambda xs: np.mean(xs) / np.std(xs, ddof=1) * math.sqrt(252)
    blocks: dict = {}
    for r in resample.block_bootstrap(base, 50, 10).collect():
        blocks.setdefault((r["symbol"], r["sim"]), []).append(r["x"])
    for r in resample.sharpe_interval(base, 50).collect():
        low, high = np.percentile([sharpe(xs) for (s, _), xs in blocks.items() if s == r["symbol"]], [2.5, 97.5])
        assert (r["sharpe"], r["low"], r["high"]) == pytest.approx((sharpe(data[r["symbol"]]), low, high))


def test_names_of_volatility_changes(spark):
    series = {"A": [0.01, -0.01] * 2 + [0.03, -0.03] * 2, "B": [0.0] * 4 + [0.01, -0.01] * 2, "C": [0.03, -0.03] * 2 + [0.01, -0.01] * 2}
    x = spark.createDataFrame([(s, i, v) for s, xs in series.items() for i, v in enumerate(xs)], "symbol string, ts long, ret double")
    rows = monitor.vol_ratio(x, ["symbol"], n=4).collect()
    assert {r["symbol"]: (r["regime"], r["changed"]) for r in rows if r["ts"] == 7} == {"A": ("high_volatility", True), "B": ("normal", False), "C": ("low_volatility", True)}
    assert {r["regime"] for r in rows if r["ts"] < 7} == {"unknown"}


def test_rows_of_the_predictor(spark):
    rng = random.Random(8)
    rets = [None] + [rng.gauss(0, 0.02) for _ in range(329)]
    columns = [n for n in calibration.FEATURES if n not in ("duration_scaled", "ret_20", "rsi")]
    rows = [("A", i + 1, i + 1, r, rng.choice(regimes.REGIMES), 7, *([0.5] * (len(columns) + 2))) for i, r in enumerate(rets)]
    x = spark.createDataFrame(rows, "symbol string, ts long, i int, ret double, regime string, duration long, ret_20 double, rsi double, " + ", ".join(f"{n} double" for n in columns))
    got = calibration.training_frame(x).orderBy("ts").collect()
    assert [r["ts"] for r in got] == list(range(201, 326)) and sum(r["train"] for r in got) == 100
    assert all(r["label"] == rows[r["ts"] - 1 + 5][4] for r in got)
    last = rets[200 - 13 : 201]  # bar 201 and the 13 before
    gain, loss = sum(v for v in last if v > 0), -sum(v for v in last if v < 0)
    assert got[0]["ret_20"] == pytest.approx(np.mean(rets[181:201]) * 252) and got[0]["rsi"] == pytest.approx(1 - 1 / (1 + gain / (loss + 1e-10)))
    assert calibration.training_frame(x.filter("ts <= 304")).isEmpty()  # 99 rows


def test_ties_of_agreement_go_to_the_shortest_horizon(spark):
    x = spark.createDataFrame([(1, 1, "crisis", 0.5), (1, 5, "bull", 0.5), (2, 1, "bull", 0.5), (2, 5, "crisis", 0.5)], "k long, horizon int, regime string, confidence double")
    assert {r["k"]: r["consensus"] for r in regimes.agreement(x, ["k"]).collect()} == {1: "crisis", 2: "bull"}


def test_a_baseline_of_nothing_and_flat_returns(spark):
    x = spark.createDataFrame([("s", 1, 0.0), ("s", 2, -5.0), ("t", 1, 2.0), ("t", 2, 1.0)], "strategy string, ts long, v double")
    got = {(r["strategy"], r["ts"]): (r["change"], r["degraded"]) for r in monitor.compare_baseline(x, "strategy", "ts", "v").collect()}
    assert got[("s", 2)] == (0.0, False) and got[("t", 2)] == (-0.5, True)
    flat = spark.createDataFrame([("A", i, 0.02 if i % 3 else 0.001) for i in range(40)] + [("A", 40 + i, 0.0) for i in range(63)], "symbol string, ts long, ret double")
    r = monitor.sharpe_decay(flat, ["symbol"]).first()
    assert (r["recent"], r["degraded"]) == (0.0, True)


def test_methods_of_simulation_equal_a_loop(spark):
    results = [5.0, -3.0, 8.0, -60.0, 4.0, 2.0, -1.0]
    base = resample.numbered(spark.createDataFrame([("A", i, v) for i, v in enumerate(results)], "symbol string, ts long, v double"), "v", "ts")
    final = lambda xs: 1000 * math.prod(1 + x / 100 for x in xs)
    got = {r["method"]: r for r in resample.compare_methods(base, 40).collect()}
    assert set(got) == {"randomization", "bootstrap", "parametric", "block"} and all(r["n_sims"] == 40 and r["original"] == pytest.approx(final(results)) for r in got.values())
    assert (got["randomization"]["p_beats"], got["randomization"]["inside"], got["randomization"]["p_ruin"]) == (0.0, True, 1.0)  # 1000 * ... = 460
    for name, sims in (("bootstrap", resample.bootstrap(base, 40)), ("block", resample.block_bootstrap(base, 40, 2))):
        drawn: dict = {}
        for r in sims.collect():
            drawn.setdefault(r["sim"], []).append(r["x"])
        ends = [final(xs) for xs in drawn.values()]
        low, high = np.percentile(ends, [2.5, 97.5])
        r = got[name]
        assert (r["p_profit"], r["p_ruin"], r["low"], r["high"]) == pytest.approx((np.mean([e > 1000 for e in ends]), np.mean([e < 500 for e in ends]), low, high))


def test_windows_that_the_data_allow(spark):
    day = d.datetime(2024, 1, 1)
    x = spark.createDataFrame([(s, day + d.timedelta(days=k)) for s, n in (("A", 40), ("B", 100), ("C", 200), ("D", 400)) for k in (0, n)], "symbol string, ts timestamp")
    got = {r["symbol"]: (r["train_days"], r["test_days"], r["windows"]) for r in search.adequacy(x).collect()}
    assert got == {"A": (14, 7, 3), "B": (33, 16, 4), "C": (90, 20, 5), "D": (180, 30, 7)}
