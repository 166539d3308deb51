"""Set-based forms of folds against the folds themselves."""

import random

import pytest
from candlewick.functions import exprs
from candlewick.operators import execution, features, monitor, regimes, resample, search
from pyspark.sql import functions as F


def test_exponential_mean_by_blocks(spark):
    rng = random.Random(1)
    values = [100 + rng.gauss(0, 5) for _ in range(1500)]
    bars = spark.createDataFrame([("A", "d", i, x) for i, x in enumerate(values)], "symbol string, tf string, ts long, close double")
    for alpha in (2 / 13, 1 / 14, 0.7):
        x = bars
        for stage in exprs.ema_stages("m", "close", ("symbol", "tf"), alpha):
            x = x.withColumns({k: v() for k, v in stage.items()})
        got = [r["m"] for r in x.orderBy("ts").collect()]
        want = [values[0]]
        for v in values[1:]:
            want.append(want[-1] * (1 - alpha) + v * alpha)
        assert got == pytest.approx(want, rel=1e-12)


def test_average_cost(spark):
    rng = random.Random(2)
    fills = [("P", s, i, float(rng.choice([-30, -20, -10, 10, 20, 30])), round(rng.uniform(5, 50), 2)) for s in "AB" for i in range(400)]
    fills += [("P", "flat", 0, 10.0, 7.0), ("P", "flat", 1, -10.0, 9.0)]
    got = {r["symbol"]: r for r in execution.average_cost(spark.createDataFrame(fills, "portfolio string, symbol string, ts long, qty double, price double")).collect()}
    for s in ("A", "B", "flat"):
        q = avg = real = 0.0
        for _, _, _, f, px in (x for x in fills if x[1] == s):
            if q * f >= 0:
                avg = (avg * q + px * f) / (q + f)
            else:
                real += min(abs(f), abs(q)) * (px - avg) * (1 if q > 0 else -1)
                avg = px if abs(f) > abs(q) else avg
            q += f
        assert (got[s]["qty"], got[s]["avg_price"], got[s]["realized"]) == pytest.approx((q, avg if q else 0.0, real), rel=1e-9)


def test_latency(spark):
    rng = random.Random(3)
    rows, t, d = [], "a", "a"
    for i in range(600):
        t = rng.choice("abc") if rng.random() < 0.05 else t
        d = rng.choice("abc") if rng.random() < 0.08 else d
        rows.append(("S", "d", i, t, d))
    x = spark.createDataFrame(rows, "symbol string, tf string, ts long, t string, d string")
    change = lambda k: [i for i in range(1, 600) if rows[i][k] != rows[i - 1][k]]
    found = change(4)
    lags = [min([j - i for j in found if 0 <= j - i <= 9], default=10) for i in change(3)]
    assert regimes.latency(x, "t", "d").first()["latency"] == pytest.approx(sum(lags) / len(lags))


def test_inner_windows_lie_within_the_outer_train_part(spark):
    outer = search.fold_windows(spark.createDataFrame([("A", 600)], "symbol string, n long"))
    inner = search.inner_windows(outer).orderBy("window_id", "fold").collect()
    ends = {r["window_id"]: r["train_to"] for r in outer.collect()}
    assert len(inner) == 15 and all(r["test_to"] <= ends[r["window_id"]] and r["train_to"] == r["test_from"] for r in inner)
    assert [(r["train_to"], r["test_to"]) for r in inner[:3]] == [(25, 50), (50, 75), (75, 100)]


def test_spells_and_shape(spark):
    sims = spark.createDataFrame([("A", 0, i, x) for i, x in enumerate([10.0, -5.0, -5.0, 20.0, -0.5, -10.0, 1.0])], "symbol string, sim long, slot long, x double")
    got = [tuple(r) for r in resample.spells(sims).orderBy("spell").select("length", "recovery").collect()]
    assert got == [(2, 1), (2, 2)]
    few = resample.shape(spark.createDataFrame([("A", float(i)) for i in range(5)], "symbol string, x double")).first()
    assert (few["skew"], few["p_skew"], few["p_kurt"]) == (0.0, 1.0, 1.0)
    flat = resample.shape(spark.createDataFrame([("A", float(i)) for i in range(100)], "symbol string, x double")).first()
    assert flat["p_skew"] == pytest.approx(1.0, abs=1e-6) and flat["p_kurt"] < 1e-4  # even values: no skew, thin tails


def test_logs_and_models(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:00:01", "INFO", "fill", 7, 1, 2.0), ("2024-01-01 00:00:00", "INFO", "order", 7, 1, 1.0), ("2024-01-01 00:00:02", "INFO", "order", 8, 2, 5.0)], "t string, level string, event string, correlation_id long, order_id long, amount double")
    log.select(F.col("t").cast("timestamp").alias("timestamp"), "level", "event", "correlation_id", F.struct("order_id", "amount").alias("details")).write.json(f"{tmp_path}/log")
    read = monitor.read_log(spark, f"{tmp_path}/log")
    assert [r["event"] for r in monitor.search_log(read, 7).collect()] == ["order", "fill"] and monitor.search_log(read, 8, "fill").count() == 0
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="v")]).fit(spark.createDataFrame([(1.0,)], "a double"))
    for v in (1, 2):
        monitor.save_model(model, f"{tmp_path}/models", "m", v)
    versions = spark.createDataFrame([("m", 1, "production", 1), ("m", 2, "staging", 2)], "model string, version long, stage string, created long")
    assert monitor.load_model(versions, f"{tmp_path}/models", "m", "production").stages[0].getInputCols() == ["a"]
    with pytest.raises(LookupError):
        monitor.load_model(versions, f"{tmp_path}/models", "m", "archived")
    assert features.Pipeline("p", [features.macd()]).names() == ["macd", "macd_signal", "macd_histogram"]
