"""Calibration of probabilities: measures, isotonic and Platt scaling with MLlib, and regime forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def reliability(x: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of p: n, mean p, mean y, and for all bins Brier score, ECE, MCE and whether that is calibrated.

    ``x``: (p in 0..1, y 0/1). Bins are at most ``bins`` rows, which are joined to their totals.
    """
    b = x.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.sum((F.col("p") - F.col("y")) ** 2).alias("_se"))
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    all_ = b.agg((F.sum("_se") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    return b.drop("_se").crossJoin(F.broadcast(all_)).withColumn("calibrated", (F.col("ece") < 0.1) & (F.col("brier") < 0.25))  # one row of totals


def isotonic(x: DataFrame, classes: list[str], fit_on: str = "true") -> DataFrame:
    """One-vs-rest isotonic calibration of p_<class> against ``label``, renormalised; fitted on the rows where ``fit_on`` holds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    out = x
    for k in classes:
        y = out.withColumn("_y", (F.col("label") == k).cast("double"))
        y = VectorAssembler(inputCols=[f"p_{k}"], outputCol="_f").transform(y)
        model = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol=f"c_{k}").fit(y.filter(fit_on))
        out = model.transform(y).drop("_y", "_f")
    total = sum((F.col(f"c_{k}") for k in classes[1:]), F.col(f"c_{classes[0]}"))
    return out.withColumn("_t", total).withColumns({f"c_{k}": F.when(F.col("_t") > 0, F.col(f"c_{k}") / F.col("_t")).otherwise(1.0 / len(classes)) for k in classes}).drop("_t")


def platt(x: DataFrame, p: str = "p", y: str = "y", fit_on: str = "true") -> DataFrame:
    """Adds ``calibrated``: a logistic fit of y on the logit of p, fitted on the rows where ``fit_on`` holds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    z = VectorAssembler(inputCols=["_z"], outputCol="_f").transform(x.withColumn("_z", F.ln(q / (1 - q))).withColumn("_y", F.col(y).cast("double")))
    model = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=0.0, maxIter=50, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_hat").fit(z.filter(fit_on))
    return model.transform(z).withColumn("calibrated", vector_to_array("_p")[1]).drop("_z", "_y", "_f", "_p", "_raw", "_hat")


FEATURES = ["p_bull", "p_bear", "p_high_volatility", "p_low_volatility", "p_crisis", "confidence", "duration_scaled", "stay", "realized_vol", "ret_20", "skew", "kurt", "vs_fast", "vs_slow", "rsi", "drawdown"]


def training_frame(detected: DataFrame, horizon: int = 5, least: int = 100, warm: int = 200) -> DataFrame:
    """Predictor features of a detected table with the label ``horizon`` bars ahead, after the first ``warm`` bars, of symbols that have
    at least ``least`` such rows; the first 80 per cent of them are for training.

    Two features are not the detector's: ``ret_20`` is the mean of 20 returns times 252, ``rsi`` (0 to 1) is over the last 14 returns.
    """
    from pyspark.sql import Window

    from ..functions.exprs import frame, over

    r, last = F.col("ret"), frame(14, "symbol")
    gain, loss = (F.coalesce(F.sum(F.when(k, r)).over(last), F.lit(0.0)) for k in (r > 0, r < 0))
    x = detected.withColumns({
        "label": F.lead("regime", horizon).over(over("symbol")), "duration_scaled": F.col("duration") / 100.0,
        "ret_20": F.avg("ret").over(frame(20, "symbol")) * 252, "rsi": 1 - 1 / (1 + gain / (F.abs(loss) + 1e-10)),
    }).filter((F.col("i") > warm) & F.col("label").isNotNull())
    x = x.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "_k": F.row_number().over(over("symbol"))})
    one_hot = {f"is_{k}": (F.col("regime") == k).cast("double") for k in ("bull", "bear", "high_volatility", "low_volatility", "crisis")}
    x = x.withColumns(one_hot | {"train": F.col("_k") <= F.floor(0.8 * F.col("_n"))}).filter(F.col("_n") >= least)
    return x.select("symbol", "ts", "regime", "label", "train", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*FEATURES, *one_hot)))


#: Boosted trees: rounds, depth and rate of learning (fixed values).
ROUNDS, BOOST_DEPTH, RATE = 100, 6, 0.1


def fit_regime_model(frame: DataFrame, kind: str = "forest", trees: int = 100, depth: int = 10, seed: int = 42, rows: int = 100_000):
    """A fitted pipeline: indexed label, scaled features, and a random forest of ``trees`` trees, or boosted trees of ROUNDS rounds,
    one ensemble against the rest for each label, side by side. A round is a few short jobs, so the rows are first gathered
    into partitions of about ``rows``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    names = [c for c in frame.columns if c not in ("symbol", "ts", "regime", "label", "train")]
    model = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed) if kind == "forest" else OneVsRest(classifier=GBTClassifier(maxIter=ROUNDS, maxDepth=BOOST_DEPTH, stepSize=RATE, seed=seed).setRawPredictionCol("margins"), labelCol="y", featuresCol="x", parallelism=5, rawPredictionCol="margins")
    stages = [StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), model]
    train = cut(frame.filter("train"))
    n = train.count()
    if n == 0:
        raise ValueError("no symbol has enough rows to fit a model")
    return Pipeline(stages=stages).fit(train.coalesce(-(-n // rows)))


def forecast(model, rows: DataFrame) -> DataFrame:
    """symbol, ts, label, predicted, confidence (the highest probability), and the probability of each label by name."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    out = model.transform(rows)
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1)
    if "margins" in out.columns:  # one against the rest has margins only: their softmax
        out = out.withColumn("_m", vector_to_array("margins")).withColumn("_e", F.transform("_m", lambda x: F.exp(x - F.array_max("_m"))))
        p = F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    else:
        p = vector_to_array("probability")
    out = out.withColumn("_p", p)
    p = F.col("_p")
    return out.select("symbol", "ts", "label", name.alias("predicted"), F.array_max(p).alias("confidence"), *(p[k].alias(f"p_{x}") for k, x in enumerate(labels)))


def importances(model, spark, top: int = 10) -> DataFrame:
    """(rank, feature, importance): the features that a fitted forest leans on most; of boosted trees the mean over the labels."""
    names, last = model.stages[1].getInputCols(), model.stages[-1]
    parts = [m.featureImportances.toArray() for m in getattr(last, "models", [last])]
    rows = sorted(zip(names, (float(sum(x) / len(parts)) for x in zip(*parts, strict=True)), strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(k + 1, n, v) for k, (n, v) in enumerate(rows[:top])], "rank int, feature string, importance double")


def confusion(predicted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, predicted, n, recall, precision, accuracy): recall and precision are of the label and the prediction."""
    from pyspark.sql import Window

    c = predicted.groupBy(*keys, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    of = lambda *k: F.sum("n").over(Window.partitionBy(*keys, *k) if keys or k else Window.partitionBy(F.lit(0)))  # noqa: E731  a row for each pair of labels
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return c.withColumns({"recall": F.col("n") / of("label"), "precision": F.col("n") / of("predicted"), "accuracy": right / of()})
