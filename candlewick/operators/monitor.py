"""Metrics over time, drift tests, alerts, experiments and model versions as tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div, norm_cdf, over, roll


def series(metrics: DataFrame, name: str, tags: dict[str, str] | None = None, start=None, end=None) -> DataFrame:
    """Values of a metric within a time range whose tags hold all of ``tags``."""
    x = metrics.filter(F.col("name") == name)
    for k, v in (tags or {}).items():
        x = x.filter(F.col("tags")[k] == v)
    if start is not None:
        x = x.filter(F.col("ts") >= F.lit(start))
    return x.filter(F.col("ts") <= F.lit(end)) if end is not None else x


def latest(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def prometheus(latest_: DataFrame) -> DataFrame:
    """Text exposition, a line for each metric and tag set. Needs name, tags, value."""
    pairs = F.transform(F.sort_array(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return latest_.select(F.concat(F.col("name"), F.when(F.size("tags") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("value"))


def kolmogorov_smirnov(x: DataFrame, terms: int = 100) -> DataFrame:
    """Two-sample test by key: greatest distance of the distributions and its asymptotic p. ``x``: key, sample (0/1), value."""
    v = x.filter(F.col("value").isNotNull()).groupBy("key", "value").agg(F.count_if(F.col("sample") == 0).alias("a"), F.count_if(F.col("sample") == 1).alias("b"))
    w, run = Window.partitionBy("key"), Window.partitionBy("key").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    y = v.withColumns({"n": F.sum("a").over(w), "m": F.sum("b").over(w), "fa": F.sum("a").over(run), "fb": F.sum("b").over(run)})
    d = y.groupBy("key").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.max(F.abs(div(F.col("fa"), F.col("n")) - div(F.col("fb"), F.col("m")))).alias("d"))
    t = F.col("d") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + 2 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * F.col("_t") * F.col("_t")))
    out = d.withColumn("_t", t).withColumn("p", F.when(F.col("_t") < 0.2, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))).drop("_t")
    return out.withColumn("drift", F.col("p") < 0.05)


def kl_divergence(x: DataFrame, bins: int = 50, threshold: float = 0.1) -> DataFrame:
    """Divergence of sample 1 from the reference (sample 0) over equal bins of the reference's range."""
    r = x.filter("sample = 0 AND value IS NOT NULL").groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    y = x.filter("value IS NOT NULL").join(r, "key").filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")) & (F.col("hi") > F.col("lo")))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    g = y.groupBy("key", b.alias("bin")).agg(F.count_if(F.col("sample") == 0).alias("a"), F.count_if(F.col("sample") == 1).alias("b"))
    w = Window.partitionBy("key")
    g = g.withColumns({"p": F.col("b") / F.sum("b").over(w) + 1e-10, "q": F.col("a") / F.sum("a").over(w) + 1e-10})
    return g.groupBy("key").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl")).withColumn("drift", F.col("kl") > threshold)


def histogram(x: DataFrame, ranges: DataFrame, keys: list[str], bins: int = 50) -> DataFrame:
    """(keys, bin, n): counts of values within each key's range; ``ranges``: key, lo, hi. Histograms of parts add up.

    The ranges, a row a key, are sent to the values, which are counted where they lie: by key a task would hold all values of its keys.
    """
    y = x.filter("value IS NOT NULL").join(F.broadcast(ranges), "key").filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")) & (F.col("hi") > F.col("lo")))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return y.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_drift(reference: DataFrame, current: DataFrame, keys: list[str], threshold: float = 0.1) -> DataFrame:
    """(keys, kl, drift): divergence of current histograms (keys with key, bin, n) from the reference's (key, bin, n)."""
    known = current.select(*keys).distinct().join(reference.select("key", "bin", F.col("n").alias("a")), "key")
    both = known.join(current.withColumnRenamed("n", "b"), [*keys, "bin"], "full").fillna(0, ["a", "b"])
    w = Window.partitionBy(*keys)
    g = both.withColumns({"p": F.col("b") / F.sum("b").over(w) + 1e-10, "q": F.try_divide(F.col("a"), F.sum("a").over(w)) + 1e-10})
    return g.groupBy(*keys).agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl")).withColumn("drift", F.col("kl") > threshold)


def t_test(x: DataFrame) -> DataFrame:
    """Pooled two-sample t and its p by the normal distribution (large samples)."""
    s = lambda k, f: f(F.when(F.col("sample") == k, F.col("value")))
    a = x.groupBy("key").agg(s(0, F.count).alias("n"), s(1, F.count).alias("m"), s(0, F.avg).alias("ma"), s(1, F.avg).alias("mb"), s(0, F.var_samp).alias("va"), s(1, F.var_samp).alias("vb"))
    pooled = ((F.col("n") - 1) * F.col("va") + (F.col("m") - 1) * F.col("vb")) / (F.col("n") + F.col("m") - 2)
    t = (F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("m")))
    return a.withColumn("t", t).select("key", "t", (2 * (1 - norm_cdf(F.abs("t")))).alias("p"))


def sharpe_decay(returns: DataFrame, keys: list[str], last: int = 63, share: float = 0.7, year: float = 252.0) -> DataFrame:
    """Sharpe of the last rows against ``share`` of that of all rows; with fewer rows than ``last`` nothing is judged."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    x = returns.filter(F.col("ret").isNotNull()).withColumn("_n", F.row_number().over(w))
    recent = F.when(F.col("_n") <= last, F.col("ret"))
    a = x.groupBy(*keys).agg((div(F.avg("ret"), F.stddev_samp("ret")) * math.sqrt(year)).alias("baseline"), (div(F.avg(recent), F.stddev_samp(recent)) * math.sqrt(year)).alias("recent"), F.count(F.lit(1)).alias("_k"))
    a = a.withColumns({"recent": F.when(F.col("_k") >= last, F.coalesce("recent", F.lit(0.0))).otherwise(0.0), "degraded": (F.col("_k") >= last) & F.coalesce(F.coalesce("recent", F.lit(0.0)) < share * F.col("baseline"), F.lit(False))})
    return a.drop("_k")


def vol_ratio(returns: DataFrame, keys: list[str], n: int = 60) -> DataFrame:
    """Volatility of the last n rows by that of the n before (1 if that is 0); a change above 1.5 or below 0.67, and what the volatility is
    called then; unknown below 2 n returns.
    """
    x = returns.withColumn("_v", roll(F.stddev_samp, F.col("ret"), n, *keys))
    x = x.withColumn("_old", F.lag("_v", n).over(over(*keys)))
    x = x.withColumn("ratio", F.when(F.col("_old") == 0, 1.0).otherwise(div(F.col("_v"), F.col("_old")))).drop("_v", "_old")
    name = F.when(F.col("ratio") > 1.5, "high_volatility").when(F.col("ratio") < 0.67, "low_volatility").when(F.col("ratio").isNotNull(), "normal").otherwise("unknown")
    return x.withColumn("regime", name).withColumn("changed", F.col("regime").isin("high_volatility", "low_volatility"))


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric rows that break a rule; a rule table is a few rows by name, so it is sent along. Batch and stream alike."""
    v, t, k = F.col("value"), F.col("threshold"), F.col("comparison")
    hit = F.when(k == ">", v > t).when(k == "<", v < t).when(k == ">=", v >= t).when(k == "<=", v <= t).otherwise(F.abs(v - t) < 1e-6)
    msg = F.concat(F.col("name"), F.lit(" "), k, F.lit(" "), t.cast("string"))
    return metrics.join(rules, "name").filter(hit).withColumn("message", msg)


def export_json(alerts_: DataFrame, path: str) -> None:
    """Alerts as JSON, a line each."""
    alerts_.write.mode("append").json(path)


def json_round_trip(alerts_: DataFrame, path: str) -> DataFrame:
    """Exported and read back with the same schema."""
    export_json(alerts_, path)
    return alerts_.sparkSession.read.schema(alerts_.schema).json(path)


LOG_SCHEMA = "timestamp timestamp, level string, event string, correlation_id long, details struct<order_id: long, amount: double>"


def read_log(spark, path: str) -> DataFrame:
    """A structured log: JSON, a record a line, by a fixed schema."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def search_log(log: DataFrame, correlation_id: Column | int, event: str | None = None) -> DataFrame:
    """The records of one correlation id, in order of time."""
    found = log.filter(F.col("correlation_id") == correlation_id)
    return (found.filter(F.col("event") == event) if event else found).orderBy("timestamp")


def log_summary(log: DataFrame) -> DataFrame:
    """Records of each correlation id and event: count, first and last time, total amount."""
    return log.groupBy("correlation_id", "event").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.sum("details.amount").alias("amount"))


def active(alerts_: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return alerts_.filter(F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS"))


def compare_baseline(runs: DataFrame, by: str, order: str, value: str, worse: float = -0.20) -> DataFrame:
    """Each run against the first one of its strategy; against a baseline of 0 there is no change."""
    base = F.first(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = runs.withColumn("baseline", base).withColumn("change", F.when(F.col("baseline") == 0, 0.0).otherwise(div(F.col(value) - F.col("baseline"), F.abs("baseline"))))
    return x.withColumn("degraded", F.coalesce(F.col("change") < worse, F.lit(False)))


def latest_state(events: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """Latest row of an append-only event table."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")


def run_params(events: DataFrame) -> DataFrame:
    """(run_id, name, text): the latest text of each parameter. ``events``: run_id, ts, kind, name, step, value, text.

    Events are only ever appended; ``kind`` is param, metric, artifact or status.
    """
    return events.filter("kind = 'param'").groupBy("run_id", "name").agg(F.max_by("text", "ts").alias("text"))


def run_metrics(events: DataFrame) -> DataFrame:
    """(run_id, name, step, value): each metric at each step, the latest where a step was logged again."""
    return events.filter("kind = 'metric'").groupBy("run_id", "name", "step").agg(F.max_by("value", "ts").alias("value"))


def last_metrics(metrics: DataFrame) -> DataFrame:
    """(run_id, name, steps, value, best): the number of steps, the last one's value and the highest."""
    return metrics.groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("steps"), F.max_by("value", "step").alias("value"), F.max("value").alias("best"))


def run_artifacts(events: DataFrame) -> DataFrame:
    """(run_id, name, text): the latest path of each artifact."""
    return events.filter("kind = 'artifact'").groupBy("run_id", "name").agg(F.max_by("text", "ts").alias("text"))


#: Columns that a comparison of runs may have.
MOST_NAMES = 10_000


def compare_runs(rows: DataFrame, names: list[str] | None, prefix: str, value: str = "value") -> DataFrame:
    """A row a run, a column for each name: ``rows`` is (run_id, name, value). Without names all that occur are taken, in order."""
    if names is None:
        names = [r["name"] for r in rows.filter("name IS NOT NULL").select("name").distinct().orderBy("name").limit(MOST_NAMES + 1).collect()]
        if len(names) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} names; choose some")
    if not names:
        return rows.select("run_id").distinct()
    return rows.groupBy("run_id").pivot("name", names).agg(F.first(value)).select("run_id", *(F.col(f"`{n}`").alias(f"{prefix}_{n}") for n in names))


def comparison(events: DataFrame, params: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """The runs side by side: param_<name> and the last metric_<name>."""
    p = compare_runs(run_params(events), params, "param", "text")
    return p.join(compare_runs(last_metrics(run_metrics(events)), metrics, "metric"), "run_id", "full")


def latest_in_stage(versions: DataFrame) -> DataFrame:
    """The highest version of each model in each stage."""
    return versions.groupBy("model", "stage").agg(F.max("version").alias("version"), F.max_by("created", "version").alias("created"))


def save_model(model, root: str, name: str, version: int) -> str:
    """Writes a fitted MLlib model to the shared folder; the path."""
    path = f"{root.rstrip('/')}/{name}/v{version}"
    model.write().save(path)
    return path


def load_model(versions: DataFrame, root: str, name: str, stage: str):
    """The fitted MLlib pipeline that is the model's latest version in a stage."""
    from pyspark.ml import PipelineModel

    row = latest_in_stage(versions).filter((F.col("model") == name) & (F.col("stage") == stage)).first()
    if row is None:
        raise LookupError(f"{name} has no version in {stage}")
    return PipelineModel.load(f"{root.rstrip('/')}/{name}/v{row['version']}")


def model_versions(events: DataFrame) -> DataFrame:
    """Registrations and promotions, (model, ts, action, stage), as numbered versions with their latest stage.

    ``action`` is register or promote; a promotion goes to the newest version before it.
    """
    w = Window.partitionBy("model").orderBy("ts", "action").rowsBetween(Window.unboundedPreceding, 0)
    x = events.withColumn("version", F.sum((F.col("action") == "register").cast("long")).over(w)).filter("version > 0")
    return x.groupBy("model", "version").agg(F.max_by("stage", F.struct("ts", F.col("action") == "promote")).alias("stage"), F.min("ts").alias("created"))
