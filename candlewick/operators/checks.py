"""Data-quality suite: one pass of windows, one aggregate a series, one row a check; and corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div, over

PRICES = ("open", "high", "low", "close")
#: Longest gap between bars in seconds, by timeframe (fixed values): three days for daily bars, else twice the step.
GAP_LIMIT = {"daily": 3 * 86400, "hourly": 7200, "5min": 600, "1min": 120}


def suite(bars: DataFrame, universe: DataFrame | None = None, seq: str = "ts") -> DataFrame:
    """(symbol, tf, check_name, passed, severity, n, detail): n is the number of offending rows.

    ``detail``: per cent of nulls, the largest move, the largest unexpected gap in seconds and the largest z of a return; else NULL.

    With a universe of (symbol, tf), series without any bar appear and fail not_empty.
    """
    w = over("symbol", "tf")
    by_arrival = Window.partitionBy("symbol", "tf").orderBy(seq)
    x = bars.withColumns({
        "_ret": div(F.col("close"), F.lag("close").over(w)) - 1, "_gap": F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)),
        "_back": F.coalesce(F.col("ts") < F.lag("ts").over(by_arrival), F.lit(False)), "_dup": F.count(F.lit(1)).over(Window.partitionBy("symbol", "tf", "ts")),
    })
    whole = Window.partitionBy("symbol", "tf")
    x = x.withColumns({"_mean": F.avg("_ret").over(whole), "_sd": F.stddev_samp("_ret").over(whole), "_n": F.count(F.lit(1)).over(whole)})
    limit = F.create_map(*(F.lit(v) for kv in GAP_LIMIT.items() for v in kv))[F.col("tf")]
    zoned = dict(bars.dtypes)["ts"] == "timestamp"
    n_if = lambda cond: F.count_if(cond)
    tests = {
        "index_sorted": ("critical", n_if(F.col("_back"))),
        "no_duplicate_timestamps": ("error", F.count(F.lit(1)) - F.count_distinct("ts")),
        **{f"no_nulls_{p}": ("critical", n_if(F.col(p).isNull())) for p in (*PRICES, "volume")},
        **{f"positive_prices_{p}": ("critical", n_if(F.col(p) <= 0)) for p in PRICES},
        "no_extreme_moves_close": ("warning", n_if(F.abs("_ret") > 0.5)),
        "non_negative_volume": ("error", n_if(F.col("volume") < 0)),
        "sufficient_volume": ("warning", F.when(n_if(F.col("volume") == 0) >= 0.05 * F.count(F.lit(1)), n_if(F.col("volume") == 0)).otherwise(F.lit(0))),
        "no_unexpected_gaps": ("warning", n_if(F.col("_gap") > limit)),
        "has_timezone": ("warning", F.lit(0 if zoned else 1)),
        "high_gte_low": ("error", n_if(F.col("high") < F.col("low"))),
        "high_gte_open_close": ("error", n_if((F.col("high") < F.col("open")) | (F.col("high") < F.col("close")))),
        "low_lte_open_close": ("error", n_if((F.col("low") > F.col("open")) | (F.col("low") > F.col("close")))),
        "no_statistical_outliers": ("warning", n_if((F.col("_n") >= 30) & (F.abs(F.col("_ret") - F.col("_mean")) > 5 * F.col("_sd")))),
    }
    share = lambda p: 100 * F.count_if(F.col(p).isNull()) / F.count(F.lit(1))
    details = {f"no_nulls_{p}": share(p) for p in (*PRICES, "volume")} | {"no_extreme_moves_close": F.max(F.abs("_ret")), "no_unexpected_gaps": F.max(F.when(F.col("_gap") > limit, F.col("_gap"))).cast("double"), "no_statistical_outliers": F.max(F.when(F.col("_n") >= 30, div(F.abs(F.col("_ret") - F.col("_mean")), F.col("_sd"))))}
    wide = x.groupBy("symbol", "tf").agg(*(v.cast("long").alias(k) for k, (_, v) in tests.items()), *(v.alias(f"{k}_") for k, v in details.items()))
    if universe is not None:
        wide = universe.select("symbol", "tf").distinct().join(wide.withColumn("_seen", F.lit(True)), ["symbol", "tf"], "left")
        empty = F.when(F.col("_seen").isNull(), 1).otherwise(0)
    else:
        empty = F.lit(0)
    rows = [F.struct(F.lit("not_empty").alias("check_name"), F.lit("critical").alias("severity"), empty.cast("long").alias("n"), F.lit(None).cast("double").alias("detail"))]
    rows += [F.struct(F.lit(k).alias("check_name"), F.lit(s).alias("severity"), F.col(k).alias("n"), (F.col(f"{k}_") if k in details else F.lit(None).cast("double")).alias("detail")) for k, (s, _) in tests.items()]
    long = wide.select("symbol", "tf", F.explode(F.array(*rows)).alias("c")).filter(F.col("c.n").isNotNull())
    return long.select("symbol", "tf", "c.check_name", (F.col("c.n") == 0).alias("passed"), "c.severity", "c.n", "c.detail")


def summary(results: DataFrame) -> DataFrame:
    """Failures by severity of each series, whether any is critical, and a JSON report."""
    fails = lambda s: F.count_if(~F.col("passed") & (F.col("severity") == s))
    out = results.groupBy("symbol", "tf").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), fails("critical").alias("critical"), fails("error").alias("error"), fails("warning").alias("warning"))
    out = out.withColumn("has_critical", F.col("critical") > 0)
    return out.withColumn("report", F.to_json(F.struct("total", "passed", "critical", "error", "warning")))


def full_report(results: DataFrame) -> DataFrame:
    """A row for each series: the totals of ``summary`` and the list of its checks, in the order of their names."""
    check = F.struct("check_name", "passed", "severity", "n", "detail")
    return summary(results).drop("report").join(results.groupBy("symbol", "tf").agg(F.sort_array(F.collect_list(check)).alias("checks")), ["symbol", "tf"])


def adjust_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars before a split: prices by the product of later ratios, volume times it. ``splits``: (symbol, date, ratio)."""
    events = splits.filter(F.col("ratio") > 0).groupBy("symbol", F.col("date").cast("timestamp").alias("ts")).agg(F.product("ratio").alias("_r"))
    both = bars.withColumn("_r", F.lit(1.0)).withColumn("_bar", F.lit(True)).unionByName(events.withColumn("_bar", F.lit(False)), allowMissingColumns=True)
    # Splits of a bar's own day do not change it: rows of one day stand with the split first.
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, -1)
    factor = F.coalesce(F.product("_r").over(w), F.lit(1.0))
    adjusted = both.withColumn("_f", factor).filter("_bar")
    return adjusted.select(*((F.col(c) / F.col("_f")).alias(c) if c in PRICES else (F.col(c) * F.col("_f")).alias(c) if c == "volume" else F.col(c) for c in bars.columns))


def adjust_dividends(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """Prices before an ex-date times 1 - amount / close of that day; ex-dates that are no bar are left out."""
    d = dividends.groupBy("symbol", F.col("ex_date").cast("timestamp").alias("ts")).agg(F.sum("amount").alias("_a"))
    x = bars.join(d, ["symbol", "ts"], "left").withColumn("_k", F.coalesce(1 - div(F.col("_a"), F.col("close")), F.lit(1.0)))
    later = Window.partitionBy("symbol", "tf").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_f", F.coalesce(F.product("_k").over(later), F.lit(1.0)))
    return x.select(*((F.col(c) * F.col("_f")).alias(c) if c in PRICES else F.col(c) for c in bars.columns))
