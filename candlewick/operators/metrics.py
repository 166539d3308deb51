"""Performance metrics: aggregates over equity, returns and trades of each key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, div, finite, norm_cdf, over, running, unbiased_kurtosis, unbiased_skew

SORTINO_YEAR = 252 * 390
#: Changes smaller than this are rounding, not losses.
NOISE = 1e-9


def equity_returns(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Equity with its change, relative change and drawdown from the running peak."""
    w = over(*keys)
    x = equity.filter(finite(F.col("equity")))
    prev = F.lag("equity").over(w)
    return x.withColumns({"change": F.col("equity") - prev, "ret": div(F.col("equity"), prev) - 1, "drawdown": div(F.col("equity"), F.max("equity").over(running(*keys))) - 1})


def equity_metrics(equity: DataFrame, keys: list[str], start: float = 1000.0) -> DataFrame:
    """Final equity, gain, Sortino ratio (population deviation of at least two losses), worst drawdown, profit factor."""
    x = equity_returns(equity, keys)
    loss = F.when(F.col("ret") < -NOISE, F.col("ret"))
    agg = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), F.max_by("equity", "ts").alias("final_equity"), F.avg("ret").alias("_mean"), F.stddev_pop(loss).alias("_down"), F.count(loss).alias("_nl"),
        (100 * F.min("drawdown")).alias("max_drawdown_pct"), F.coalesce(F.sum(F.when(F.col("change") > 0, F.col("change"))), F.lit(0.0)).alias("_win"), F.coalesce(-F.sum(F.when(F.col("change") < 0, F.col("change"))), F.lit(0.0)).alias("_lose"),
    )
    sortino = F.when((F.col("_nl") >= 2) & (F.col("_down") > 0), F.col("_mean") / F.col("_down") * math.sqrt(SORTINO_YEAR)).otherwise(0.0)
    factor = F.when(F.col("_lose") > 0, F.col("_win") / F.col("_lose")).when(F.col("_win") > 0, F.col("_win") * 1000).otherwise(1.0)
    return agg.select(*keys, "n_bars", "final_equity", (100 * (F.col("final_equity") / start - 1)).alias("gain_pct"), sortino.alias("sortino"), "max_drawdown_pct", factor.alias("profit_factor"))


def sharpe(equity: DataFrame, keys: list[str], year: float = 252.0) -> DataFrame:
    """Sharpe ratio of equity changes, within -5 and 10; 0 without deviation."""
    x = equity_returns(equity, keys).groupBy(*keys).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    return x.select(*keys, F.when(F.col("s") > 0, clip(F.col("m") / F.col("s") * math.sqrt(year), -5.0, 10.0)).otherwise(0.0).alias("sharpe"))


def trade_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Number of trades, share of winners, mean result."""
    return trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), F.avg((F.col("pct_change") > 0).cast("double")).alias("win_rate"), F.avg("pct_change").alias("avg_pct"))


def engine_metrics(equity: DataFrame, keys: list[str], year: float = 252.0) -> DataFrame:
    """Total return, yearly return (a year is ``year`` points of equity), volatility, Sharpe as yearly return by volatility (0 without
    any), worst drawdown.
    """
    x = equity_returns(equity, keys)
    a = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by("equity", "ts").alias("_a"), F.max_by("equity", "ts").alias("_b"), (F.stddev_samp("ret") * math.sqrt(year)).alias("volatility"), F.min("drawdown").alias("max_drawdown"))
    total = F.col("_b") / F.col("_a") - 1
    annual = F.when(F.col("_b") > 0, F.pow(F.col("_b") / F.col("_a"), year / F.col("n")) - 1)
    return a.select(*keys, total.alias("total_return"), annual.alias("annual_return"), "volatility", F.when(F.col("volatility") > 0, annual / F.col("volatility")).otherwise(0.0).alias("sharpe"), "max_drawdown")


def moments(returns: DataFrame, keys: list[str], x: str = "ret") -> DataFrame:
    """n, mean, deviation, and skewness and excess kurtosis corrected for bias."""
    r = returns.filter(finite(F.col(x)))
    a = r.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    n = F.col("n").cast("double")
    return a.select(*keys, "n", "mean", "sd", F.when(F.col("n") > 2, unbiased_skew(F.col("_g1"), n)).alias("skew"), F.when(F.col("n") > 3, unbiased_kurtosis(F.col("_g2"), n)).alias("kurt"))


def probabilistic_sharpe(m: DataFrame, keys: list[str], year: float = 252.0, benchmark: float = 0.0, trades: str | None = None) -> DataFrame:
    """Adds sharpe (yearly, within 10) and psr to ``moments``: 0.5 below 30 observations, few trades shrink the sample.

    Without deviation psr is 0.95 for a gain, else 0.05. Where the moments give no positive variance the error is
    1 / sqrt(n - 1) with penalties for skewness and kurtosis. The score's z is within 2, 2.5 from 30 and 3 from 100.
    """
    n, c = F.col("n").cast("double"), F.col
    eff = F.when(c(trades) < n / 10, F.greatest(c(trades).cast("double"), F.lit(10.0))).otherwise(n) if trades else n
    # In stages, each a column of its own: written out in one expression the generated code would be too long to compile.
    x = m.withColumns({"_eff": eff, "_flat": c("sd") < 1e-12, "_skew": clip(c("skew"), -10.0, 10.0), "_kurt": clip(c("kurt"), -10.0, 50.0)})
    x = x.withColumns({"_s": c("mean") / F.when(~c("_flat"), c("sd")), "_df": F.greatest(c("_eff") - 1, F.lit(1.0))})
    x = x.withColumns({"sharpe": clip(c("_s") * math.sqrt(year), -10.0, 10.0), "_var": (1 - c("_skew") * c("_s") + (c("_kurt") - 1) / 4 * c("_s") * c("_s")) / c("_df") * year})
    fallback = (1 + F.least(F.lit(5.0), F.abs("_skew")) * 0.3) * (1 + F.least(F.lit(10.0), F.abs("_kurt")) * 0.15) * math.sqrt(year) / F.sqrt("_df")
    x = x.withColumns({"_se": F.when(c("_var") > 0, F.sqrt("_var")).otherwise(fallback), "_bound": F.when(c("_eff") < 30, 2.0).when(c("_eff") < 100, 2.5).otherwise(3.0)})
    x = x.withColumn("_z", (c("sharpe") - benchmark) / F.when(c("_se") < 1e-10, 0.2).otherwise(c("_se")))
    x = x.withColumn("_z", F.least(F.greatest(c("_z"), -c("_bound")), c("_bound")))
    psr = F.when((n < 30) | c("sd").isNull(), 0.5).when(c("_flat"), F.when(c("mean") > 0, 0.95).otherwise(0.05)).otherwise(clip(norm_cdf(c("_z")), 0.001, 0.999))
    return x.withColumn("psr", psr).select(*m.columns, "sharpe", "psr")


def trade_multiplier(trades: Column, phase: str) -> Column:
    """Weight of a score by trade count: t / 30 in the cycle phase, (t - 10) / 20 in the RSI phase, 0 below 10, 1 from 30."""
    slope = trades / 30.0 if phase == "cycle" else (trades - 10) / 20.0
    return F.when(trades < 10, 0.0).when(trades >= 30, 1.0).otherwise(slope)


def overfit(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Overfit score from the Sharpe ratios of both halves, a period each: 0.5 below 20 observations."""
    w = over(*keys)
    x = returns.filter(finite(F.col("ret"))).withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    half = lambda cond: F.avg(F.when(cond, F.col("ret"))) / (F.stddev_samp(F.when(cond, F.col("ret"))) + 1e-10)
    a = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), half(first).alias("s1"), half(~first).alias("s2"))
    score = (
        F.when(F.col("n") < 20, 0.5).when((F.col("s1") <= 0) & (F.col("s2") <= 0), 0.9).when((F.col("s1") > 1) & (F.col("s2") < 0), 0.8)
        .when(F.col("s1") > 3 * F.col("s2"), 0.7).when(F.col("s1") > 1.5 * F.col("s2"), 0.5).when(F.col("s2") > F.col("s1"), 0.2)
        .when(F.abs(F.col("s1") - F.col("s2")) < 0.2, 0.3).otherwise(0.4)
    )
    return a.select(*keys, "s1", "s2", score.alias("pbo"))


def turnover(trades: Column, days: Column, size: float = 1.0) -> Column:
    """Yearly turnover: two sides a trade."""
    return F.when(days > 0, trades * 2 * size * 252 / days).otherwise(0.0)


def composite(psr: Column, pbo: Column, turn: Column, drawdown: Column, trades: Column, most_turnover: float = 200.0, most_drawdown: float = 0.5, min_trades: int = 20) -> Column:
    """0.70 psr - 0.20 pbo - 0.05 turnover - 0.05 drawdown - 0.3 for missing trades, within -1 and 1.

    Turnover counts from ``most_turnover`` on, in units of 200.
    """
    penalty = F.when(trades < min_trades, 1 - trades / min_trades).otherwise(0.0)
    over_ = F.when(turn < most_turnover, 0.0).otherwise(clip((turn - most_turnover) / 200.0, 0.0, 1.0))
    return clip(0.70 * psr - 0.20 * pbo - 0.05 * over_ - 0.05 * clip(F.abs(drawdown) / most_drawdown, 0.0, 1.0) - 0.3 * penalty, -1.0, 1.0)


def episodes(equity: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """Drawdown episodes, stretches of bars more than ``least`` below the peak: start, depth, length in bars, bars from the first deepest
    one to the end of the stretch (of the series, if it is open).
    """
    w, run = over(*keys), running(*keys)
    x = equity_returns(equity, keys).withColumn("_i", F.row_number().over(w)).withColumn("_under", F.col("drawdown") < -least)
    x = x.withColumn("_start", F.col("_under") & ~F.coalesce(F.lag("_under").over(w), F.lit(False))).withColumn("episode", F.sum(F.col("_start").cast("long")).over(run))
    e = x.filter("_under").groupBy(*keys, "episode").agg(F.min("ts").alias("start_ts"), F.min("drawdown").alias("depth"), F.min_by("_i", F.struct("drawdown", "_i")).alias("_trough"), F.max("_i").alias("_end"), F.count(F.lit(1)).alias("length"))
    return e.select(*keys, "episode", "start_ts", "depth", "length", (F.col("_end") + 1 - F.col("_trough")).cast("long").alias("recovery"))


#: Retracement zones of a drawdown (fixed values), as [low, high).
ZONES = ((0.0, 0.05), (0.05, 0.15), (0.15, 0.30), (0.30, 0.50), (0.50, 1.0000001))


def zone(drawdown: Column) -> Column:
    """Number of the zone that a drawdown (negative or 0) lies in, 1 to 5."""
    d, out = F.abs(drawdown), F.lit(None).cast("int")
    for k, (a, b) in enumerate(ZONES, 1):
        out = F.when((d >= a) & (d < b), k).otherwise(out)
    return out


def monitoring(equity: DataFrame, keys: list[str], trade_log: DataFrame | None = None, year: float = 252.0) -> DataFrame:
    """Metrics as rows (name, value): return, Sharpe, Sortino (sample deviation), worst drawdown, volatility; with trades
    also win rate, number of trades and mean result in money. Ratios without deviation are 0.
    """
    x = equity_returns(equity, keys)
    loss = F.when(F.col("ret") < -NOISE, F.col("ret"))
    ratio = lambda d: F.coalesce(div(F.avg("ret"), d) * math.sqrt(year), F.lit(0.0))
    a = x.groupBy(*keys).agg(
        (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"), ratio(F.stddev_samp("ret")).alias("sharpe"),
        ratio(F.stddev_samp(loss)).alias("sortino"), F.min("drawdown").alias("max_drawdown"), (F.stddev_samp("ret") * math.sqrt(year)).alias("volatility"),
    )
    names = ["total_return", "sharpe", "sortino", "max_drawdown", "volatility"]
    if trade_log is not None:
        pnl = F.col("equity_after") - F.col("equity_before")
        t = trade_log.groupBy(*keys).agg(F.avg((pnl > 0).cast("double")).alias("win_rate"), F.count(F.lit(1)).cast("double").alias("num_trades"), F.avg(pnl).alias("avg_trade_pnl"))
        a, names = a.join(t, keys, "left"), [*names, "win_rate", "num_trades", "avg_trade_pnl"]
    return a.unpivot(keys, names, "name", "value")


def deploy(results: DataFrame, least: float = 1.0) -> DataFrame:
    """Strategies with enough Sharpe, and a position limit scaled by drawdown."""
    limit = F.greatest(F.lit(10000.0), 100000 * 0.05 / F.greatest(F.abs("max_drawdown"), F.lit(0.01)))
    return results.filter(F.col("sharpe") >= least).withColumn("position_limit", limit)


def daily_summary(results: DataFrame, least: float = 1.0) -> DataFrame:
    """Every strategy with its rank by Sharpe ratio, whether it is deployed and its position limit, and totals over all.

    ``results`` is a row a strategy, so one window over all of it is small.
    """
    all_ = Window.partitionBy(F.lit(0))
    on = F.col("sharpe") >= least
    x = deploy(results, float("-inf")).withColumns({"deployed": on, "rank": F.rank().over(all_.orderBy(F.desc(F.round("sharpe", 6))))})
    return x.withColumns({"n_deployed": F.count_if("deployed").over(all_), "mean_sharpe": F.avg("sharpe").over(all_), "best_sharpe": F.max("sharpe").over(all_)})
