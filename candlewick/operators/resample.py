"""Resampling tests. Draws come from integer arithmetic on (seed, simulation, slot): repeatable anywhere."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import PRIME, div, draw, norm_cdf, running, unbiased_kurtosis, unbiased_skew

START = 1000.0


def numbered(x: DataFrame, value: str, order: str) -> DataFrame:
    """(symbol, idx from 0, n, x): the observations of each symbol in order."""
    w = Window.partitionBy("symbol")
    y = x.filter(F.col(value).isNotNull())
    return y.select("symbol", (F.row_number().over(w.orderBy(order)) - 1).alias("idx"), F.count(F.lit(1)).over(w).cast("long").alias("n"), F.col(value).alias("x"))


def slots(base: DataFrame, sims: int) -> DataFrame:
    """(symbol, n, sim, slot): the places to fill, made in the tasks from one row a symbol."""
    one = base.select("symbol", "n").distinct()
    return one.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long")))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))


def _fetch(picked: DataFrame, base: DataFrame) -> DataFrame:
    return picked.join(base.select("symbol", "idx", "x"), ["symbol", "idx"]).select("symbol", "sim", "slot", "x")


def bootstrap(base: DataFrame, sims: int, seed: int = 7) -> DataFrame:
    """Independent draws."""
    return _fetch(slots(base, sims).withColumn("idx", F.pmod(draw(seed, F.col("sim"), F.col("slot")), F.col("n")).cast("int")), base)


def block_bootstrap(base: DataFrame, sims: int, block: int | Column = 5, seed: int = 7) -> DataFrame:
    """Overlapping blocks of a fixed length, which may be an expression of n."""
    size = block if isinstance(block, Column) else F.lit(block)
    start = F.pmod(draw(seed, F.col("sim"), F.floor(F.col("slot") / size)), F.greatest(F.col("n") - size + 1, F.lit(1)))
    return _fetch(slots(base, sims).withColumn("idx", F.least(start + F.pmod(F.col("slot"), size), F.col("n") - 1).cast("int")), base)


def stationary_picks(base: DataFrame, sims: int, mean: int = 10, seed: int = 7) -> DataFrame:
    """Blocks of geometric length that wrap around: each slot's source row."""
    d = draw(seed, F.col("sim"), F.col("slot"))
    x = slots(base, sims).withColumns({"_d": d, "_new": (F.col("slot") == 0) | (F.pmod(draw(seed + 1, F.col("sim"), F.col("slot")), F.lit(mean).cast("long")) == 0)})
    w = running("symbol", "sim", order="slot")
    x = x.withColumns({"_at": F.max(F.when(F.col("_new"), F.col("slot"))).over(w), "_start": F.last(F.when(F.col("_new"), F.pmod(F.col("_d"), F.col("n"))), ignorenulls=True).over(w)})
    return x.select("symbol", "n", "sim", "slot", F.pmod(F.col("_start") + F.col("slot") - F.col("_at"), F.col("n")).cast("int").alias("idx"))


def stationary_bootstrap(base: DataFrame, sims: int, mean: int = 10, seed: int = 7) -> DataFrame:
    return _fetch(stationary_picks(base, sims, mean, seed), base)


def permutation(base: DataFrame, sims: int, seed: int = 7) -> DataFrame:
    """All observations in a random order: the rank of a draw."""
    x = slots(base, sims).withColumn("_d", draw(seed, F.col("sim"), F.col("slot")))
    w = Window.partitionBy("symbol", "sim").orderBy("_d", "slot")
    return _fetch(x.select("symbol", "sim", "slot", (F.row_number().over(w) - 1).alias("idx")), base)


def sign_flip(base: DataFrame, sims: int, seed: int = 7) -> DataFrame:
    """Observations with random signs."""
    x = slots(base, sims).withColumn("idx", F.col("slot").cast("int"))
    y = x.join(base.select("symbol", "idx", "x"), ["symbol", "idx"])
    return y.select("symbol", "sim", "slot", F.when(F.pmod(draw(seed, F.col("sim"), F.col("slot")), F.lit(2).cast("long")) == 0, F.col("x")).otherwise(-F.col("x")).alias("x"))


def normal(base: DataFrame, sims: int, seed: int = 7) -> DataFrame:
    """Normal draws with each symbol's mean and population deviation (Box and Muller)."""
    m = base.groupBy("symbol").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    u = lambda k: (draw(seed + k, F.col("sim"), F.col("slot")) + 1) / float(PRIME + 1)
    z = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * math.pi * u(1))
    return slots(base, sims).join(m, "symbol").select("symbol", "sim", "slot", (F.col("_m") + F.coalesce("_s", F.lit(0.0)) * z).alias("x"))


def compare_methods(base: DataFrame, sims: int, start: float = START, ruin: float = 500.0) -> DataFrame:
    """Per symbol and method of simulation: chances of profit, of more than the original and of ruin, the middle 95 per cent of final
    equities, and whether the original lies there.

    Results in a random order, drawn with replacement, normal, and in blocks of a tenth of them (two at least). A final equity does
    not hang on the order, so it is one sum; equities within 1e-9 of each other are the same.
    """
    final = (start * F.exp(F.sum(F.ln(F.greatest(1 + F.col("x") / 100, F.lit(1e-9))))))
    drawn = {
        "randomization": permutation(base, sims), "bootstrap": bootstrap(base, sims), "parametric": normal(base, sims),
        "block": block_bootstrap(base, sims, F.greatest(F.lit(2).cast("long"), F.floor(F.col("n") / 10))),
    }
    all_ = None
    for name, x in drawn.items():
        one = x.groupBy("symbol", "sim").agg(final.alias("e")).withColumn("method", F.lit(name))
        all_ = one if all_ is None else all_.unionByName(one)
    share = lambda cond: F.avg(cond.cast("double"))
    e, near = F.col("e"), 1e-9
    out = all_.join(base.groupBy("symbol").agg(final.alias("original")), "symbol").groupBy("symbol", "method").agg(
        F.count(F.lit(1)).alias("n_sims"), share(e > start).alias("p_profit"), share(e > F.col("original") * (1 + near)).alias("p_beats"), share(e < ruin).alias("p_ruin"),
        F.percentile("e", 0.025).alias("low"), F.percentile("e", 0.975).alias("high"), F.first("original").alias("original"),
    )
    return out.withColumn("inside", (F.col("original") >= F.col("low") * (1 - near)) & (F.col("original") <= F.col("high") * (1 + near)))


def path_metrics(sims: DataFrame, start: float = START, parts: bool = False) -> DataFrame:
    """Per simulation of per-cent results: final equity, worst drawdown, mean, Sharpe, Sortino, Omega, Calmar, win rate.

    With ``parts`` also the deviation of losses, and the sums of gains and losses.
    """
    w = running("symbol", "sim", order="slot")
    f = F.greatest(1 + F.col("x") / 100, F.lit(1e-9))
    p = sims.withColumn("equity", start * F.exp(F.sum(F.ln(f)).over(w))).withColumn("_dd", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(start)) - 1)
    loss, gain = F.when(F.col("x") < 0, F.col("x")), F.when(F.col("x") > 0, F.col("x"))
    a = p.groupBy("symbol", "sim").agg(
        F.max_by("equity", "slot").alias("final_equity"), (100 * F.min("_dd")).alias("max_drawdown"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.stddev_samp(loss).alias("_down"),
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("_g"), F.coalesce(-F.sum(loss), F.lit(0.0)).alias("_l"), F.avg((F.col("x") > 0).cast("double")).alias("win_rate"), F.max("equity").alias("_hi"), F.min("equity").alias("_lo"),
    )
    more = [F.col("_down").alias("down"), F.col("_g").alias("gains"), F.col("_l").alias("losses")] if parts else []
    return a.select("symbol", "sim", "final_equity", "max_drawdown", "mean", "sd", *more, div(F.col("mean"), F.col("sd")).alias("sharpe"), div(F.col("mean"), F.col("_down")).alias("sortino"), div(F.col("_g"), F.col("_l")).alias("omega"), div(100 * (F.col("final_equity") / start - 1), F.abs("max_drawdown")).alias("calmar"), "win_rate", (F.col("_hi") - F.col("_lo")).alias("range"))


def distribution(paths: DataFrame, start: float = START) -> DataFrame:
    """Per symbol over simulations: spread of final equity, chance of profit and ruin, value at risk, drawdowns."""
    r = 100 * (F.col("final_equity") / start - 1)
    q = lambda c, p: F.percentile(c, p)
    x = paths.withColumn("_r", r)
    v = x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_sims"), F.avg("final_equity").alias("mean"), q("final_equity", 0.5).alias("median"), q("final_equity", 0.05).alias("p5"), q("final_equity", 0.95).alias("p95"), F.stddev_pop("final_equity").alias("std"),
        F.min("final_equity").alias("min"), F.max("final_equity").alias("max"), F.avg((F.col("final_equity") > start).cast("double")).alias("p_profit"), F.avg((F.col("final_equity") < 500).cast("double")).alias("p_ruin"),
        q("_r", 0.05).alias("var_95"), q("_r", 0.01).alias("var_99"), F.avg("max_drawdown").alias("dd_mean"), q("max_drawdown", 0.5).alias("dd_median"), q("max_drawdown", 0.05).alias("dd_p95"), q("max_drawdown", 0.01).alias("dd_p99"),
        F.avg("sharpe").alias("sharpe_mean"), F.avg("win_rate").alias("win_rate_mean"), F.stddev_pop("win_rate").alias("win_rate_std"),
    )
    tails = x.join(v.select("symbol", "var_95", "var_99"), "symbol").groupBy("symbol").agg(F.avg(F.when(F.col("_r") <= F.col("var_95") * (1 + 1e-12 * F.signum("var_95")), F.col("_r"))).alias("cvar_95"), F.avg(F.when(F.col("_r") <= F.col("var_99") * (1 + 1e-12 * F.signum("var_99")), F.col("_r"))).alias("cvar_99"))
    return v.join(tails, "symbol")


def spells(sims: DataFrame, start: float = START, least: float = 0.01) -> DataFrame:
    """(symbol, sim, spell, length, recovery): stretches of a path more than ``least`` below its peak, in steps, and the
    steps from the deepest one to the end.
    """
    w = running("symbol", "sim", order="slot")
    p = sims.withColumn("_e", start * F.exp(F.sum(F.ln(F.greatest(1 + F.col("x") / 100, F.lit(1e-9)))).over(w)))
    p = p.withColumn("_dd", F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(start)) - 1).withColumn("_u", F.col("_dd") < -least)
    before = F.coalesce(F.lag("_u").over(Window.partitionBy("symbol", "sim").orderBy("slot")), F.lit(False))
    p = p.withColumn("_st", (F.col("_u") & ~before).cast("long")).withColumn("spell", F.sum("_st").over(w)).filter("_u")
    return p.groupBy("symbol", "sim", "spell").agg(F.count(F.lit(1)).alias("length"), (F.max("slot") + 1 - F.min_by("slot", F.struct("_dd", "slot"))).alias("recovery"))


def analysis(sims: DataFrame, base: DataFrame, start: float = START, year: float = 252.0) -> DataFrame:
    """Per symbol over simulations: Sharpe, Sortino and Calmar ratios, Omega, drawdown spells, path dependency (spread of
    final equities against twice the original's, 1 at most), order sensitivity, tail ratio, gain to pain, win rates.

    Sharpe and Sortino ratios are yearly, within -5 and 10, and left out where there is no deviation. The Calmar ratio c
    is averaged as ln(1 + c), as growth is unbounded.
    """
    p = path_metrics(sims, start, parts=True)
    ratio = lambda d: F.when(F.col(d) > 0, F.least(F.greatest(F.col("mean") / F.col(d) * math.sqrt(year), F.lit(-5.0)), F.lit(10.0)))
    calmar = F.when(F.col("max_drawdown") < 0, F.ln(1 + F.greatest(F.col("calmar"), F.lit(-0.999))))
    p = p.withColumns({"sh": ratio("sd"), "so": ratio("down"), "ca": calmar})
    q = F.percentile
    a = p.groupBy("symbol").agg(
        F.avg("sh").alias("sharpe_mean"), q("sh", 0.5).alias("sharpe_median"), F.stddev_pop("sh").alias("sharpe_std"), q("sh", 0.05).alias("sharpe_p5"), q("sh", 0.95).alias("sharpe_p95"), F.avg("so").alias("sortino_mean"), F.stddev_pop("so").alias("sortino_std"),
        F.avg("ca").alias("calmar_mean"), q("ca", 0.5).alias("calmar_median"), F.try_divide(F.sum("gains"), F.sum("losses")).alias("omega"), (F.max("final_equity") - F.min("final_equity")).alias("_range"), (F.stddev_pop("final_equity") / F.avg("final_equity")).alias("order_sensitivity"),
        F.abs(F.try_divide(q("final_equity", 0.95) / start - 1, q("final_equity", 0.05) / start - 1)).alias("tail_ratio"), F.avg("win_rate").alias("win_rate_mean"), F.stddev_pop("win_rate").alias("win_rate_std"),
    )
    s = spells(sims, start).groupBy("symbol").agg((F.sum("length") / F.count(F.lit(1))).alias("dd_duration"), (F.sum("recovery") / F.count(F.lit(1))).alias("recovery"))
    original = base.groupBy("symbol").agg((start * F.exp(F.sum(F.ln(F.greatest(1 + F.col("x") / 100, F.lit(1e-9)))))).alias("_o"))
    out = a.join(s, "symbol", "left").join(original, "symbol")
    return out.withColumns({"path_dependency": F.least(F.col("_range") / F.col("_o") / 2, F.lit(1.0)), "gain_to_pain": F.col("omega")}).drop("_range", "_o")


def bands(sims: DataFrame, start: float = START) -> DataFrame:
    """Per step over simulations: median, 5 and 95 per cent of equity."""
    w = running("symbol", "sim", order="slot")
    p = sims.withColumn("equity", start * F.exp(F.sum(F.ln(F.greatest(1 + F.col("x") / 100, F.lit(1e-9)))).over(w)))
    return p.groupBy("symbol", F.col("slot").alias("step")).agg(F.percentile("equity", 0.5).alias("median"), F.percentile("equity", 0.05).alias("p5"), F.percentile("equity", 0.95).alias("p95"))


def shape(base: DataFrame) -> DataFrame:
    """Corrected skewness and kurtosis, and z and p of D'Agostino's and Anscombe's tests; zeros (and p 1) below 8 observations."""
    a = base.groupBy("symbol").agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    u = y / F.sqrt(2 / (w2 - 1))
    zs = F.ln(u + F.sqrt(u * u + 1)) / F.sqrt(0.5 * F.ln(w2))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a_ = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    t = (1 - 2 / a_) / (1 + x * F.sqrt(2 / (a_ - 4)))
    zk = (1 - 2 / (9 * a_) - F.signum(t) * F.pow(F.abs(t), F.lit(1 / 3))) / F.sqrt(2 / (9 * a_))
    few = (n < 8) | g1.isNull() | F.isnan(g1)
    p = lambda z: F.when(few, 1.0).otherwise(2 * (1 - norm_cdf(F.abs(z))))
    return a.select("symbol", F.when(few, 0.0).otherwise(unbiased_skew(g1, n)).alias("skew"), F.when(few, 0.0).otherwise(unbiased_kurtosis(g2, n)).alias("kurt"), F.when(few, 0.0).otherwise(zs).alias("z_skew"), F.when(few, 0.0).otherwise(zk).alias("z_kurt"), p(zs).alias("p_skew"), p(zk).alias("p_kurt"))


def draws(seed: int, sim: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """``draw`` of whole arrays, inside a task."""
    x = (np.int64(seed) * 1103515245 + sim.astype(np.int64) * 1664525 + slot.astype(np.int64) * 22695477) % PRIME
    y = (x * x + 12345) % PRIME
    return (y * y + x + 67891) % PRIME


def mean_intervals(values: DataFrame, columns: list[str], resamples: int = 1000, seed: int = 9, level: float = 0.95) -> DataFrame:
    """Per symbol the bootstrap interval of the mean of each column of ``values`` (symbol, sim, columns): <column>_low, <column>_high.

    A symbol's values (a row for each simulation, a bounded number) travel as one array, and 50 resamples of it are one row, so
    neither draws nor resamples times simulations are ever rows. One draw serves all columns; nulls are left out of the means.
    """
    step = 50
    one = values.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("sim", *columns))).alias("v"))
    one = one.select("symbol", *(F.col(f"v.{c}").alias(c) for c in columns), F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // step) - 1))).alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                table = np.array([getattr(row, c) for c in columns], float)
                r = np.arange(row.part * step, min((row.part + 1) * step, resamples))
                picked = table[:, draws(seed, r[:, None], np.arange(table.shape[1])[None, :]) % table.shape[1]]
                known = ~np.isnan(picked)
                with np.errstate(invalid="ignore"):
                    means = np.where(known, picked, 0.0).sum(axis=2) / known.sum(axis=2)
                yield pd.DataFrame({"symbol": row.symbol} | dict(zip(columns, means, strict=True)))

    means = one.mapInPandas(run, "symbol string, " + ", ".join(f"{c} double" for c in columns))
    ends = ((1 - level) / 2, "low"), ((1 + level) / 2, "high")
    return means.groupBy("symbol").agg(*(F.percentile(F.nanvl(c, F.lit(None)), q).alias(f"{c}_{e}") for c in columns for q, e in ends))


def user_statistic(base: DataFrame, statistic: Callable[[np.ndarray], float], sims: int, seed: int = 7) -> DataFrame:
    """(symbol, sim, value): a caller's statistic of each bootstrap sample of a symbol's observations.

    The samples are those of ``bootstrap``. A symbol's observations travel as one array with 50 simulations a row and are
    drawn from inside a task; the statistic gets one sample at a time.
    """
    step = 50
    one = base.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("v"))
    one = one.select("symbol", F.col("v.x").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(-(-sims // step) - 1))).alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                x = np.asarray(row.x, float)
                sim = np.arange(row.part * step, min((row.part + 1) * step, sims))
                picked = x[draws(seed, sim[:, None], np.arange(len(x))[None, :]) % len(x)]
                yield pd.DataFrame({"symbol": row.symbol, "sim": sim, "value": [float(statistic(p)) for p in picked]})

    return one.mapInPandas(run, "symbol string, sim long, value double")


def risk_grade(sharpe: Column, drawdown: Column, var95: Column, profit: Column, path: Column) -> tuple[Column, Column]:
    """Ten points and their class."""
    two = lambda hi, lo: F.when(hi, 2).when(lo, 1).otherwise(0)
    s = two(sharpe > 1, sharpe > 0.5) + two(drawdown < 20, drawdown < 35) + two(var95 > -10, var95 > -20) + two(profit > 0.7, profit > 0.5) + two(path < 0.3, path < 0.5)
    return s, F.when(s >= 8, "excellent").when(s >= 6, "good").when(s >= 4, "moderate").otherwise("poor")


def _t(mean: Column, deviation: Column) -> Column:
    """t of a mean of n observations; 0 without deviation."""
    return F.coalesce(div(mean, deviation) * F.sqrt("n"), F.lit(0.0))


def reality_check(base: DataFrame, sims: int, mean: int = 10, seed: int = 7) -> DataFrame:
    """Reality check of each strategy's mean: t, share of recentred bootstrap t at least as large, Bonferroni correction."""
    obs = base.groupBy("symbol").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    b = stationary_bootstrap(base, sims, mean, seed).groupBy("symbol", "sim").agg(F.avg("x").alias("bm"), F.stddev_samp("x").alias("bs"))
    y = b.join(obs, "symbol").withColumns({"t": _t(F.col("m"), F.col("s")), "bt": _t(F.col("bm") - F.col("m"), F.col("bs"))})
    k = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))  # one row a strategy
    p = y.groupBy("symbol").agg(F.first("t").alias("t"), F.avg((F.col("bt") >= F.col("t")).cast("double")).alias("p"))
    return p.withColumn("p_corrected", F.least(F.col("p") * k, F.lit(1.0)))


def superior_ability(base: DataFrame, sims: int, mean: int = 10, seed: int = 7) -> DataFrame:
    """Hansen's test: the best t of all strategies against the best bootstrap t, each by its sample's own deviation, with one draw for all of them."""
    obs = base.groupBy("symbol").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    top = obs.agg(F.max(_t(F.col("m"), F.col("s"))).alias("t"))
    b = stationary_bootstrap(base, sims, mean, seed).groupBy("symbol", "sim").agg(F.avg("x").alias("bm"), F.stddev_samp("x").alias("bs"))
    y = b.join(obs, "symbol").groupBy("sim").agg(F.max(_t(F.col("bm") - F.col("m"), F.col("bs"))).alias("bt"))
    return y.crossJoin(F.broadcast(top)).agg(F.max("t").alias("t"), F.avg((F.col("bt") >= F.col("t")).cast("double")).alias("p"), F.count(F.lit(1)).alias("n_sims"))  # one row


def verdict(significant: Column, tests: Column) -> Column:
    """What a suite of tests says: all of them significant, half at least, or fewer."""
    return F.when(significant == tests, "highly_robust").when(significant >= tests / 2, "moderately_robust").otherwise("not_robust")


def sharpe_interval(base: DataFrame, sims: int, block: int = 10, seed: int = 7, year: float = 252.0) -> DataFrame:
    """The yearly Sharpe ratio (0 without deviation) and its block-bootstrap interval."""
    ratio = F.coalesce(div(F.avg("x"), F.stddev_samp("x")) * math.sqrt(year), F.lit(0.0))
    b = block_bootstrap(base, sims, block, seed).groupBy("symbol", "sim").agg(ratio.alias("s"))
    ends = b.groupBy("symbol").agg(F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.5).alias("median"), F.percentile("s", 0.975).alias("high"))
    return base.groupBy("symbol").agg(ratio.alias("sharpe")).join(ends, "symbol")
