"""Market regimes: features, scores, labels, and all that follows from a table of labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, div, frame, over, roll, running

REGIMES = ("bull", "bear", "high_volatility", "low_volatility", "crisis")
#: Thresholds of the detector (fixed values).
VOL_LOW, VOL_HIGH, VOL_CRISIS, RET_BULL, RET_BEAR = 0.10, 0.25, 0.50, 0.15, -0.10
#: Base size of a position in each regime (fixed values).
BASE_SIZE = {"bull": 1.2, "bear": 0.5, "high_volatility": 0.6, "low_volatility": 1.0, "crisis": 0.2}
KEYS = ("symbol",)


def c(name: str) -> Column:
    return F.col(name)


def _last_sums(x: DataFrame, flag: str, value: str, out: str, n: int = 14) -> DataFrame:
    """Sum of ``value`` over the last n rows where ``flag`` holds.

    Running count k and sum P over flagged rows; the sum n flagged rows ago is the P at which k was k - n, which the
    same series holds once, so one equi join by (symbol, k) finds it.
    """
    w = running(*KEYS)
    x = x.withColumns({"_k": F.sum(c(flag).cast("long")).over(w), "_p": F.sum(F.when(c(flag), c(value)).otherwise(0.0)).over(w)})
    before = x.filter(c(flag)).select(*KEYS, (c("_k") + n).alias("_k"), c("_p").alias("_q"))
    return x.join(before, [*KEYS, "_k"], "left").withColumn(out, c("_p") - F.coalesce("_q", F.lit(0.0))).drop("_k", "_p", "_q")


def features(bars: DataFrame, vol: int = 20, fast: int = 50, slow: int = 200) -> DataFrame:
    """Regime features at every bar of (symbol, ts, close)."""
    w = over(*KEYS)
    x = bars.select("symbol", "ts", "close").withColumns({"ret": div(c("close"), F.lag("close").over(w)) - 1, "i": F.row_number().over(w), "peak": F.max("close").over(running(*KEYS))})
    x = x.withColumns({"drawdown": div(c("close"), c("peak")) - 1, "_up": F.coalesce(c("ret") > 0, F.lit(False)), "_down": F.coalesce(c("ret") < 0, F.lit(False)), "_lr": F.log1p(clip(c("ret"), -0.5, 2.0))})
    x = _last_sums(_last_sums(x, "_up", "ret", "_gain"), "_down", "ret", "_loss")
    short = frame(vol, *KEYS)
    ann = lambda n: F.when(F.count("_lr").over(frame(n, *KEYS)) == n, clip(F.exp(F.sum("_lr").over(frame(n, *KEYS)) * (252 / n)) - 1, -1.0, 10.0)).otherwise(0.0)
    x = x.withColumns({
        "realized_vol": F.when(F.count("ret").over(short) >= 5, F.stddev_samp("ret").over(short) * math.sqrt(252)).otherwise(0.0), "_sd": roll(F.stddev_samp, c("ret"), vol, *KEYS),
        "_fast": roll(F.avg, c("close"), fast, *KEYS), "_slow": roll(F.avg, c("close"), slow, *KEYS), "ret_20": ann(20), "ret_60": ann(60),
        "rsi": 100 - 100 / (1 + c("_gain") / (F.abs("_loss") + 1e-10)), "roc_20": F.when(c("i") >= 20, clip(div(c("close"), F.lag("close", 19).over(w)) - 1, -1.0, 10.0)).otherwise(0.0),
        "skew": F.when(F.count("ret").over(short) >= 10, F.coalesce(F.skewness("ret").over(short), F.lit(0.0))).otherwise(0.0), "kurt": F.when(F.count("ret").over(short) >= 10, F.coalesce(F.kurtosis("ret").over(short), F.lit(0.0))).otherwise(0.0),
        "max_drawdown_60": F.when(c("i") >= 60, F.min("drawdown").over(frame(60, *KEYS))).otherwise(0.0),
    })
    old = F.lag("_sd", vol).over(w)
    x = x.withColumns({
        "vol_trend": F.when(old > 1e-6, c("_sd") / old - 1).otherwise(0.0), "vs_fast": F.coalesce(div(c("close"), c("_fast")) - 1, F.lit(0.0)),
        "vs_slow": F.coalesce(div(c("close"), c("_slow")) - 1, F.lit(0.0)), "ma_trend": F.coalesce(div(c("_fast"), c("_slow")) - 1, F.lit(0.0)),
    })
    return x.drop("_up", "_down", "_lr", "_gain", "_loss", "_sd", "_fast", "_slow", "peak")


def _points(*rules: tuple[Column, int]) -> Column:
    return sum((F.when(cond, p).otherwise(0) for cond, p in rules[1:]), F.when(rules[0][0], rules[0][1]).otherwise(0))


def scores(x: DataFrame) -> DataFrame:
    """Probabilities of the five regimes from rule points; 0.2 each without any point."""
    v, r20, r60, ma, rsi, dd = (c(n) for n in ("realized_vol", "ret_20", "ret_60", "ma_trend", "rsi", "drawdown"))
    pts = {
        "bull": _points((v < VOL_LOW, 2), (r20 > RET_BULL, 3), (r60 > RET_BULL, 2), (ma > 0.05, 2), (rsi > 60, 1)),
        "bear": _points((v > VOL_LOW, 1), (r20 < RET_BEAR, 3), (r60 < RET_BEAR, 2), (ma < -0.05, 2), (rsi < 40, 1), (dd < -0.10, 2)),
        "high_volatility": _points((v > VOL_HIGH, 3), (F.abs(ma) < 0.03, 2), (F.abs(r20) < 0.10, 1), (c("vol_trend") > 0.5, 2)),
        "low_volatility": _points((v < VOL_LOW, 3), (F.abs(ma) < 0.02, 2), (F.abs(r20) < 0.05, 2), (rsi.between(40, 60), 1)),
        "crisis": _points((v > VOL_CRISIS, 4), (dd < -0.20, 3), (c("skew") < -1.0, 2), (r20 < -0.30, 3)),
    }
    x = x.withColumns({f"_{k}": p.cast("double") for k, p in pts.items()}).withColumn("_all", sum((c(f"_{k}") for k in REGIMES[1:]), c("_bull")))
    return x.withColumns({f"p_{k}": F.when(c("_all") > 0, c(f"_{k}") / c("_all")).otherwise(0.2) for k in REGIMES}).drop("_all", *(f"_{k}" for k in REGIMES))


def labels(x: DataFrame) -> DataFrame:
    """Label of the greatest probability (ties in the order of REGIMES) and confidence: 1 - entropy / ln 5."""
    x = x.withColumn("_top", F.greatest(*(c(f"p_{k}") for k in REGIMES)))
    label = F.lit(REGIMES[-1])
    for k in reversed(REGIMES[:-1]):
        label = F.when(c(f"p_{k}") == c("_top"), k).otherwise(label)
    ent = sum((F.when(c(f"p_{k}") > 0, c(f"p_{k}") * F.ln(f"p_{k}")).otherwise(0.0) for k in REGIMES[1:]), F.when(c("p_bull") > 0, c("p_bull") * F.ln("p_bull")).otherwise(0.0))
    return x.withColumns({"regime": label, "confidence": 1 + ent / math.log(5)}).drop("_top")


def durations(x: DataFrame, memory: int = 252) -> DataFrame:
    """Length so far of the current run of one label."""
    w = over(*KEYS)
    x = x.withColumn("_new", F.coalesce(c("regime") != F.lag("regime").over(w), F.lit(True))).withColumn("run", F.sum(c("_new").cast("long")).over(running(*KEYS)))
    return x.withColumn("duration", F.least(F.row_number().over(over(*KEYS, "run")), F.lit(memory)).cast("long")).drop("_new")


def next_regime(x: DataFrame, memory: int = 252) -> DataFrame:
    """Predicted next label and chance to stay, from the moves within the last ``memory`` labels; below 50: the same, 0.7."""
    w = over(*KEYS)
    x = x.withColumns({"_from": F.lag("regime").over(w), "_i": F.row_number().over(w)})
    # Counts within the memory are running counts less those of memory - 1 rows before.
    moves = {f"_{a}_{b}": F.sum(F.when((c("_from") == a) & (c("regime") == b), 1).otherwise(0)).over(running(*KEYS)) for a in REGIMES for b in REGIMES}
    x = x.withColumns(moves)
    x = x.withColumns({k: c(k) - F.coalesce(F.lag(k, memory - 1).over(w), F.lit(0)) for k in moves})
    best, stay = F.lit(None).cast("string"), F.lit(None).cast("double")
    for a in REGIMES:
        row = [c(f"_{a}_{b}") for b in REGIMES]
        total, top = sum(row[1:], row[0]), F.greatest(*row)
        name = F.lit(REGIMES[-1])
        for b in reversed(REGIMES[:-1]):
            name = F.when(c(f"_{a}_{b}") == top, b).otherwise(name)
        best = F.when(c("regime") == a, name).otherwise(best)
        stay = F.when(c("regime") == a, F.when(total > 0, c(f"_{a}_{a}") / total).otherwise(0.0)).otherwise(stay)
    few = c("_i") < 50
    return x.withColumns({"next_regime": F.when(few, c("regime")).otherwise(best), "stay": F.when(few, 0.7).otherwise(stay)}).drop("_from", "_i", *moves)


def stay_by_duration(duration: Column) -> Column:
    """The charting script's chance to stay."""
    return F.least(F.lit(0.95), 0.5 + duration / 100)


def position_size(regime: Column, confidence: Column, stay: Column) -> Column:
    base = F.create_map(*(F.lit(v) for kv in BASE_SIZE.items() for v in kv))[regime]
    sure = base * confidence + (1 - confidence)
    return clip(sure * stay + (1 - stay), 0.1, 2.0)


def display_score(confidence: Column, stay: Column, trend: Column, vol: Column) -> Column:
    """The charting script's score: confidence, chance to stay, and factors of trend and volatility, each to its power."""
    of_trend = F.when(trend > 0.05, 0.8).when(trend < -0.05, 0.3).otherwise(0.6)
    of_vol = F.when(vol < 0.10, 0.9).when(vol > 0.50, 0.2).otherwise(0.6)
    return F.pow(confidence, F.lit(0.3)) * F.pow(stay, F.lit(0.3)) * F.pow(of_trend, F.lit(0.2)) * F.pow(of_vol, F.lit(0.2))


def detect(bars: DataFrame) -> DataFrame:
    """Features, probabilities, label, confidence, duration, next label, chance to stay and size at every bar."""
    x = next_regime(durations(labels(scores(features(bars)))))
    return x.withColumn("size", position_size(c("regime"), c("confidence"), c("stay")))


def statistics(x: DataFrame, warm: int = 200) -> DataFrame:
    """Per symbol and each of the regimes: bars, yearly return, volatility, Sharpe (0 without volatility), worst drawdown inside it, win
    rate, mean length of ended runs in whole bars (0 if none ended); zeros for a regime that does not occur.

    Only bars after the first ``warm`` count, as before them the slow mean is not full; a symbol without such bars has zeros.
    """
    w = over(*KEYS, "regime").rowsBetween(Window.unboundedPreceding, 0)
    y = x.filter((c("i") > warm) & c("ret").isNotNull() & (c("ret") > -1)).withColumn("_v", F.exp(F.sum(F.ln(1 + c("ret"))).over(w)))
    y = y.withColumn("_dd", c("_v") / F.max("_v").over(w) - 1)
    a = y.groupBy(*KEYS, "regime").agg(F.count(F.lit(1)).alias("n"), (F.avg("ret") * 252).alias("ann_return"), (F.stddev_samp("ret") * math.sqrt(252)).alias("ann_vol"), F.min("_dd").alias("max_drawdown"), F.avg((c("ret") > 0).cast("double")).alias("win_rate"))
    runs = x.groupBy(*KEYS, "run", "regime").agg(F.count_if(c("i") > warm).alias("len")).withColumn("_last", c("run") == F.max("run").over(Window.partitionBy(*KEYS)))
    mean = {k: F.floor(F.avg(F.when((c("regime") == k) & (c("len") > 0) & ~c("_last"), c("len")))) for k in REGIMES}
    every = runs.groupBy(*KEYS).agg(F.array(*(F.struct(F.lit(k).alias("regime"), F.coalesce(m, F.lit(0)).alias("avg_duration")) for k, m in mean.items())).alias("_r")).select(*KEYS, F.inline("_r"))
    none = c("n").isNull()
    z = every.alias("e").join(a.alias("a"), (c("e.symbol").eqNullSafe(c("a.symbol"))) & (c("e.regime") == c("a.regime")), "left")
    z = z.select("e.*", F.coalesce("n", F.lit(0)).alias("n"), *(F.when(none, 0.0).otherwise(c(k)).alias(k) for k in ("ann_return", "ann_vol", "max_drawdown", "win_rate")))
    sharpe = F.when(c("ann_vol") > 0, c("ann_return") / c("ann_vol")).otherwise(0.0)
    return z.select(*KEYS, "regime", "n", "ann_return", "ann_vol", "max_drawdown", "win_rate", "avg_duration", sharpe.alias("sharpe"))


def transitions(x: DataFrame) -> DataFrame:
    """(symbol, from_regime, to_regime, n, p): moves of the whole sequence."""
    w = over(*KEYS)
    y = x.withColumn("to_regime", F.lead("regime").over(w)).filter(c("to_regime").isNotNull()).groupBy(*KEYS, c("regime").alias("from_regime"), "to_regime").agg(F.count(F.lit(1)).alias("n"))
    return y.withColumn("p", c("n") / F.sum("n").over(Window.partitionBy(*KEYS, "from_regime")))


def half_life(x: DataFrame) -> DataFrame:
    """Median run length of each regime."""
    return x.groupBy(*KEYS, "regime", "run").agg(F.count(F.lit(1)).alias("len")).groupBy(*KEYS, "regime").agg(F.percentile("len", 0.5).alias("half_life"))


def stability(x: DataFrame) -> DataFrame:
    """1 - 2 * changes / rows, at least 0."""
    y = x.withColumn("_c", (c("regime") != F.lag("regime").over(over(*KEYS))).cast("double"))
    return y.groupBy(*KEYS).agg(F.greatest(1 - 2 * F.coalesce(F.sum("_c"), F.lit(0.0)) / F.count(F.lit(1)), F.lit(0.0)).alias("stability"))


def changes(x: DataFrame, label: str) -> DataFrame:
    """(symbol, i): rows where the label changes."""
    w = over(*KEYS)
    return x.withColumns({"_i": F.row_number().over(w), "_c": c(label) != F.lag(label).over(w)}).filter("_c").select(*KEYS, c("_i").alias("i"))


def latency(x: DataFrame, true: str, detected: str, horizon: int = 10) -> DataFrame:
    """Mean bars from a true change to the first detected one, ``horizon`` where none comes within it; 0 without true changes."""
    both = changes(x, true).withColumn("found", F.lit(False)).unionByName(changes(x, detected).withColumn("found", F.lit(True)))
    # From the end of the series on: the last detected change seen is the next one after a row.
    back = Window.partitionBy("symbol").orderBy(F.desc("i"), F.desc("found")).rowsBetween(Window.unboundedPreceding, 0)
    lag = F.last(F.when(c("found"), c("i")), ignorenulls=True).over(back) - c("i")
    t = both.withColumn("lag", lag).filter(~c("found"))
    mean = t.groupBy("symbol").agg(F.avg(F.least(F.coalesce("lag", F.lit(horizon)), F.lit(horizon))).alias("latency"))
    return x.select("symbol").distinct().join(mean, "symbol", "left").fillna(0.0, ["latency"])


def transition_rates(x: DataFrame, true: str, detected: str, tolerance: int = 3) -> DataFrame:
    """Shares of detected changes near no true one and near one, and of true changes without a detected one near; 0 of nothing."""
    t, d = changes(x, true), changes(x, detected)
    # Rows are dealt to buckets as wide as the tolerance; a match is in the same or a neighbouring bucket.
    def reach(df: DataFrame) -> DataFrame:
        return df.select("symbol", c("i").alias("j"), F.explode(F.array(*(F.floor(c("i") / (tolerance + 1)) + k for k in (-1, 0, 1)))).alias("b"))

    def hit(a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.withColumn("b", F.floor(c("i") / (tolerance + 1)))
        m = left.join(reach(b), ["symbol", "b"]).filter(F.abs(c("i") - c("j")) <= tolerance).select("symbol", "i").distinct().withColumn("hit", F.lit(1))
        return a.join(m, ["symbol", "i"], "left").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("m"))

    td, dt = hit(t, d).select("symbol", c("n").alias("nt"), c("m").alias("mt")), hit(d, t)
    y = x.select("symbol").distinct().join(td, "symbol", "left").join(dt, "symbol", "left")
    return y.select("symbol", F.coalesce(1 - div(c("m"), c("n")), F.lit(0.0)).alias("false_rate"), F.coalesce(div(c("m"), c("n")), F.lit(0.0)).alias("true_rate"), F.coalesce(1 - div(c("mt"), c("nt")), F.lit(0.0)).alias("missed_rate"))


def purity(x: DataFrame) -> DataFrame:
    """How well each regime's mean return and volatility are what is expected of it, 0 to 1."""
    a = x.groupBy(*KEYS, "regime").agg(F.avg("ret").alias("m"), F.avg("realized_vol").alias("v"))
    v, m, r = c("v"), c("m"), c("regime")
    vol = (
        F.when(r == "low_volatility", F.when(v < 0.15, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (v - 0.15) / 0.15))).when(r == "bull", F.when(v < 0.3, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (v - 0.3) / 0.2)))
        .when(r == "bear", F.least(F.lit(1.0), v / 0.2)).when(r == "high_volatility", F.least(F.lit(1.0), v / 0.4)).otherwise(F.least(F.lit(1.0), v / 0.5))
    )
    sign = F.when(r == "bull", (m > 0).cast("double")).when(r.isin("bear", "crisis"), (m < 0).cast("double"))
    return a.select(*KEYS, "regime", F.when(sign.isNull(), vol).otherwise((vol + sign) / 2).alias("purity"))


def detection_quality(latency_: Column, false_rate: Column, true_rate: Column, stability_: Column) -> tuple[Column, Column]:
    """Score 0 to 100 and its class."""
    down = lambda x, a, b, d: F.when(x < a, 25).when(x < b, 15).when(x < d, 5).otherwise(0)
    up = lambda x, a, b, d: F.when(x > a, 25).when(x > b, 15).when(x > d, 5).otherwise(0)
    score = down(latency_, 2, 5, 10) + down(false_rate, 0.2, 0.4, 0.6) + up(true_rate, 0.8, 0.6, 0.4) + up(stability_, 0.7, 0.5, 0.3)
    return score, F.when(score >= 80, "EXCELLENT").when(score >= 60, "GOOD").when(score >= 40, "ADEQUATE").otherwise("POOR")


def agreement(predictions: DataFrame, key: list[str]) -> DataFrame:
    """Agreement of horizons. ``predictions``: key, horizon, regime, confidence; at least two horizons. Ties go to the shortest horizon."""
    by = predictions.groupBy(*key, "regime").agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("conf"), F.min("horizon").alias("_h")).withColumn("w", c("votes") * c("conf"))
    a = by.groupBy(*key).agg(F.sum("votes").alias("n"), F.max("votes").alias("most"), F.sum("w").alias("all_w"), F.max("w").alias("max_w"), F.max_by(F.struct("regime", "conf"), F.struct(c("w"), -c("_h"))).alias("top"), (F.count(F.lit(1)) - 1).alias("n_other")).filter(c("n") >= 2)
    index = F.sqrt(c("most") / c("n") * F.when(c("all_w") > 0, c("max_w") / c("all_w")).otherwise(0.0))
    a = a.select(*key, index.alias("agreement_index"), c("top.regime").alias("consensus"), c("top.conf").alias("strength"), "n_other")
    good = F.when((c("agreement_index") >= 0.8) & (c("strength") >= 0.7), "strong").when((c("agreement_index") >= 0.6) & (c("strength") >= 0.6), "moderate").when(c("n_other") >= 3, "conflicting").otherwise("weak")
    a = a.withColumn("quality", good)
    q, r = c("quality"), c("consensus")
    act = (
        F.when((q == "strong") & (r == "bull"), "strong_buy").when((q == "strong") & (r == "bear"), "strong_sell").when((q == "strong") & (r == "crisis"), "risk_off").when((q == "strong") & (r == "high_volatility"), "reduce_size").when(q == "strong", "neutral")
        .when((q == "moderate") & (r == "bull"), "moderate_buy").when((q == "moderate") & (r == "bear"), "moderate_sell").when(q == "moderate", "cautious").when(q == "conflicting", "no_position").otherwise("wait")
    )
    return a.withColumn("action", act)


def horizon_shift(predictions: DataFrame, key: list[str]) -> DataFrame:
    """Stability over rising horizons, and what kind of shift the shortest against the longest shows."""
    w = Window.partitionBy(*key).orderBy("horizon")
    y = predictions.withColumn("_c", (c("regime") != F.lag("regime").over(w)).cast("double"))
    a = y.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_c"), F.lit(0.0)).alias("moves"), F.min_by("regime", "horizon").alias("short"), F.max_by("regime", "horizon").alias("long"))
    s, lg = c("short"), c("long")
    kind = F.when(s == lg, "stable").when((s == "bear") & (lg == "bull"), "deteriorating").when((s == "bull") & (lg == "bear"), "improving").when(s == "crisis", "crisis_entry").when(lg == "crisis", "crisis_exit").otherwise("transitioning")
    return a.select(*key, F.when(c("n") < 2, 1.0).otherwise(1 - c("moves") / (c("n") - 1)).alias("stability"), "short", "long", kind.alias("shift"))


#: Weight of a regime in an asset class for the risk score (fixed values).
RISK_WEIGHTS = {
    ("equity", "bull"): 1.0, ("equity", "bear"): -1.0, ("equity", "crisis"): -2.0, ("bond", "bull"): -0.5, ("bond", "bear"): 0.5,
    ("commodity", "bull"): 0.5, ("commodity", "bear"): -0.3, ("crypto", "bull"): 0.3, ("crypto", "bear"): -0.3,
}


def global_regime(x: DataFrame) -> DataFrame:
    """Per date over all assets: risk score, synchronisation, global regime. Needs ts, asset_class, regime, confidence."""
    weight = F.create_map(*(F.lit(v) for (a, r), k in RISK_WEIGHTS.items() for v in (f"{a}/{r}", k)))
    y = x.withColumn("_w", F.coalesce(weight[F.concat_ws("/", "asset_class", "regime")], F.lit(0.0)) * c("confidence"))
    a = y.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("s"), F.count_if(c("regime") == "crisis").alias("n_crisis"), F.avg("confidence").alias("conf"), *(F.count_if(c("regime") == r).alias(f"_{r}") for r in REGIMES))
    a = a.withColumns({"risk_score": clip(c("s"), -3.0, 3.0), "synchronisation": F.greatest(*(c(f"_{r}") for r in REGIMES)) / c("n")})
    s = c("risk_score")
    g = F.when(c("n_crisis") >= 0.5 * c("n"), "crisis").when(s > 1, "risk_on").when(s < -1, "risk_off").when((s > 0) & (c("n_crisis") > 0), "recovery").when(s > 0, "risk_on").otherwise("mixed")
    k = F.when(c("n_crisis") >= 0.5 * c("n"), 1.0).when(F.abs(s) > 1, 1.0).when((s > 0) & (c("n_crisis") > 0), 0.8).when(s > 0, 0.7).otherwise(0.6)
    return a.select("ts", "n", "risk_score", "synchronisation", g.alias("global_regime"), (c("conf") * k).alias("confidence"))


def divergent(x: DataFrame) -> DataFrame:
    """(ts, a, b): pairs of assets of which one is bull and the other bear; bulls meet bears only."""
    bull = x.filter("regime = 'bull'").select("ts", c("symbol").alias("p"))
    bear = x.filter("regime = 'bear'").select("ts", c("symbol").alias("q"))
    return bull.join(bear, "ts").select("ts", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def benchmark_correlation(x: DataFrame, benchmark: str) -> DataFrame:
    """Correlation of each symbol's returns with the benchmark's on common dates."""
    b = x.filter(c("symbol") == benchmark).select("ts", c("ret").alias("_b"))
    return x.join(b, "ts").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.corr("ret", "_b"), F.lit(0.0)).alias("correlation"))


def volatility_bins(x: DataFrame, k: int = 3, n: int = 60) -> DataFrame:
    """Volatility regime 0..k-1 of the deviation of ``n`` returns by the symbol's own quantiles (a half; 33 and 67 per cent; else
    equal shares); NULL until there are as many. A quantile itself belongs to the bin below it.
    """
    x = x.withColumn("_vol", roll(F.stddev_samp, c("ret"), n, *KEYS))
    cuts = [0.5] if k == 2 else [0.33, 0.67] if k == 3 else [j / k for j in range(1, k)]
    q = x.groupBy(*KEYS).agg(F.percentile("_vol", F.array(*map(F.lit, cuts))).alias("_q"))
    return x.join(q, list(KEYS)).withColumn("vol_bin", sum(((c("_vol") > c("_q")[j]).cast("int") for j in range(1, len(cuts))), (c("_vol") > c("_q")[0]).cast("int"))).drop("_q", "_vol")


def trend(x: DataFrame, n: int = 60, band: float = 0.02) -> DataFrame:
    """up, down or sideways against the mean of n closes."""
    m = roll(F.avg, c("close"), n, *KEYS)
    return x.withColumn("_m", m).withColumn("trend", F.when(c("close") > c("_m") * (1 + band), "up").when(c("close") < c("_m") * (1 - band), "down").when(c("_m").isNotNull(), "sideways")).drop("_m")


def by_regime(x: DataFrame, label: str, least: int = 10) -> DataFrame:
    """Performance of each symbol by a label with at least ``least`` rows; the Sharpe ratio is that of a period, 0 without deviation."""
    a = x.filter(c(label).isNotNull() & c("ret").isNotNull()).groupBy(*KEYS, label).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("vol"), F.avg((c("ret") > 0).cast("double")).alias("hit_rate"))
    return a.filter(c("n") >= least).withColumn("sharpe", F.when(c("vol") > 0, c("mean") / c("vol")).otherwise(0.0))


def sigmoid(x: Column, center: float, steep: float) -> Column:
    return 1 / (1 + F.exp(-steep * (x - center)))


#: Factors of the probability of backtested returns (fixed values).
METHOD_DOF = {"grid_search": 1.5, "random": 1.2, "bayesian": 1.0, "gradient": 0.8}
MODEL_DOF = {"indicator": 1.0, "ml_linear": 1.2, "ml_tree": 1.5, "ensemble": 2.0}
PREMIUM = {"bull": 1.0, "bear": 0.9, "low_volatility": 0.95, "high_volatility": 0.7, "crisis": 0.5}


def pbr(x: DataFrame, method: str = "grid_search", model: str = "indicator") -> DataFrame:
    """Probability of backtested returns: seven factors, each to its power.

    Needs sharpe, trades, params, models; wf, stay, confidence, regime and dispersion may be null; with a column n_regimes, fewer
    than two have the neutral factor 0.7.
    """
    dof = c("params") * METHOD_DOF[method] * MODEL_DOF[model]
    sharpe = F.when(c("sharpe") <= 0, 0.1).otherwise(0.3 + 0.65 * sigmoid(c("sharpe"), 1.5, 2.0))
    sample = 0.5 + 0.45 * sigmoid(c("trades"), 100, 0.02)
    fit = 0.4 + 0.6 * sigmoid(c("trades") / (dof * 10 + 1e-6), 1.0, 2.0)
    pick = F.when(c("models") <= 1, 1.0).otherwise(F.greatest(F.lit(0.3), 1 / F.sqrt(F.ln(c("models") + 1))))
    wf = F.coalesce(0.3 + 0.7 * sigmoid(c("wf"), 0.5, 4.0), F.lit(0.7))
    premium = F.coalesce(F.create_map(*(F.lit(v) for kv in PREMIUM.items() for v in kv))[c("regime")], F.when(c("regime").isNull(), 1.0).otherwise(0.8))
    reg = F.coalesce(clip((0.5 + 0.3 * c("stay") + 0.2 * c("confidence")) * premium, 0.0, 1.0), 0.5 + 0.5 * c("stay"), F.lit(0.7))
    disp = F.coalesce(F.greatest(F.lit(0.3), 1 / (1 + c("dispersion"))), F.lit(0.8))
    if "n_regimes" in x.columns:
        disp = F.when(c("n_regimes") < 2, 0.7).otherwise(disp)
    parts = ((sharpe, 0.30), (sample, 0.20), (fit, 0.20), (pick, 0.10), (wf, 0.10), (reg, 0.08), (disp, 0.02))
    total = F.lit(1.0)
    for f, p in parts:
        total = total * F.pow(f, p)
    out = x.withColumn("pbr", clip(total, 0.0, 1.0))
    return out.withColumn("reading", F.when(c("pbr") >= 0.80, "very_high").when(c("pbr") >= 0.65, "high").when(c("pbr") >= 0.50, "moderate").when(c("pbr") >= 0.35, "low").otherwise("very_low"))


#: What a regime is worth to the forward size (fixed values).
QUALITY = {"bull": 1.2, "low_volatility": 1.0, "high_volatility": 0.7, "bear": 0.5, "crisis": 0.2}


def forward_size(size: Column, current: Column, predicted: Column, confidence: Column) -> Column:
    """The regime's size, leaning to the predicted one: times 1 + 0.3 (quality there - quality here) confidence, 0.1 to 2."""
    q = F.create_map(*(F.lit(v) for kv in QUALITY.items() for v in kv))
    return clip(size * (1 + 0.3 * (q[predicted] - q[current]) * confidence), 0.1, 2.0)
