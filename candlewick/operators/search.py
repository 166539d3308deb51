"""Parameter sweeps, validation splits and walk-forward tests; parameters, folds and windows are key columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import div, over, running
from ..session import cut
from ..sources.bars import TF_SECONDS, bucket_of
from ..sources.store import AppendTable
from . import metrics, signals

KEYS = ["symbol", "param_id"]
#: Parameter rows that are sent to all tasks at once.
MOST_BROADCAST = 10_000


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the value lists, numbered in their order; its size is the product of the lists' lengths."""
    one = spark.range(0, 1, 1, 1).select()
    for name, options in values.items():
        one = one.select("*", F.explode(F.array(*map(F.lit, options))).alias(name))
    w = Window.partitionBy(F.lit(0)).orderBy(*values)
    return one.withColumn("param_id", (F.row_number().over(w) - 1).cast("long"))


def sensitivity(params: DataFrame, name: str, values: list) -> DataFrame:
    """Base parameters with one of them varied: a row for each (param_id, value)."""
    return params.withColumn(name, F.explode(F.array(*map(F.lit, values)))).withColumn("param_id", F.col("param_id") * len(values) + F.rank().over(Window.partitionBy("param_id").orderBy(name)) - 1).withColumn("varied", F.lit(name))


def sweep(bars: DataFrame, params: DataFrame, lengths: list[int], costs: signals.Costs = signals.STOCKS, series: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The RSI and cycle strategy of every parameter row on every series, as filled positions.

    ``params``: param_id, mn1 (one of ``lengths``), entry, exit, on, off, start. With a column symbol each symbol has
    rows of its own and they are joined by it (by all of ``series``); else all rows meet all bars, and a grid of more than MOST_BROADCAST rows
    is joined in as many parts as it needs. The RSI of each length is computed once, not once for each row.
    """
    keys = [*series, "param_id"]
    x = bars.select(*series, "ts", "open", "close")
    for n in lengths:
        x = signals.expanding_rsi(x, n, f"rsi_{n}", list(series))
    x = x.withColumn("_i", F.row_number().over(over(*series)) - 1)
    rsi = F.lit(None).cast("double")
    for n in lengths:
        rsi = F.when(F.col("mn1") == n, F.col(f"rsi_{n}")).otherwise(rsi)
    if "symbol" in params.columns:
        y = x.join(params, list(series)).withColumn("rsi", rsi)
    else:  # bars times parameters is the sweep's size
        parts = -(-params.count() // MOST_BROADCAST)
        grids = [params] if parts <= 1 else [params.filter(F.pmod("param_id", F.lit(parts)) == k) for k in range(parts)]
        y = None
        for g in grids:
            z = x.crossJoin(F.broadcast(g)).withColumn("rsi", rsi)
            y = z if y is None else y.unionByName(z)
    on = signals.cycle(F.col("_i"), F.col("on"), F.col("off"), F.col("start"))
    y = y.select(*keys, "ts", "open", ((F.col("rsi") < F.col("entry")) & on).alias("entry"), ((F.col("rsi") > F.col("exit")) | ~on).alias("exit"))
    return signals.fills(signals.positions(y, keys), keys, costs)


def scores(filled: DataFrame, phase: str) -> DataFrame:
    """Trades, Sharpe and weighted score of each (symbol, param_id)."""
    e = metrics.sharpe(signals.equity(filled, KEYS), KEYS)
    t = filled.groupBy(*KEYS).agg(F.count_if("_ends").alias("trades"))
    return e.join(t, KEYS).withColumn("score", F.col("sharpe") * metrics.trade_multiplier(F.col("trades"), phase))


def psr_scores(filled: DataFrame, year: float = 252.0, keys: list[str] = KEYS) -> DataFrame:
    """Trades, Sharpe, and the probabilistic Sharpe ratio weighted by trades as the score, of each key."""
    t = filled.groupBy(*keys).agg(F.count_if("_ends").alias("trades"))
    m = metrics.moments(metrics.equity_returns(signals.equity(filled, keys), keys), keys).join(t, keys)
    p = metrics.probabilistic_sharpe(m, keys, year, trades="trades")
    weight = metrics.trade_multiplier(F.col("trades"), "rsi")
    return p.select(*keys, "trades", (F.col("sharpe") * weight).alias("sharpe"), (F.col("psr") * weight).alias("score"))


def two_phases(bars: DataFrame, cycles: DataFrame, rsis: DataFrame, base: dict[str, float], lengths: list[int], digits: int = 6) -> DataFrame:
    """Coordinate-wise search: first the cycle of each symbol at base RSI values, then the RSI values at its best cycle.

    ``cycles``: param_id, on, off, start; ``rsis``: param_id, mn1, entry, exit; ``base``: mn1, entry, exit. Both phases are
    one job over all symbols and rows. Returns (symbol, param_id, on, off, start, mn1, entry, exit, cycle_score, trades,
    sharpe, score). Scores are rounded to ``digits`` before they are ranked; ties go to the smaller param_id.
    """
    first = cycles.withColumns({k: F.lit(v) for k, v in base.items()})
    won = best(scores(sweep(bars, first, [int(base["mn1"])]), "cycle").withColumn("score", F.round("score", digits)), ["symbol"])
    cycle = won.join(cycles, "param_id").select("symbol", "on", "off", "start", F.col("score").alias("cycle_score"))
    second = cycle.crossJoin(F.broadcast(rsis))  # symbols times rows of the grid
    found = psr_scores(sweep(bars, second.drop("cycle_score"), lengths))
    return found.withColumn("score", F.round("score", digits)).join(second, KEYS)


def timeframe_search(bars: DataFrame, timeframes: tuple[str, ...], cycles: DataFrame, rsis: DataFrame, defaults: dict[str, float], pairs: list[tuple[int, int]], digits: int = 6, costs: signals.Costs = signals.STOCKS) -> DataFrame:
    """Coordinate descent over timeframes: of each in turn the cycle, then the RSI values, by symbol.

    ``bars``: symbol, tf, ts, open, close; trades are on the finest timeframe, and each bar of it sees the coarser bar of its
    day, hour or bucket (where there is none, it cannot enter and must leave). Earlier timeframes stand at what was best of
    them, later ones at ``defaults`` (mn1, mn2, entry, exit, on, off, start). ``cycles``: param_id, on, off, start;
    ``rsis``: param_id, mn1, mn2, entry, exit; ``pairs``: all (mn1, mn2) that occur. Entry where all timeframes ask for it,
    exit where any does. Scores: Sharpe ratio by trades in a cycle phase, probabilistic Sharpe ratio by trades in an RSI
    phase; 0 for fewer than 50 bars. They are rounded to ``digits`` before they are ranked, ties go to the smaller param_id.

    Returns every RSI trial: (symbol, tf, param_id, on, off, start, cycle_score, mn1, mn2, entry, exit, trades, score).
    The other timeframes' signals are the same for all trials of a phase and are combined once; a phase's winners are cut
    and joined to the next by symbol.
    """
    names = ("mn1", "mn2", "entry", "exit", "on", "off", "start")
    finest = min(timeframes, key=TF_SECONDS.get)
    year = 252.0 * {"daily": 1.0, "hourly": 6.5}.get(finest, 6.5 * 12)
    wide = cut(signals.smoothed_rsi(bars.filter(F.col("tf").isin(*timeframes)), pairs, ["symbol", "tf"]))
    fine = wide.filter(F.col("tf") == finest).select("symbol", "ts", "open")
    symbols = fine.select("symbol").distinct()
    current = {tf: symbols.select("symbol", *(F.lit(defaults[n]).alias(n) for n in names)) for tf in timeframes}

    def asked(tf: str, params: DataFrame) -> DataFrame:
        """(symbol, [param_id], _key, _e, _x): the signals of one timeframe by bucket, the last bar's where several match."""
        x = wide.filter(F.col("tf") == tf).join(params, "symbol")
        on = signals.cycle(F.col("_i"), F.col("on"), F.col("off"), F.col("start"))
        x = x.withColumn("rsi", signals.chosen_rsi(pairs)).select("symbol", *(["param_id"] if "param_id" in params.columns else []), "ts", F.struct(((F.col("rsi") < F.col("entry")) & on).alias("e"), ((F.col("rsi") > F.col("exit")) | ~on).alias("x")).alias("_s"))
        keys = [c for c in x.columns if c not in ("ts", "_s")]
        s = x.groupBy(*keys, bucket_of(F.col("ts"), tf).alias("_key")).agg(F.max_by("_s", "ts").alias("_s"))
        return s.select(*keys, "_key", F.col("_s.e").alias("_e"), F.col("_s.x").alias("_x"))

    def joined(rows: DataFrame, tf: str, params: DataFrame) -> DataFrame:
        s = asked(tf, params)
        y = rows.withColumn("_key", bucket_of(F.col("ts"), tf)).join(s, [c for c in s.columns if c not in ("_e", "_x")], "left")
        return y.withColumns({"entry": F.col("entry") & F.coalesce("_e", F.lit(False)), "exit": F.col("exit") | F.coalesce("_x", F.lit(True))}).drop("_key", "_e", "_x")

    def phase(tf: str, candidates: DataFrame, kind: str) -> DataFrame:
        """(symbol, param_id, trades, score) of each candidate of one timeframe."""
        others = fine.withColumns({"entry": F.lit(True), "exit": F.lit(False)})
        for other in timeframes:
            if other != tf:
                others = joined(others, other, current[other])
        rows = joined(others.join(candidates.select("symbol", "param_id"), "symbol"), tf, candidates)
        filled = signals.fills(signals.positions(rows, KEYS), KEYS, costs)
        found = scores(filled, "cycle") if kind == "cycle" else psr_scores(filled, year)
        size = fine.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
        return found.join(size, "symbol").select(*KEYS, "trades", F.when(F.col("_n") < 50, 0.0).otherwise(F.round("score", digits)).alias("score"))

    out = None
    for tf in timeframes:
        turns = current[tf].drop("on", "off", "start").crossJoin(F.broadcast(cycles))  # symbols times rows of the grid
        won = best(phase(tf, turns, "cycle"), ["symbol"]).select("symbol", "param_id", F.col("score").alias("cycle_score"))
        won = cut(won.join(cycles, "param_id").drop("param_id"))
        values = won.crossJoin(F.broadcast(rsis))
        trials = cut(phase(tf, values.drop("cycle_score"), "rsi").join(values, KEYS).withColumn("tf", F.lit(tf)))
        current[tf] = cut(best(trials, ["symbol"]).select("symbol", *names))
        rows = trials.select("symbol", "tf", "param_id", "on", "off", "start", "cycle_score", "mn1", "mn2", "entry", "exit", "trades", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def top_of_batches(results: DataFrame, batch: int = 500, n: int = 5, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The n best rows of each key's batches of parameter rows, and the best of all as the row ``FINAL``."""
    rows = results.withColumn("batch", F.floor(F.col("param_id") / batch).cast("string"))
    final = best(results, list(keys)).withColumn("batch", F.lit("FINAL"))
    return best(rows, [*keys, "batch"], n).unionByName(final)


def append_results(rows: DataFrame, path: str) -> DataFrame:
    """Adds result rows to a table, all or none of them; returns all that it holds."""
    table = AppendTable(rows.sparkSession, path, rows.schema)
    table.append(rows)
    return table.read()


def best(results: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """The n best rows of each key by score, ties by param_id, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "param_id")
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def stable_share(results: DataFrame, keys: list[str], tolerance: float = 0.2) -> DataFrame:
    """Share of parameter values whose score is at least the best one's less ``tolerance``."""
    w = Window.partitionBy(*keys)
    top = F.max("score").over(w)
    return results.withColumn("_ok", (F.col("score") >= top - F.abs(top) * tolerance).cast("double")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best_score"), F.avg("_ok").alias("stable_share"))


def strategy_returns(filled: DataFrame) -> DataFrame:
    """(symbol, param_id, i, ts, ret, ends): relative change of equity, 0 at the first bar; i counts from 0; 1 where a trade ends."""
    w = over(*KEYS)
    held = (F.col("pos") == 1) & ~F.col("_ends")
    equity = F.when(held, F.col("equity_after") * div(F.col("open"), F.col("entry_price"))).otherwise(F.col("equity_after"))
    e = filled.select(*KEYS, "ts", equity.alias("equity"), F.col("_ends").cast("long").alias("ends"))
    return e.select(*KEYS, "ts", (F.row_number().over(w) - 1).alias("i"), F.coalesce(div(F.col("equity"), F.lag("equity").over(w)) - 1, F.lit(0.0)).alias("ret"), "ends")


def fold_windows(counts: DataFrame, k: int = 5) -> DataFrame:
    """Expanding split: fold f tests [n - (k - f) size, + size) with size = n div (k + 1), and trains on all before."""
    size = F.expr(f"n div {k + 1}")
    x = counts.withColumns({"_s": size, "window_id": F.explode(F.sequence(F.lit(0), F.lit(k - 1)))})
    start = F.col("n") - (k - F.col("window_id")) * F.col("_s")
    return x.select("symbol", "window_id", F.lit(0).cast("long").alias("train_from"), start.cast("long").alias("train_to"), start.cast("long").alias("test_from"), (start + F.col("_s")).cast("long").alias("test_to"))


def inner_windows(outer: DataFrame, k: int = 3) -> DataFrame:
    """The expanding split again, within the train part of each outer window: ``window_id`` is the outer one's, ``fold`` counts."""
    size = F.floor((F.col("train_to") - F.col("train_from")) / (k + 1))
    x = outer.withColumns({"_s": size, "fold": F.explode(F.sequence(F.lit(0), F.lit(k - 1)))})
    start = (F.col("train_to") - (k - F.col("fold")) * F.col("_s")).cast("long")
    return x.select("symbol", "window_id", "fold", "train_from", start.alias("train_to"), start.alias("test_from"), (start + F.col("_s")).cast("long").alias("test_to"))


def rolling_windows(counts: DataFrame, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """Windows by rows: train [s, s + train), test [s + train, + test), for s = 0, step, ... while they fit."""
    fit = counts.filter(F.col("n") >= train + test)
    x = fit.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - (train + test), F.lit(step).cast("long"))))
    return x.select("symbol", F.floor(F.col("_s") / step).cast("int").alias("window_id"), F.col("_s").alias("train_from"), (F.col("_s") + train).alias("train_to"), (F.col("_s") + train).alias("test_from"), (F.col("_s") + train + test).alias("test_to"))


def day_parts(bars: DataFrame, train: int = 180, test: int = 30, least_train: int = 100, least_test: int = 10) -> DataFrame:
    """Bars dealt to windows by days, one test length apart: (symbol, window_id, part, ts, open, close), part train or test.

    Windows end within the data; those with too few bars in either part are left out. A bar lies in the test part of one
    window and in the train part of train / test of them, so a series grows by that factor and by no more.
    """
    seconds = F.unix_timestamp("ts")
    span = bars.groupBy("symbol").agg(F.min(seconds).alias("a"), F.max(seconds).alias("b"))
    span = span.withColumn("_m", F.greatest(F.floor((F.floor((F.col("b") - F.col("a")) / 86400) - train) / test), F.lit(1)))
    day = F.floor((seconds - F.col("a")) / (test * 86400))
    reach = math.ceil(train / test)
    x = bars.select("symbol", "ts", "open", "close").join(span, "symbol").withColumn("window_id", F.explode(F.sequence(F.greatest(day - reach, F.lit(0)), F.least(day, F.col("_m") - 1))))
    begin = F.col("a") + F.col("window_id") * test * 86400
    end = begin + (train + test) * 86400
    x = x.filter((seconds >= begin) & (seconds < end) & (end <= F.col("b")))
    x = x.select("symbol", F.col("window_id").cast("int").alias("window_id"), F.when(seconds < begin + train * 86400, "train").otherwise("test").alias("part"), "ts", "open", "close")
    w = Window.partitionBy("symbol", "window_id")
    of = lambda p: F.count_if(F.col("part") == p).over(w)
    return x.withColumn("_ok", (of("train") >= least_train) & (of("test") >= least_test)).filter("_ok").drop("_ok")


def walk_forward_days(bars: DataFrame, params: DataFrame, lengths: list[int], least_trades: int = 5, digits: int = 6, **days: int) -> DataFrame:
    """Walk-forward by days; every part of every window is a series of its own, so RSI, cycle, position and equity start anew in it.

    (symbol, window_id, param_id, train_score, train_return, train_trades, test_return, test_trades, degradation_pct), returns
    in per cent. The best parameter row of a train part (probabilistic Sharpe ratio by trades, rounded, ties to the smaller
    param_id) is tried on the test part. Windows with fewer trades than ``least_trades`` in train, or none in test, are left out.
    """
    series, keys = ("symbol", "window_id"), ["symbol", "window_id", "param_id"]
    parts = day_parts(bars, **days)
    gain = lambda filled, name: filled.groupBy(*keys).agg((100 * (F.max_by("equity_after", "ts") / signals.START - 1)).alias(f"{name}_return"), F.count_if("_ends").alias(f"{name}_trades"))
    trained = cut(sweep(parts.filter("part = 'train'"), params, lengths, series=series))
    scored = psr_scores(trained, keys=keys).select(*keys, F.round("score", digits).alias("score"))
    chosen = best(scored, list(series)).select(*keys, F.col("score").alias("train_score")).join(gain(trained, "train"), keys).filter(F.col("train_trades") >= least_trades)
    chosen = cut(chosen)
    tested = gain(sweep(parts.filter("part = 'test'"), chosen.select(*keys).join(params, "param_id"), lengths, series=series), "test").filter("test_trades >= 1")
    out = chosen.join(tested, keys)
    lost = F.coalesce(div(100 * (F.col("train_return") - F.col("test_return")), F.abs("train_return")), F.lit(0.0))
    return out.select(*keys, "train_score", "train_return", "train_trades", "test_return", "test_trades", lost.alias("degradation_pct"))


def window_scores(returns: DataFrame, windows: DataFrame, year: float = 252.0) -> DataFrame:
    """Sharpe, sum, logarithm of growth and ended trades (0 without a column ``ends``) of each parameter in the train and
    test part of each window.

    Parts are differences of running sums, which equi joins on the row numbers of their ends find: a window costs four
    rows a parameter, whatever its length.
    """
    w = running(*KEYS, order="i")
    parts = {"s": F.col("ret"), "q": F.col("ret") * F.col("ret"), "g": F.log1p("ret"), "t": F.col("ends").cast("double") if "ends" in returns.columns else F.lit(0.0)}
    sums = returns.select(*KEYS, (F.col("i") + 1).cast("long").alias("i"), *(F.sum(x).over(w).alias(n) for n, x in parts.items()))
    sums = sums.unionByName(returns.filter("i = 0").select(*KEYS, F.lit(0).cast("long").alias("i"), *(F.lit(0.0).alias(n) for n in parts)))
    ends = windows.select("symbol", "window_id", F.explode(F.array(*(F.struct(F.lit(c).alias("end"), F.col(c).alias("i")) for c in ("train_from", "train_to", "test_from", "test_to")))).alias("e")).select("symbol", "window_id", "e.*")
    at = ends.join(sums, ["symbol", "i"]).groupBy("symbol", "window_id", "param_id").pivot("end", ["train_from", "train_to", "test_from", "test_to"]).agg(F.first("i").alias("i"), *(F.first(n).alias(n) for n in parts))

    def sharpe(a: str, b: str) -> Column:
        n, s, q = (F.col(f"{b}_{x}") - F.col(f"{a}_{x}") for x in "isq")
        var = (q - s * s / n) / (n - 1)
        return F.when((n > 1) & (var > 1e-15), s / n / F.sqrt(var) * math.sqrt(year)).otherwise(0.0)

    out = at.withColumns({"train_score": sharpe("train_from", "train_to"), "test_score": sharpe("test_from", "test_to")})
    change = lambda part, n: F.col(f"{part}_to_{n}") - F.col(f"{part}_from_{n}")
    named = {f"{part}_{name}": change(part, n) for part in ("train", "test") for n, name in (("s", "sum"), ("g", "growth"))}
    return out.select("symbol", "window_id", "param_id", "train_score", "test_score", *(x.alias(n) for n, x in named.items()), *(F.round(change(part, "t")).cast("long").alias(f"{part}_trades") for part in ("train", "test")))


def nested_cv(returns: DataFrame, outer: DataFrame, k: int = 3, digits: int = 6) -> DataFrame:
    """Nested cross-validation: per outer window the parameter of best mean validation score over the inner folds, its
    score on the outer test part, and mean, deviation, least and greatest of these by symbol.

    Inner and outer windows are scored in one pass. Means are rounded to ``digits`` before they are ranked, so that ties
    do not hang on the order of sums; ties go to the smaller param_id.
    """
    step = k + 1
    inner = inner_windows(outer, k).withColumn("window_id", F.col("window_id") * step + F.col("fold") + 1).drop("fold")
    all_ = window_scores(returns, inner.unionByName(outer.withColumn("window_id", F.col("window_id") * step)))
    fold, own = F.pmod(F.col("window_id"), F.lit(step)), F.floor(F.col("window_id") / step).cast("int").alias("window_id")
    mean = all_.filter(fold > 0).groupBy("symbol", own, "param_id").agg(F.round(F.avg("test_score"), digits).alias("train_score"))
    test = all_.filter(fold == 0).select("symbol", own, "param_id", "test_score")
    best_ = walk_forward(mean.withColumn("test_score", F.lit(0.0))).select("symbol", "window_id", "param_id", F.col("train_score").alias("inner_score"))
    w = Window.partitionBy("symbol")
    return best_.join(test, ["symbol", "window_id", "param_id"]).withColumns({"mean_score": F.avg("test_score").over(w), "std_score": F.stddev_pop("test_score").over(w), "min_score": F.min("test_score").over(w), "max_score": F.max("test_score").over(w)})


def walk_forward(window_scores_: DataFrame, least_trades: int = 0) -> DataFrame:
    """The best parameter of each train part and how it does in the test part; windows with fewer trades of it are left out."""
    w = Window.partitionBy("symbol", "window_id").orderBy(F.desc("train_score"), "param_id")
    out = window_scores_.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").withColumn("degradation", F.col("train_score") - F.col("test_score"))
    return out.filter(F.col("train_trades") >= least_trades) if least_trades else out


def chained(chosen: DataFrame, start: float = 1000.0) -> DataFrame:
    """Equity after each window, in sample and out of sample: the windows' growth end to end."""
    w = running("symbol", order="window_id")
    return chosen.withColumns({"in_sample_equity": start * F.exp(F.sum("train_growth").over(w)), "out_of_sample_equity": start * F.exp(F.sum("test_growth").over(w))})


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    """Per symbol, from ``walk_forward_days``: mean returns, efficiency (test by train), share of test parts with a gain, degradation
    in per cent of the train return's size, the chained equities' growth as logarithms, and whether that looks overfit.
    """
    grown = lambda c: F.sum(F.log1p(F.col(c) / 100))
    a = windows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("train_return").alias("train_return"), F.avg("test_return").alias("test_return"), F.avg((F.col("test_return") > 0).cast("double")).alias("consistency"), grown("train_return").alias("in_sample_growth"), grown("test_return").alias("out_of_sample_growth"))
    lost = div(100 * (F.col("train_return") - F.col("test_return")), F.abs("train_return"))
    a = a.withColumns({"efficiency": F.coalesce(div(F.col("test_return"), F.col("train_return")), F.lit(0.0)), "degradation_pct": F.coalesce(lost, F.lit(0.0))})
    return a.withColumn("overfit", (F.col("efficiency") < 0.3) | (F.col("consistency") < 0.4) | (F.col("degradation_pct") > 70))


def adequacy(bars: DataFrame) -> DataFrame:
    """How much data each symbol has, and the windows and trials that it allows."""
    d = F.datediff(F.max("ts"), F.min("ts"))
    a = bars.groupBy("symbol").agg(d.alias("days"))
    x = F.col("days")
    return a.withColumns({
        "level": F.when(x < 60, "limited").when(x < 120, "modest").when(x < 365, "good").otherwise("excellent"),
        "train_days": F.when(x < 60, F.greatest(F.lit(14), F.floor(x / 3).cast("int"))).when(x < 120, F.greatest(F.lit(30), F.floor(x / 3).cast("int"))).when(x < 365, 90).otherwise(180),
        "test_days": F.when(x < 60, F.greatest(F.lit(7), F.floor(x / 6).cast("int"))).when(x < 120, F.greatest(F.lit(10), F.floor(x / 6).cast("int"))).when(x < 365, 20).otherwise(30),
        "trials": F.when(x < 60, 300).when(x < 120, 400).otherwise(500),
    }).withColumn("windows", F.greatest(F.lit(0), F.floor((x - F.col("train_days")) / F.col("test_days"))).cast("int"))
