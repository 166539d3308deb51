"""Signals, positions and trades as set operations: no loop over bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import div, frame, over, running
from ..sources.bars import TF_SECONDS, bucket_of

START = 1000.0


@dataclass(frozen=True)
class Costs:
    """Shares of a fill's price, each way, and money for each side."""

    commission: float = 0.0
    slippage: float = 0.0
    spread: float = 0.0
    fixed: float = 0.0

    @property
    def total(self) -> float:
        return self.commission + self.slippage + self.spread


#: Presets (fixed values): stocks 0/2/4 basis points, crypto 25/5/20.
STOCKS, CRYPTO = Costs(0.0, 0.0002, 0.0004), Costs(0.0025, 0.0005, 0.0020)


def expanding_rsi(df: DataFrame, n: int | str, out: str, keys: list[str], no_loss: float = 0.0) -> DataFrame:
    """RSI whose first rows use what there is; ``no_loss`` where the window has no loss."""
    d = F.col("close") - F.lag("close").over(over(*keys))
    x = df.withColumn("_d", d).withColumns({"_g": F.coalesce(F.greatest(F.col("_d"), F.lit(0.0)), F.lit(0.0)), "_l": F.coalesce(F.greatest(-F.col("_d"), F.lit(0.0)), F.lit(0.0))})
    w = frame(n, *keys)
    x = x.withColumns({"_ag": F.avg("_g").over(w), "_al": F.avg("_l").over(w)})
    return x.withColumn(out, F.when(F.col("_al") == 0, F.lit(no_loss)).otherwise(100 - 100 / (1 + div(F.col("_ag"), F.col("_al"))))).drop("_d", "_g", "_l", "_ag", "_al")


def smooth(df: DataFrame, x: str, n: int, out: str, keys: list[str]) -> DataFrame:
    return df.withColumn(out, F.avg(x).over(frame(n, *keys)))


def smoothed_rsi(bars: DataFrame, pairs: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """Adds ``rsi_<mn1>_<mn2>``, the smoothed RSI of each pair, and ``_i``, the bar's number; an RSI is computed once a length."""
    x = bars
    for n in sorted({a for a, _ in pairs}):
        x = expanding_rsi(x, n, f"_r{n}", keys)
    for a, b in pairs:
        x = smooth(x, f"_r{a}", b, f"rsi_{a}_{b}", keys)
    return x.withColumn("_i", F.row_number().over(over(*keys)) - 1).drop(*{f"_r{a}" for a, _ in pairs})


def chosen_rsi(pairs: list[tuple[int, int]]) -> Column:
    """The column of ``smoothed_rsi`` that a row's mn1 and mn2 ask for."""
    out = F.lit(None).cast("double")
    for a, b in pairs:
        out = F.when((F.col("mn1") == a) & (F.col("mn2") == b), F.col(f"rsi_{a}_{b}")).otherwise(out)
    return out


def live_positions(bars: DataFrame, params: DataFrame, pairs: list[tuple[int, int]], timeframes: tuple[str, ...], until: Column | None = None) -> DataFrame:
    """What a live run decides, from a whole history: (symbol, param_id, ts, enter, leave, pos, rsi_<tf>...) at each close of a bar.

    ``bars``: symbol, tf, ts, close; ``params``: a row for each (param_id, tf). At a time each timeframe has its last bar that
    has closed by then; entry where all ask for it, exit where any does, once each has two. ``until``: ends before it count.
    """
    x = smoothed_rsi(bars.filter(F.col("tf").isin(*timeframes)), pairs, ["symbol", "tf"]).join(params, "tf")
    seconds = F.create_map(*(F.lit(v) for kv in TF_SECONDS.items() for v in kv))[F.col("tf")]
    turn = cycle(F.col("_i"), F.col("on"), F.col("off"), F.col("start"))
    x = x.withColumns({"rsi": chosen_rsi(pairs), "at": F.timestamp_seconds(F.unix_timestamp("ts") + seconds)})
    x = x.select("symbol", "param_id", "tf", "at", F.when(F.col("_i") > 0, F.struct("rsi", ((F.col("rsi") < F.col("entry")) & turn).alias("enter"), ((F.col("rsi") > F.col("exit")) | ~turn).alias("leave"))).alias("s"))
    if until is not None:
        x = x.filter(F.col("at") < until)
    keys = ["symbol", "param_id"]
    y = x.groupBy(*keys, F.col("at").alias("ts")).agg(*(F.max(F.when(F.col("tf") == t, F.col("s"))).alias(f"_{t}") for t in timeframes))
    y = y.withColumns({f"_{t}": F.last(f"_{t}", ignorenulls=True).over(running(*keys)) for t in timeframes})
    for t in timeframes:
        y = y.filter(F.col(f"_{t}").isNotNull())
    enter, leave = F.lit(True), F.lit(False)
    for t in timeframes:
        enter, leave = enter & F.col(f"_{t}.enter"), leave | F.col(f"_{t}.leave")
    y = positions(y.withColumns({"enter": enter, "leave": leave}), keys, "enter", "leave", last_enters=True)
    return y.select(*keys, "ts", "enter", "leave", "pos", *(F.col(f"_{t}.rsi").alias(f"rsi_{t}") for t in timeframes))


def cycle(index: Column, on: Column, off: Column, start: Column) -> Column:
    """On for ``on`` bars, off for ``off``, from ``start``; a cycle of length 0 is always on."""
    return F.when(on + off > 0, F.pmod(index - start, on + off) < on).otherwise(F.lit(True))


def align(fine: DataFrame, coarse: DataFrame, unit: str, value: str, out: str, default: float | bool = 0.0) -> DataFrame:
    """A coarse series' value on each fine bar of the same day, hour or bucket; the last one where several match.

    ``unit`` is one of date_trunc, or a timeframe such as 5min.
    """
    key = bucket_of(F.col("ts"), unit) if unit in TF_SECONDS else F.date_trunc(unit, F.col("ts"))
    one = coarse.groupBy("symbol", key.alias("_k")).agg(F.max_by(value, "ts").alias(out))
    return fine.withColumn("_k", key).join(one, ["symbol", "_k"], "left").drop("_k").withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def combine(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Entry where all timeframes ask for it, exit where any does. ``signals``: keys, ts, entry, exit by tf."""
    return signals.groupBy(*keys, "ts").agg(F.bool_and("entry").alias("entry"), F.bool_or("exit").alias("exit"))


def positions(df: DataFrame, keys: list[str], entry: str = "entry", exit_: str = "exit", last_enters: bool = False) -> DataFrame:
    """Adds ``pos`` (0/1 after each bar), ``opened`` and ``closed``.

    Entry alone sets, exit alone resets, both together toggle, none keeps; the last bar does not enter unless ``last_enters``.
    The state is the last set or reset plus the toggles since, modulo 2; these are the toggles so far less those at the last
    set or reset, so one order of the rows serves for all.
    """
    w, run = over(*keys), running(*keys)
    last = F.lead(F.lit(1)).over(w).isNull()
    e = F.coalesce(F.col(entry), F.lit(False))
    e = e if last_enters else e & ~F.col("_last")
    x = F.coalesce(F.col(exit_), F.lit(False))
    out = df.withColumn("_last", last).withColumns({"_base": F.when(e & ~x, 1).when(x & ~e, 0), "_tog": F.sum((e & x).cast("int")).over(run)})
    since = F.coalesce(F.last(F.when(F.col("_base").isNotNull(), F.col("_base") - F.col("_tog")), ignorenulls=True).over(run), F.lit(0))
    out = out.withColumn("pos", F.pmod(since + F.col("_tog"), F.lit(2)).cast("int"))
    prev = F.coalesce(F.lag("pos").over(w), F.lit(0))
    return out.withColumns({"opened": (prev == 0) & (F.col("pos") == 1), "closed": (prev == 1) & (F.col("pos") == 0)}).drop("_base", "_tog")


def fills(df: DataFrame, keys: list[str], costs: Costs = STOCKS, start: float = START) -> DataFrame:
    """Positions with fills at the next open, trade numbers, and equity before and after; needs ``positions``.

    What is still open at the end is closed at the last open.
    """
    w, run = over(*keys), running(*keys)
    nxt = F.coalesce(F.lead("open").over(w), F.col("open"))
    out = df.withColumns({"_in": F.when(F.col("opened"), nxt * (1 + costs.total)), "_at": F.when(F.col("opened"), F.col("ts")), "trade_id": F.sum(F.col("opened").cast("long")).over(run)})
    out = out.withColumns({"entry_price": F.last("_in", ignorenulls=True).over(run), "entry_ts": F.last("_at", ignorenulls=True).over(run)})
    ends = F.col("closed") | (F.col("_last") & (F.col("pos") == 1))
    price = F.when(F.col("closed"), nxt).otherwise(F.col("open")) * (1 - costs.total)
    out = out.withColumns({"_ends": ends, "exit_price": F.when(ends, price)})
    factor = F.when(F.col("_ends"), div(F.col("exit_price"), F.col("entry_price")))
    out = out.withColumn("_f", factor).withColumn("equity_after", start * F.exp(F.coalesce(F.sum(F.ln("_f")).over(run), F.lit(0.0))))
    return out.drop("_in", "_at")


def trades(filled: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each trade."""
    return filled.filter("_ends").select(*keys, "trade_id", "entry_ts", "entry_price", F.col("ts").alias("exit_ts"), "exit_price", (100 * (F.col("_f") - 1)).alias("pct_change"), (F.col("equity_after") / F.col("_f")).alias("equity_before"), "equity_after")


def equity(filled: DataFrame, keys: list[str]) -> DataFrame:
    """Equity at each bar: while long, marked at the bar's open against the entry's price."""
    held = (F.col("pos") == 1) & ~F.col("_ends")
    return filled.select(*keys, "ts", F.when(held, F.col("equity_after") * div(F.col("open"), F.col("entry_price"))).otherwise(F.col("equity_after")).alias("equity"))


def fixed_commission(trade_log: DataFrame, keys: list[str], fixed: float, start: float = START) -> DataFrame:
    """Final equity with a fixed commission a side: each trade maps equity to (equity - fixed) * factor - fixed, folded in order."""
    log = trade_log.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("trade_id", (F.col("pct_change") / 100 + 1).alias("f")))).alias("t"))
    return log.select(*keys, F.aggregate("t", F.lit(start), lambda acc, t: (acc - fixed) * t["f"] - fixed).alias("final_equity"))


def rule_orders(df: DataFrame, keys: list[str], quantity: int = 100, half_spread: float = 0.0005, slippage: float = 0.0002, commission: float = 1.0, cash: float = 100000.0) -> DataFrame:
    """Order-level backtest of entry and exit rules: an order at bar i fills at the open of bar i + 2; cash and equity."""
    w, run = over(*keys), running(*keys)
    px = F.lead("open", 2).over(w)
    side = F.when(F.col("opened"), 1).when(F.col("closed"), -1)
    x = df.withColumns({"_side": side, "_px": px}).withColumn("_fill", F.when(F.col("_side").isNotNull() & F.col("_px").isNotNull(), F.col("_px") * (1 + F.col("_side") * (half_spread + slippage))))
    flow = -F.col("_side") * quantity * F.col("_fill") - commission
    # A fill belongs to the bar two later.
    x = x.withColumns({"_flow": F.coalesce(F.lag(F.when(F.col("_fill").isNotNull(), flow), 2).over(w), F.lit(0.0)), "_qty": F.coalesce(F.lag(F.when(F.col("_fill").isNotNull(), F.col("_side") * quantity), 2).over(w), F.lit(0))})
    x = x.withColumns({"cash": cash + F.sum("_flow").over(run), "qty": F.sum("_qty").over(run)})
    return x.select(*keys, "ts", "cash", F.col("qty").cast("long").alias("qty"), (F.col("cash") + F.col("qty") * F.col("close")).alias("equity"))


def limit_fill(side: Column, limit: Column, open_: Column, high: Column, low: Column) -> Column:
    """Price at which a limit order fills in a bar, or NULL."""
    return F.when((side == "buy") & (low <= limit), F.least(limit, open_)).when((side == "sell") & (high >= limit), F.greatest(limit, open_))


#: Rows of a block of a scan.
SCAN = 1024


def _applied(m: Column, state: Column) -> Column:
    """Where a map (a struct of what -1, 0 and 1 become) takes a state."""
    return F.when(state == -1, m["short"]).when(state == 0, m["flat"]).otherwise(m["long"])


def _composed(first: Column, then: Column) -> Column:
    return F.struct(*(_applied(then, first[n]).alias(n) for n in ("short", "flat", "long")))


def state_scan(df: DataFrame, keys: list[str], step: Column, out: str = "pos") -> DataFrame:
    """Adds the state after each row of a machine with the states -1, 0 and 1 that starts at 0.

    ``step``: what the row makes of each state, a struct (short, flat, long). Maps compose associatively, so rows are cut
    into blocks of SCAN: a block is folded to one map, the blocks' maps to the state that each block starts in, and then
    blocks run side by side. No task folds more than a block's rows, or a key's blocks.
    """
    same = F.struct(F.lit(-1).alias("short"), F.lit(0).alias("flat"), F.lit(1).alias("long"))
    x = df.withColumns({"_n": F.row_number().over(over(*keys)) - 1, "_m": step}).withColumn("_b", F.floor(F.col("_n") / SCAN))
    rows = x.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_n", "_m", F.struct(*(c for c in df.columns if c not in keys)).alias("row")))).alias("rows"))
    rows = rows.withColumn("_map", F.aggregate("rows", same, lambda acc, r: _composed(acc, r["_m"])))
    blocks = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_map"))).alias("blocks"))
    none = F.array().cast("array<struct<_b:bigint,state:int>>")
    first = F.struct(F.lit(0).alias("state"), none.alias("list"))
    run = F.aggregate("blocks", first, lambda acc, b: F.struct(_applied(b["_map"], acc["state"]).alias("state"), F.concat(acc["list"], F.array(F.struct(b["_b"].alias("_b"), acc["state"].alias("state")))).alias("list")))
    starts = blocks.select(*keys, F.explode(run["list"]).alias("s")).select(*keys, F.col("s._b").alias("_b"), F.col("s.state").alias("_s"))
    states = F.aggregate("rows", F.struct(F.col("_s").alias("state"), F.array().cast("array<int>").alias("list")), lambda acc, r: F.struct(_applied(r["_m"], acc["state"]).alias("state"), F.concat(acc["list"], F.array(_applied(r["_m"], acc["state"]))).alias("list")))["list"]
    done = rows.join(starts, [*keys, "_b"]).select(*keys, F.explode(F.arrays_zip(F.col("rows.row").alias("row"), states.alias("state"))).alias("z"))
    return done.select(*keys, "z.row.*", F.col("z.state").alias(out)).select(*df.columns, out)


def regime_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Three-state strategy on regime labels: ``pos`` in -1, 0, 1 after each bar.

    A flat position opens long in a confident bull regime, else short in a confident bear or crisis regime; a long one closes
    outside bull, a short one outside bear and crisis, both below a confidence of 0.4. A bar that closes opens nothing.
    Needs regime, confidence and pbr (a score in 0..1).
    """
    down = F.coalesce(F.col("regime").isin("bear", "crisis"), F.lit(False))
    up = F.coalesce(F.col("regime") == "bull", F.lit(False))
    sure, weak = F.coalesce(F.col("confidence") > 0.6, F.lit(False)), F.coalesce(F.col("confidence") < 0.4, F.lit(False))
    above = lambda x: F.coalesce(F.col("pbr") > x, F.lit(False))
    step = F.struct(
        F.when(~down | weak, 0).otherwise(-1).alias("short"), F.when(up & sure & above(0.5), 1).when(down & sure & above(0.4), -1).otherwise(0).alias("flat"), F.when(~up | weak, 0).otherwise(1).alias("long")
    )
    out = state_scan(df, keys, step)
    return out.withColumn("changed", F.coalesce(F.col("pos") != F.lag("pos").over(over(*keys)), F.col("pos") != 0))


def rsi_rule(bars: DataFrame, n: int = 14, low: float = 30.0, high: float = 70.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars with strategy RSI and the rule's entry and exit, as positions."""
    x = expanding_rsi(bars, n, "rsi", list(keys))
    return positions(x.withColumns({"entry": F.col("rsi") < low, "exit": F.col("rsi") > high}), list(keys))
