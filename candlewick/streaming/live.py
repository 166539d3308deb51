"""Live signals on several timeframes and running exposure: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.search import MOST_BROADCAST
from ..sources.bars import TF_SECONDS

#: State of one timeframe: closed bars so far, the last close, the last moves and RSI values, the signals of the last closed
#: bar, and the open bars (their starts and last closes).
SERIES = "n long, last double, moves array<double>, rsis array<double>, rsi double, enter boolean, leave boolean, starts array<long>, closes array<double>"
PARAMS = ("mn1", "mn2", "entry", "exit", "on", "off", "start")


def stamp(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


def next_value(moves: list[float], rsis: list[float], move: float, mn1: int, mn2: int) -> float:
    """The smoothed RSI after one more move; the lists are the last mn1 moves and mn2 RSI values."""
    moves.append(move)
    rsis_window = moves[-mn1:]
    gain, loss = sum(x for x in rsis_window if x > 0), -sum(x for x in rsis_window if x < 0)
    rsis.append(100 - 100 / (1 + gain / loss) if loss > 0 else 0.0)
    del moves[:-mn1], rsis[:-mn2]
    return sum(rsis) / len(rsis)


class MultiTimeframe(StatefulProcessor):
    """Keyed by (symbol, param_id). State: a series for each timeframe and the position.

    A bar is open until the watermark has passed its end, and open bars give no signal; a later row of the same bar
    replaces its close. One timer stands at the end of the earliest open bar. When it expires all bars that have ended are
    taken in the order of their ends, so the result does not hang on how rows were dealt to triggers.
    """

    def __init__(self, timeframes: tuple[str, ...]):
        self.timeframes = timeframes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getMapState("series", "tf string", SERIES)
        self.rules = handle.getMapState("rules", "tf string", "mn1 int, mn2 int, entry double, exit double, on int, off int, start int")
        self.position = handle.getValueState("position", "pos int, timer long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            for tf, mine in frame.groupby("tf", sort=False):
                state = self._series(tf)
                open_ = dict(zip(state["starts"], state["closes"], strict=True))
                order = mine.sort_values(["ts", "seq"]) if "seq" in mine else mine.sort_values("ts")
                open_ |= dict(zip((order["ts"].astype("int64") // self._unit(order["ts"])).tolist(), order["close"].tolist(), strict=True))
                state["starts"], state["closes"] = sorted(open_), [open_[k] for k in sorted(open_)]
                self._keep(tf, state)
                if not self.rules.containsKey((tf,)):
                    r = mine.iloc[0]
                    self.rules.updateValue((tf,), tuple(float(r[p]) if p in ("entry", "exit") else int(r[p]) for p in PARAMS))
                end = state["starts"][0] + 1000 * TF_SECONDS[tf]
                earliest = end if earliest is None else min(earliest, end)
        self._wait(earliest, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        water = timerValues.getCurrentWatermarkInMs()
        state = {tf: self._series(tf) for tf in self.timeframes if self.series.containsKey((tf,))}
        rules = {tf: self.rules.getValue((tf,)) for tf in state}
        due = sorted((at + 1000 * TF_SECONDS[tf], at, tf, close) for tf, s in state.items() for at, close in zip(s["starts"], s["closes"], strict=True) if at + 1000 * TF_SECONDS[tf] < water)
        pos = self.position.get()[0] if self.position.exists() else 0
        out = []
        for k, (end, at, tf, close) in enumerate(due):
            s, (mn1, mn2, entry, exit_, on, off, start) = state[tf], rules[tf]
            s["rsi"] = next_value(s["moves"], s["rsis"], close - s["last"] if s["n"] else 0.0, mn1, mn2)
            turn = on + off <= 0 or (s["n"] - start) % (on + off) < on
            s["enter"], s["leave"] = bool(s["rsi"] < entry and turn), bool(s["rsi"] > exit_ or not turn)
            s["last"], s["n"] = close, s["n"] + 1
            if k + 1 < len(due) and due[k + 1][0] == end:
                continue  # all that close at one time count together
            known = [state[t] for t in self.timeframes if t in state and state[t]["n"] >= 2]
            if len(known) == len(self.timeframes):
                enter, leave = all(x["enter"] for x in known), any(x["leave"] for x in known)
                pos = int(enter) if not pos else int(not leave)
                out.append((key[0], key[1], stamp(end), enter, leave, pos, *(x["rsi"] for x in known)))
        earliest = None
        for tf, s in state.items():
            left = [(at, c) for at, c in zip(s["starts"], s["closes"], strict=True) if at + 1000 * TF_SECONDS[tf] >= water]
            s["starts"], s["closes"] = [a for a, _ in left], [c for _, c in left]
            self._keep(tf, s)
            if left:
                end = left[0][0] + 1000 * TF_SECONDS[tf]
                earliest = end if earliest is None else min(earliest, end)
        self.position.update((pos, 0))
        self._wait(earliest, water)
        if out:
            yield pd.DataFrame(out, columns=["symbol", "param_id", "ts", "enter", "leave", "pos", *(f"rsi_{t}" for t in self.timeframes)])

    @staticmethod
    def _unit(ts: pd.Series) -> int:
        """Values of a millisecond in the column's unit."""
        return {"ns": 1_000_000, "us": 1000, "ms": 1}[getattr(ts.dt, "unit", "ns")]

    def _series(self, tf: str) -> dict:
        names = [x.strip().split()[0] for x in SERIES.split(", ")]
        if self.series.containsKey((tf,)):
            return {n: list(v) if n in ("moves", "rsis", "starts", "closes") else v for n, v in zip(names, self.series.getValue((tf,)), strict=True)}
        return dict(zip(names, (0, 0.0, [], [], 0.0, False, False, [], []), strict=True))

    def _keep(self, tf: str, state: dict) -> None:
        self.series.updateValue((tf,), tuple(state.values()))

    def _wait(self, end: int | None, water: int) -> None:
        """One timer at the earliest end, after the watermark (an earlier one would not be found again); a later one that
        stands already is taken back.
        """
        pos, timer = self.position.get() if self.position.exists() else (0, 0)
        end = None if end is None else max(end, water + 1)
        if end is not None and (not timer or end < timer):
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            self.position.update((pos, end))


def multi_timeframe_signals(bars: DataFrame, params: DataFrame, timeframes: tuple[str, ...], late: str = "0 seconds") -> DataFrame:
    """A stream of bars of several timeframes to (symbol, param_id, ts, enter, leave, pos, rsi_<tf>...).

    ``bars``: symbol, tf, ts (the bar's start), close, and seq where a bar is sent more than once; ``params``: a row for
    each (param_id, tf) with mn1, mn2, entry, exit, on, off, start. A row for each time at which a bar closes: entry where all
    timeframes ask for it, exit where any does, once each has two closed bars. Cycles count bars from the stream's first.
    """
    grid = F.broadcast(params) if params.count() <= MOST_BROADCAST else params
    rows = bars.filter(F.col("tf").isin(*timeframes) & F.col("close").isNotNull()).withWatermark("ts", late).join(grid, "tf")
    typed = [F.col(p).cast("double" if p in ("entry", "exit") else "int").alias(p) for p in PARAMS]
    rows = rows.select("symbol", F.col("param_id").cast("long").alias("param_id"), "tf", "ts", "close", *(["seq"] if "seq" in bars.columns else []), *typed)
    schema = "symbol string, param_id long, ts timestamp, enter boolean, leave boolean, pos int, " + ", ".join(f"rsi_{t} double" for t in timeframes)
    return rows.groupBy("symbol", "param_id").transformWithStateInPandas(MultiTimeframe(timeframes), schema, "Append", "EventTime")


#: Limits of exposures (defaults): gross, net, one position, leverage, drawdown from the peak.
LIMITS = {"gross": 1_000_000.0, "net": 500_000.0, "single": 100_000.0, "leverage": 1.0, "drawdown": -0.10}
LEVELS = ("green", "yellow", "orange", "red")
EXPOSURE = "portfolio string, event_id long, ts timestamp, gross double, net double, leverage double, value double, drawdown double, level string, killed boolean"


def risk_level(gross, net, leverage, single, drawdown, limits: dict[str, float]):
    """The worst of all limits, as an index of LEVELS; of numbers or arrays."""
    red = (gross > limits["gross"]) | (leverage > limits["leverage"]) | (drawdown < limits["drawdown"])
    orange = (np.abs(net) > limits["net"]) | (single > limits["single"])
    return np.where(red, 3, np.where(orange, 2, np.where(gross > 0.9 * limits["gross"], 1, 0)))


#: Groups that portfolios are dealt to: prices go to each of them. Milliseconds of fills that are folded at once, and rows that
#: are put by at once.
DESKS, SPAN, PIECE = 16, 86_400_000, 500_000


class Exposure(StatefulProcessor):
    """Keyed by desk, a number that portfolios are dealt to. State: positions, money with its peak and the latch, the last price of
    each symbol, and the rows that wait, in blocks by day.

    Rows (fills, and prices, which have no event_id) wait until the watermark less ``within`` has passed them. Then they count in the
    order of their times, a price before fills of its time, whatever trigger brought them. A day is folded by running sums, so
    the work is a few array operations for each day and symbol, and no more than a day (or PIECE rows of input) is held at once.
    """

    def __init__(self, limits: dict[str, float], start: float, within: int):
        self.limits, self.start, self.within = limits, start, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.positions = handle.getMapState("positions", "portfolio string, symbol string", "qty double, worth double")
        self.money = handle.getMapState("money", "portfolio string", "cash double, peak double, killed boolean")
        self.prices = handle.getMapState("prices", "symbol string", "bar long, mark double")
        self.waiting = handle.getMapState("waiting", "day long, part long", "rows binary")
        self.book = handle.getValueState("book", "timer long, parts long")

    def close(self) -> None:
        pass

    def _wait(self, first: int | None, water: int, timer: int, parts: int) -> None:
        """One timer, at which the earliest row that waits is due."""
        at = None if first is None else max(first + self.within, water + 1)
        if at is not None and (not timer or at < timer):
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.book.update((timer, parts))

    def _put(self, rows: pd.DataFrame, part: int) -> None:
        for day, block in rows.groupby(rows["at"] // SPAN, sort=False):
            with pa.BufferOutputStream() as sink:
                table = pa.Table.from_pandas(block, preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                self.waiting.updateValue((int(day), part), (sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, parts = self.book.get() if self.book.exists() else (0, 0)
        first, frames, n = None, [], 0

        def put() -> None:
            nonlocal frames, n, parts
            if frames:
                self._put(pd.concat(frames), parts)
                frames, n, parts = [], 0, parts + 1

        for frame in rows:
            frame = frame.drop(columns="desk").astype({"portfolio": "category", "symbol": "category"})
            first = int(frame["at"].min()) if first is None else min(first, int(frame["at"].min()))
            frames.append(frame)
            n += len(frame)
            if n >= PIECE:
                put()
        put()
        self._wait(first, timerValues.getCurrentWatermarkInMs(), timer, parts)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        water = timerValues.getCurrentWatermarkInMs()
        due = water - self.within
        keys: dict[int, list[int]] = {}
        for day, part in self.waiting.keys():
            keys.setdefault(int(day), []).append(int(part))
        prices = {k[0]: tuple(v) for k, v in self.prices.iterator()}
        money = {k[0]: tuple(v) for k, v in self.money.iterator()}
        held: dict[str, dict[str, tuple]] = {}
        for (portfolio, symbol), v in self.positions.iterator():
            held.setdefault(portfolio, {})[symbol] = tuple(v)
        parts, first, touched = self.book.get()[1], None, set()
        for day in sorted(keys):
            if day * SPAN >= due:
                first = day * SPAN
                break
            blocks = [(day, part) for part in keys[day]]
            rows = pd.concat([pa.ipc.open_stream(self.waiting.getValue(b)[0]).read_pandas() for b in blocks])
            rows = rows.astype({"portfolio": object, "symbol": object}).sort_values(["at", "event_id"], na_position="first", ignore_index=True)
            for b in blocks:
                self.waiting.removeKey(b)
            late = rows[rows["at"] >= due]
            if len(late):
                self._put(late, parts)
                parts, first = parts + 1, int(late["at"].iloc[0])
            fills = self._marked(rows[rows["at"] < due], prices)
            for portfolio, mine in fills.groupby("portfolio", sort=False):
                mine_held, out = held.setdefault(portfolio, {}), mine["event_id"]
                money[portfolio], frame = self._fold(mine, mine_held, money.get(portfolio, (self.start, self.start, False)))
                touched |= {(portfolio, s) for s in mine["symbol"].unique()}
                frame.insert(0, "portfolio", portfolio)
                frame.insert(1, "event_id", out.to_numpy("int64"))
                yield frame
            if first is not None:
                break
        for symbol, v in prices.items():
            self.prices.updateValue((symbol,), v)
        for portfolio in {p for p, _ in touched}:
            self.money.updateValue((portfolio,), money[portfolio])
        for portfolio, symbol in touched:
            self.positions.updateValue((portfolio, symbol), held[portfolio][symbol])
        self._wait(first, water, 0, parts)

    def _marked(self, rows: pd.DataFrame, prices: dict[str, tuple]) -> pd.DataFrame:
        """The fills among rows in order, each with its mark: the last price within reach, else its own."""
        bar, mark, is_fill = np.full(len(rows), -1, "int64"), np.zeros(len(rows)), rows["event_id"].notna().to_numpy()
        at, price = rows["at"].to_numpy(), rows["price"].to_numpy(float)
        for symbol, index in rows.groupby("symbol", sort=False).indices.items():
            last, was = prices.get(symbol, (-1, 0.0))
            seen = np.maximum.accumulate(np.where(is_fill[index], -1, np.arange(len(index))))
            none = seen < 0
            bar[index], mark[index] = np.where(none, last, at[index][seen]), np.where(none, was, price[index][seen])
            prices[symbol] = (int(bar[index[-1]]), float(mark[index[-1]]))
        reach = (bar >= 0) & (bar > at - self.within)
        return rows.assign(mark=np.where(reach, mark, price))[is_fill].drop_duplicates("event_id")

    def _fold(self, fills: pd.DataFrame, held: dict[str, tuple], money: tuple) -> tuple[tuple, pd.DataFrame]:
        """Money and exposure after each of a portfolio's fills, which are in order; ``held`` is brought up to date."""
        cash, peak, killed = money
        n, qty, price, mark = len(fills), fills["qty"].to_numpy(float), fills["price"].to_numpy(float), fills["mark"].to_numpy(float)
        groups = fills.groupby("symbol", sort=False).indices
        still = [w for s, (_, w) in held.items() if s not in groups]
        gross, net, single = np.full(n, float(sum(map(abs, still)))), np.full(n, float(sum(still))), np.full(n, max(map(abs, still), default=0.0))
        for symbol, index in groups.items():
            q, w = held.get(symbol, (0.0, 0.0))
            after = np.cumsum(np.concatenate([[q], qty[index]]))[1:]
            worth = np.repeat(np.concatenate([[w], after * mark[index]]), np.diff(np.concatenate([[0], index, [n]])))
            gross, net, single = gross + np.abs(worth), net + worth, np.maximum(single, np.abs(worth))
            held[symbol] = (float(after[-1]), float(worth[-1]))
        paid = np.cumsum(np.concatenate([[cash], -qty * price]))[1:]
        value = paid + net
        peaks = np.maximum.accumulate(np.concatenate([[peak], value]))[1:]
        leverage = np.divide(gross, value, out=np.zeros(n), where=value > 0)
        fall = np.divide(value - peaks, peaks, out=np.zeros(n), where=peaks > 0)
        level = risk_level(gross, net, leverage, single, fall, self.limits)
        dead = np.logical_or.accumulate(np.concatenate([[killed], level == 3]))[1:]
        frame = pd.DataFrame({"ts": fills["at"].to_numpy().astype("datetime64[ms]").astype("datetime64[us]"), "gross": gross, "net": net, "leverage": leverage, "value": value, "drawdown": fall, "level": np.array(LEVELS)[level], "killed": dead})
        return (float(paid[-1]), float(peaks[-1]), bool(dead[-1])), frame


def stream_exposure(fills: DataFrame, prices: DataFrame, within: str = "6 hours", late: str = "10 minutes", limits: dict[str, float] | None = None, start: float = 100_000.0) -> DataFrame:
    """T5: gross and net exposure, leverage, value, drawdown, risk level and latched kill switch of a portfolio after each fill.

    ``fills``: event_id, portfolio, symbol, ts, qty, price, marked at the last of ``prices`` (symbol, ts, price) that is not
    later than they are and within ``within``, else at their own price. Both are one stream of rows by time, so a fill meets one price
    and not all of its range. A fill counts once the watermark less ``within`` has passed it.
    """
    ms = int(pd.Timedelta(within).total_seconds() * 1000)
    f = fills.withWatermark("ts", late).select("ts", F.pmod(F.xxhash64("portfolio"), F.lit(DESKS)).alias("desk"), F.unix_millis("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), "portfolio", "symbol", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    p = prices.withWatermark("ts", late).select("ts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DESKS - 1).cast("long"))).alias("desk"), F.unix_millis("ts").alias("at"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("portfolio"), "symbol", F.lit(None).cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    rows = f.unionByName(p)
    return rows.groupBy("desk").transformWithStateInPandas(Exposure(LIMITS | (limits or {}), start, ms), EXPOSURE, "Append", "EventTime")
