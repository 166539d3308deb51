"""Features of bars. A feature is a list of stages; features share window specs, so a series is sorted once."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, div, ema_stages, frame, over, roll, running, safe_ln

KEYS = ("symbol", "tf")
YEAR = 252


@dataclass(frozen=True)
class Feature:
    """Columns to add, stage by stage; later stages may use the columns of earlier ones. Names with _ are dropped."""

    name: str
    stages: tuple[dict[str, Callable[[], Column]], ...]
    description: str = ""
    kind: str = "technical"
    needs: tuple[str, ...] = ("close",)
    parameters: dict = field(default_factory=dict)


def c(name: str) -> Column:
    return F.col(name)


def together(*chains: tuple) -> tuple:
    """Stages of several chains side by side."""
    return tuple({k: v for chain in chains if i < len(chain) for k, v in chain[i].items()} for i in range(max(map(len, chains))))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(over(*KEYS))


_RET = {"_ret": lambda: div(c("close"), lag("close")) - 1}
_DIFF = {"_diff": lambda: c("close") - lag("close")}
_TR = {"_tr": lambda: F.greatest(c("high") - c("low"), F.abs(c("high") - lag("close")), F.abs(c("low") - lag("close")))}


def returns(n: int = 1, log: bool = False) -> Feature:
    ratio = lambda: div(c("close"), lag("close", n))
    return Feature(f"{'log_' if log else ''}returns_{n}", ({f"{'log_' if log else ''}returns_{n}": (lambda: safe_ln(ratio())) if log else (lambda: ratio() - 1)},), "change over n bars", parameters={"periods": n, "log": log})


def volatility(n: int = 20, annualise: bool = True) -> Feature:
    k = math.sqrt(YEAR) if annualise else 1.0
    return Feature(f"volatility_{n}", (_RET, {f"volatility_{n}": lambda: roll(F.stddev_samp, c("_ret"), n, *KEYS) * k}), "rolling deviation of returns", parameters={"window": n})


def rsi(n: int = 14) -> Feature:
    parts = {"_up": lambda: F.coalesce(F.greatest(c("_diff"), F.lit(0.0)), F.lit(0.0)), "_down": lambda: F.coalesce(F.greatest(-c("_diff"), F.lit(0.0)), F.lit(0.0))}
    means = {f"_gain_{n}": lambda: roll(F.avg, c("_up"), n, *KEYS), f"_loss_{n}": lambda: roll(F.avg, c("_down"), n, *KEYS)}
    value = lambda: F.when(c(f"_loss_{n}") > 0, 100 - 100 / (1 + div(c(f"_gain_{n}"), c(f"_loss_{n}")))).when(c(f"_gain_{n}") > 0, F.lit(100.0))
    return Feature(f"rsi_{n}", (_DIFF, parts, means, {f"rsi_{n}": value}), "relative strength with simple means", parameters={"period": n})


def bollinger(n: int = 20, k: float = 2.0) -> Feature:
    stages = {f"_mid_{n}": lambda: roll(F.avg, c("close"), n, *KEYS), f"_sd_{n}": lambda: roll(F.stddev_samp, c("close"), n, *KEYS)}
    return Feature(f"bb_position_{n}", (stages, {f"bb_position_{n}": lambda: div(c("close") - c(f"_mid_{n}"), 2 * k * c(f"_sd_{n}"))}), "place within the bands; +-0.5 at the bands", parameters={"period": n, "num_std": k})


def true_range() -> Feature:
    return Feature("true_range", ({"true_range": _TR["_tr"]},), "true range", needs=("high", "low", "close"))


def atr(n: int = 14) -> Feature:
    return Feature(f"atr_{n}", (_TR, {f"atr_{n}": lambda: roll(F.avg, c("_tr"), n, *KEYS)}), "mean true range", needs=("high", "low", "close"), parameters={"period": n})


def volume_ma(n: int = 20) -> Feature:
    return Feature(f"volume_ma_{n}", ({f"volume_ma_{n}": lambda: roll(F.avg, c("volume"), n, *KEYS)},), "mean volume", "volume", ("volume",), {"period": n})


def volume_ratio(n: int = 20) -> Feature:
    return Feature(f"volume_ratio_{n}", ({f"_vma_{n}": lambda: roll(F.avg, c("volume"), n, *KEYS)}, {f"volume_ratio_{n}": lambda: div(c("volume"), c(f"_vma_{n}"))}), "volume by its mean", "volume", ("volume",), {"period": n})


def vwap(session: bool = False) -> Feature:
    typical = lambda: (c("high") + c("low") + c("close")) / 3
    keys = (*KEYS, "_day") if session else KEYS
    w = running(*keys)
    return Feature("vwap", ({"_day": lambda: F.to_date("ts")}, {"vwap": lambda: div(F.sum(typical() * c("volume")).over(w), F.sum("volume").over(w))}), "volume-weighted mean price", "volume", ("high", "low", "close", "volume"), {"session": session})


def obv() -> Feature:
    return Feature("obv", (_DIFF, {"obv": lambda: F.sum(F.coalesce(F.signum("_diff") * c("volume"), F.lit(0.0))).over(running(*KEYS))}), "on-balance volume", "volume", ("close", "volume"))


def hl_spread() -> Feature:
    return Feature("hl_spread", ({"hl_spread": lambda: div(c("high") - c("low"), c("close"))},), "range by close", "microstructure", ("high", "low", "close"))


def roll_spread(n: int = 20) -> Feature:
    w = frame(n - 1, *KEYS)
    cov = lambda: F.when(F.count("_prev").over(w) == n - 1, F.covar_samp("_diff", "_prev").over(w))
    return Feature(f"roll_spread_{n}", (_DIFF, {"_prev": lambda: lag("_diff")}, {"_cov": cov}, {f"roll_spread_{n}": lambda: 2 * F.sqrt(F.greatest(-c("_cov"), F.lit(0.0)))}), "spread implied by serial covariance", "microstructure", parameters={"window": n})


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Feature:
    means = together(ema_stages("_fast", "close", KEYS, 2 / (fast + 1)), ema_stages("_slow", "close", KEYS, 2 / (slow + 1)))
    line = ema_stages("macd_signal", "macd", KEYS, 2 / (signal + 1))
    return Feature("macd", (*means, {"macd": lambda: c("_fast") - c("_slow")}, *line[1:], {"macd_histogram": lambda: c("macd") - c("macd_signal")}), "difference of exponential means", parameters={"fast": fast, "slow": slow, "signal": signal})


def adx(n: int = 14) -> Feature:
    moves = {"_hi": lambda: c("high") - lag("high"), "_lo": lambda: lag("low") - c("low")}
    dm = {"_pdm": lambda: F.when((c("_hi") > c("_lo")) & (c("_hi") > 0), c("_hi")).otherwise(0.0), "_mdm": lambda: F.when((c("_lo") > c("_hi")) & (c("_lo") > 0), c("_lo")).otherwise(0.0)}
    means = {"_matr": lambda: roll(F.avg, c("_tr"), n, *KEYS), "_mp": lambda: roll(F.avg, c("_pdm"), n, *KEYS), "_mm": lambda: roll(F.avg, c("_mdm"), n, *KEYS)}
    di = {"_pdi": lambda: 100 * div(c("_mp"), c("_matr")), "_mdi": lambda: 100 * div(c("_mm"), c("_matr"))}
    dx = {"_dx": lambda: 100 * div(F.abs(c("_pdi") - c("_mdi")), c("_pdi") + c("_mdi"))}
    return Feature(f"adx_{n}", ({**_TR, **moves}, dm, means, di, dx, {f"adx_{n}": lambda: roll(F.avg, c("_dx"), n, *KEYS)}), "strength of trend", needs=("high", "low", "close"), parameters={"period": n})


def market_depth(n: int = 20) -> Feature:
    return Feature(f"depth_{n}", ({f"depth_{n}": lambda: roll(F.avg, c("volume"), n, *KEYS)},), "rolling depth", "liquidity", ("volume",), {"window": n})


def amihud(n: int = 20) -> Feature:
    return Feature(f"amihud_{n}", (_RET, {"_illiq": lambda: div(F.abs("_ret"), c("close") * c("volume"))}, {f"amihud_{n}": lambda: roll(F.avg, c("_illiq"), n, *KEYS)}), "mean return by dollar volume", "liquidity", ("close", "volume"), {"window": n})


def liquidity_score(volume: Column, spread_bps: Column, market_cap: Column) -> Column:
    """0 to 100: volume up to 40 (4 a million), 40 less 0.4 a basis point of spread, market capitalisation up to 20 (2 a billion)."""
    return F.least(F.lit(40.0), volume / 1e6 * 4) + F.greatest(F.lit(0.0), 40 - spread_bps * 0.4) + F.least(F.lit(20.0), market_cap / 1e9 * 2)


def pine_set(n: int = 20) -> Feature:
    """Indicator set of the charting script: volatility (population deviation) and its trend, clipped yearly return and
    rate of change as ratios (0 on the first ``n`` bars), Wilder RSI, drawdown from the running peak, and the worst of 60
    bars' drawdowns from the highest close of the 60 bars up to each.
    """
    early = lag("close", n).isNull()
    first = {
        "_ret": _RET["_ret"], "_diff": _DIFF["_diff"], "pine_roc": lambda: F.when(early, 0.0).otherwise(clip(div(c("close"), lag("close", n)) - 1, -1.0, 10.0)),
        "pine_drawdown": lambda: div(c("close"), F.max("close").over(running(*KEYS))) - 1, "_fall": lambda: div(c("close"), roll(F.max, c("close"), 60, *KEYS)) - 1,
    }
    second = {
        "pine_vol": lambda: roll(F.stddev_pop, c("_ret"), n, *KEYS) * math.sqrt(YEAR),
        "_up": lambda: F.coalesce(F.greatest(c("_diff"), F.lit(0.0)), F.lit(0.0)), "_down": lambda: F.coalesce(F.greatest(-c("_diff"), F.lit(0.0)), F.lit(0.0)),
        "pine_ann_return": lambda: F.when(early, 0.0).otherwise(clip(F.pow(div(c("close"), lag("close", n)), F.lit(YEAR / n)) - 1, -1.0, 10.0)),
        "pine_max_drawdown": lambda: roll(F.min, c("_fall"), 60, *KEYS),
    }
    third = {"pine_vol_trend": lambda: F.when(lag("pine_vol", n) > 0, c("pine_vol") / lag("pine_vol", n) - 1).otherwise(0.0)}
    means = together(ema_stages("_g", "_up", KEYS, 1 / 14), ema_stages("_l", "_down", KEYS, 1 / 14))
    return Feature("pine", (first, second, third, *means, {"pine_rsi": lambda: F.when(c("_l") > 0, 100 - 100 / (1 + div(c("_g"), c("_l")))).otherwise(100.0)}), "charting script", needs=("close",), parameters={"lookback": n})


def standard() -> list[Feature]:
    """The preset of twelve."""
    return [returns(1), returns(5), returns(20), volatility(20), rsi(14), bollinger(20), atr(14), volume_ratio(20), obv(), hl_spread(), macd(), adx(14)]


def grouped_feature(bars: DataFrame, name: str, compute: Callable[[pd.DataFrame], pd.Series], reach: int, rows: int = 10_000) -> DataFrame:
    """Adds a column that a caller's function computes from a frame of consecutive bars, for what no expression can say.

    ``reach``: bars before a bar that its value may hang on. A series is cut into groups of ``rows`` bars, each with the
    ``reach`` bars before it, so a group is bounded however long the series is; the function sees them in order.
    """
    x = bars.withColumn("_i", F.row_number().over(over(*KEYS)) - 1)
    own = F.floor(F.col("_i") / rows)
    parts = F.when(F.pmod("_i", F.lit(rows)) >= max(rows - reach, 0), F.array(own, own + 1)).otherwise(F.array(own))
    x = x.withColumn("_g", F.explode(parts))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + f", `{name}` double"

    kept = list(bars.columns)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i")
        values = compute(group.reset_index(drop=True)).to_numpy()
        mine = (group["_i"] // rows == group["_g"]).to_numpy()
        return group[kept].assign(**{name: values})[mine]

    if reach >= rows:
        raise ValueError("groups must be longer than what a value hangs on")
    return x.groupBy(*KEYS, "_g").applyInPandas(run, schema)


class Pipeline:
    """Features computed together, stage by stage, so that equal windows are one sort."""

    def __init__(self, name: str, features: list[Feature] | None = None):
        self.name, self.features = name, list(features or [])

    def add(self, feature: Feature) -> Pipeline:
        self.features.append(feature)
        return self

    def names(self) -> list[str]:
        return [n for f in self.features for stage in f.stages for n in stage if not n.startswith("_")]

    def compute(self, bars: DataFrame, dropna: bool = False) -> DataFrame:
        """All features; one whose input columns are missing becomes a NULL column."""
        work, out = bars, bars.columns
        able = [f for f in self.features if set(f.needs) <= set(bars.columns)]
        for depth in range(max((len(f.stages) for f in able), default=0)):
            stage = {n: make for f in able if depth < len(f.stages) for n, make in f.stages[depth].items() if n not in work.columns}
            if stage:
                work = work.withColumns({n: make() for n, make in stage.items()})
        lost = {n: F.lit(None).cast("double") for f in self.features if f not in able for s in f.stages for n in s if not n.startswith("_")}
        done = work.withColumns(lost).select(*out, *self.names()) if lost else work.select(*out, *self.names())
        return done.dropna(subset=self.names()) if dropna else done

    def config(self) -> dict:
        """Description without the version, and the version: a hash of it."""
        body = {"name": self.name, "features": [{"name": f.name, "kind": f.kind, "parameters": f.parameters, "needs": list(f.needs)} for f in self.features]}
        return body | {"version": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]}

    def catalog(self, spark) -> DataFrame:
        """Feature metadata as a table."""
        rows = [(f.name, f.description, f.kind, list(f.needs), {k: str(v) for k, v in f.parameters.items()}) for f in self.features]
        return spark.createDataFrame(rows, "name string, description string, feature_type string, dependencies array<string>, parameters map<string,string>")
