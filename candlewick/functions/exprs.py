"""Column expressions shared by all operators. NULL stands for every undefined value, never NaN."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: z of 95 and 99 per cent (fixed values).
Z95, Z99 = 1.6448536270, 2.3263478740
#: Modulus of the repeatable draws.
PRIME = 2147483647


def over(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def frame(n: int, *keys: str, order: str = "ts") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return over(*keys, order=order).rowsBetween(-(n - 1), 0)


def running(*keys: str, order: str = "ts") -> WindowSpec:
    return over(*keys, order=order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def roll(agg: Callable[[Column], Column], x: Column, n: int, *keys: str, gate: int | None = None) -> Column:
    """A rolling aggregate that is NULL until its frame holds ``gate`` (n) values that are not null."""
    w = frame(n, *keys)
    return F.when(F.count(x).over(w) == (n if gate is None else gate), agg(x).over(w))


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x between the bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(x: Column) -> Column:
    """Not null, NaN or infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def norm_cdf(z: Column) -> Column:
    """Normal distribution function by Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.signum(z) * erf)


def unbiased_skew(g1: Column, n: Column) -> Column:
    return g1 * F.sqrt(n * (n - 1)) / (n - 2)


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    """Excess kurtosis, corrected for bias."""
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def draw(seed: int, sim: Column, slot: Column) -> Column:
    """A repeatable pseudo-random BIGINT below PRIME; the same in any engine and any partitioning."""
    x = F.pmod(F.lit(seed).cast("long") * 1103515245 + sim.cast("long") * 1664525 + slot.cast("long") * 22695477, F.lit(PRIME).cast("long"))
    y = F.pmod(x * x + 12345, F.lit(PRIME).cast("long"))
    return F.pmod(y * y + x + 67891, F.lit(PRIME).cast("long"))


def ema_stages(name: str, x: str, keys: tuple[str, ...], alpha: float) -> tuple[dict[str, Callable[[], Column]], ...]:
    """Stages of columns that end with ``name``: the exponential mean of column ``x``, seeded with its first value.

    Rows are cut into blocks over which (1 - alpha) falls by e^18. Within a block the mean is a running sum of values that
    are weighted from the block's start; before it, what the two last blocks end with (the error is below 1e-15).
    """
    decay, c = 1.0 - alpha, F.col
    rows = max(1, int(18 / -math.log(decay)))
    block, at, own, last, carry = (f"_{name}_{k}" for k in ("block", "at", "own", "last", "carry"))
    before = over(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ends = lambda v: F.last(F.when(c(at) == rows - 1, v), ignorenulls=True).over(before)
    power = lambda n: F.pow(F.lit(decay), n)
    weighted = lambda: F.when(c("_row") == 0, c(x) / alpha).otherwise(c(x)) * power(-c(at))
    return (
        {"_row": lambda: F.row_number().over(over(*keys)) - 1},
        {block: lambda: F.floor(c("_row") / rows), at: lambda: F.pmod(c("_row"), F.lit(rows))},
        {own: lambda: alpha * power(c(at)) * F.sum(weighted()).over(running(*keys, block))},
        {last: lambda: ends(c(own))},
        {carry: lambda: ends(c(own) + power(F.lit(rows)) * F.coalesce(c(last), F.lit(0.0)))},
        {name: lambda: c(own) + power(c(at) + 1) * F.coalesce(c(carry), F.lit(0.0))},
    )


def r6(x: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
