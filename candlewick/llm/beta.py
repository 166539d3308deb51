"""Beta-binomial shrinkage in DataFrame functions: fitted strength of a prior, and quantiles of a posterior."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prior counts as so many observations at least and at most; groups that all agree get the most.
LEAST, MOST = 1.0, 1000.0
#: Cells of the grid on which a posterior's density is added up, over 8 deviations to either side of the mean.
CELLS = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row and not once for each use."""
    return F.transform(F.array(value), body)[0]


def strength(n: Column, bad: Column, mean: Column) -> Column:
    """Aggregate over groups (n, bad, prior mean of each): how many observations their common prior is worth, by moments.

    A group's rate has the variance m (1 - m) (1 + (n - 1) r) / n around its prior mean m, with r = 1 / (strength + 1).
    """
    own = mean * (1 - mean)
    surplus = F.sum(n * (bad / n - mean) * (bad / n - mean)) - F.sum(own)
    r = F.try_divide(surplus, F.sum(own * (n - 1)))
    return F.when(r > 1 / (MOST + 1), F.greatest(F.lit(LEAST), 1 / r - 1)).otherwise(F.lit(MOST))


def strength_sql(n: str, bad: str, mean: str) -> str:
    own = f"({mean}) * (1 - ({mean}))"
    r = f"(sum({n} * ({bad} / {n} - ({mean})) * ({bad} / {n} - ({mean}))) - sum({own})) / nullif(sum({own} * ({n} - 1)), 0)"
    return f"CASE WHEN {r} > 1 / {MOST + 1} THEN greatest({LEAST}, 1 / ({r}) - 1) ELSE {MOST} END"


def quantile(a: Column, b: Column, q: float) -> Column:
    """The q-quantile of a beta distribution: its density is added up over a grid and interpolated within a cell."""

    def placed(p: Column) -> Column:
        mean = p["a"] / (p["a"] + p["b"])
        sd = F.sqrt(mean * (1 - mean) / (p["a"] + p["b"] + 1))
        low, high = F.greatest(F.lit(0.0), mean - 8 * sd), F.least(F.lit(1.0), mean + 8 * sd)
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), mean.alias("m"), low.alias("low"), ((high - low) / CELLS).alias("cell"))

    def weighted(g: Column) -> Column:
        def weight(i: Column) -> Column:
            t = g["low"] + (i - 0.5) * g["cell"]
            return F.exp((g["a"] - 1) * F.ln(t / g["m"]) + (g["b"] - 1) * F.ln((1 - t) / (1 - g["m"])))

        return F.struct(g["low"].alias("low"), g["cell"].alias("cell"), F.transform(F.sequence(F.lit(1), F.lit(CELLS)), weight).alias("w"))

    def found(g: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            here = (acc["left"] > 0) & (acc["left"] <= w)
            return F.struct((acc["left"] - w).alias("left"), F.when(here, acc["at"] + acc["left"] / w).when(acc["left"] > 0, acc["at"] + 1).otherwise(acc["at"]).alias("at"))

        start = F.struct((q * F.aggregate(g["w"], F.lit(0.0), lambda s, w: s + w)).alias("left"), F.lit(0.0).alias("at"))
        return F.aggregate(g["w"], start, step, lambda acc: g["low"] + acc["at"] * g["cell"])

    shape = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    return let(let(let(shape, placed), weighted), found)


def quantile_sql(table: str, key: str, a: str, b: str, q: float) -> str:
    """A query for (key, q): the same quantile for each row of a table."""
    return f"""SELECT {key}, min(low + (i - 1 + (want - (cum - w)) / w) * cell) AS q FROM (
    SELECT *, sum(w) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, {q} * sum(w) OVER (PARTITION BY {key}) AS want FROM (
      SELECT *, exp((a - 1) * ln((low + (i - 0.5) * cell) / m) + (b - 1) * ln((1 - (low + (i - 0.5) * cell)) / (1 - m))) AS w FROM (
        SELECT {key}, a, b, m, greatest(0, m - 8 * sd) AS low, (least(1, m + 8 * sd) - greatest(0, m - 8 * sd)) / {CELLS} AS cell FROM (
          SELECT *, sqrt(m * (1 - m) / (a + b + 1)) AS sd FROM (SELECT {key}, {a} AS a, {b} AS b, ({a}) / (({a}) + ({b})) AS m FROM {table}))), range(1, {CELLS + 1}) AS r(i)))
  WHERE cum >= want AND cum - w < want GROUP BY {key}"""
