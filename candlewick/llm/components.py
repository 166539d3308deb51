"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows that a partition of a round's table should have.
ROWS = 100_000


def _pairs(df: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v."""
    return df.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge list ``(u, v)`` of longs reaches.

    Each round links nodes to smaller ones and keeps the edge count near the node count; stars are the fixed point.
    Only the sizes of a round's table come to the driver. Nodes without edges do not appear.
    """
    now, before = cut(_pairs(edges).distinct()), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # By its upper end an edge list is even (a centre is the lower end of its edges), so one shuffle serves for all that follows.
        down = _pairs(large).repartition("u").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        now = cut(_pairs(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))).distinct())
        # A star forest has each node below one other, and no centre below any. The count serves for the next reads, too.
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        now = now.coalesce(max(1, -(-state["n"] // ROWS)))
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
