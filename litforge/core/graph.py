"""Connected components of large sparse graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litforge.core.session import cut


def _state(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes: equal for equal sets of edges."""
    total = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total(1), total(2)).collect()[0])  # one row


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps: each is one aggregation and one join on the node, every edge list is
    cut into the checkpoint folder, and only a count and two hash sums per round reach the driver, by which an unchanged
    list is told. Rounds grow with the logarithm of the longest path. Self-loops keep isolated nodes; null ends are left
    out; an empty table gives no rows.
    """
    now = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(now)
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") >= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
