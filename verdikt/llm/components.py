"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import pin


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round points all neighbours of a node, and the node, at the smallest of
    them, first the larger neighbours (large star), then the smaller ones (small
    star); the edge table never grows.  The minimum of a node is an aggregate
    that is joined back, so a node with very many edges is spread over tasks.
    Rounds stop when the edges no longer change: their count and hash sum are
    compared, which is all that reaches the driver.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    pairs = pin(pairs, "component-edges")
    state = None
    for _ in range(most_rounds):
        pairs = pin(_small_star(_large_star(pairs)), "component-edges")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    own = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(own)


def _large_star(pairs: DataFrame) -> DataFrame:
    """For every node n: (larger neighbour, smallest of n and its neighbours)."""
    both = pairs.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(
        pairs.select(F.col("v").alias("n"), F.col("u").alias("x"))
    )
    least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """For every node n with smaller neighbours: they and n point at the smallest."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u")
    moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
