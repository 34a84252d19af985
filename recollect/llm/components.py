"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """`down` has a > b in all rows, repeated ones too."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller node at most, and those that have one are nobody's smaller node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("below")).union(edges.select("b", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("below").alias("below"))
    return each.where("up > 1 OR up > 0 AND below > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: bigint); root is the smallest node reachable.

    Null ends and loops are left out. Each step is a written table, so that lineage and plans stay short: the driver
    keeps and logs each plan at each of its stages. Only whether all edges are stars, each a component with its
    smallest node in the middle, reaches the driver.
    A node of very many edges meets its minimum in a sort-merge join, which adaptive execution splits.
    """
    now = staged(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(now):
        large = staged(_large_star(now), "large")
        after = staged(_small_star(large), "edges")
        discard(now, large)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
