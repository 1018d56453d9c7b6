"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges (u, v), u over v, is either a root or the leaf of one root."""
    ends = edges.select("u", F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.lit(1).alias("root")))
    seen = ends.groupBy("u").agg(F.max("root").alias("root"), F.sum(1 - F.col("root")).alias("leaf"))
    return seen.where("leaf > 1 or (leaf = 1 and root = 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round is two grouped minima with map-side partial aggregation and two equi-joins;
    the minima, written first, meet the edges in a plain join, which adaptive execution splits where a node has very
    many links; rounds grow with the log of the longest chain. They end when only stars are left, which one grouped
    count tells.
    """
    current = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "large")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = keep(small, "edges")
        for old in (current, large):
            drop_kept(old)
        current = following
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
