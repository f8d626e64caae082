"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(stored(least, "least"), "u")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every edge leads straight to the least node of its component: no node is at both ends, or has two edges up."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("root"))
    return seen.filter("ups > 1 OR (ups = 1 AND root = 0)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """`(node, label)` of every node of the edges `(a, b)`: the label is the least node of its component.

    Each round shuffles the edges a few times and stores them; the number of edges never grows, and rounds are about
    the logarithm of the longest chain. A node with very many edges is split by the adaptive skew join: the side that
    holds its least neighbour has one row and is stored first, since Spark does not split a join with an aggregate of the key.
    """
    now = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large.filter("u > v"))
        up = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        now = stored(small.select(up.alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), "edges")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
