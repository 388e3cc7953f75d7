"""Connected components by alternating large-star and small-star rounds, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = e.select("u", "v").union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v")))


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars already: no node has two links down, or links both down and up."""
    ends = e.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.count_if(F.expr("down > 1 or (down > 0 and up > 0)"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs to (node, root): each node of an edge with the least node it can reach.

    The edge set never outgrows its first size by more than a constant, hot nodes are only ever partially aggregated or
    on the splittable side of a join, and rounds are logarithmic in the length of the longest chain. Nulls and loops are
    left out; no edges give no rows. The tables of earlier rounds are deleted.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "links")
    while not _settled(e):
        last, e = e, written(_small_star(_large_star(e).filter("u <> v").distinct()).filter("u <> v").distinct(), "links")
        discard(last)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
