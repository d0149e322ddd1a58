"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import written


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, once each."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return _ordered(moved)


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or stands on both sides: not yet one star per component."""
    sides = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    ends = sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the root is the smallest node of its component.

    Each round is written to the shared folder and read back, so lineage stays
    short and a lost executor costs one round at most. The number of rounds grows
    with the logarithm of the longest path; only whether it is done reaches the
    driver. A node with many neighbours is met by aggregation before the shuffle
    and by joins that Spark splits where they are skewed.
    """
    edges = written(_ordered(edges), f"{name}_edges")
    while _unsettled(edges):
        edges = written(_small_star(_large_star(edges)), f"{name}_round")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
