"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.session import stage_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node gets an edge to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a < b
    return up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, get an edge to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(id, component) for every id in a link; the component is its least id.

    A link to itself says nothing and its id is left out unless it has another; repeated links count once.
    Only whether another round is needed reaches the driver. The rounds grow with the logarithm
    of the longest chain, not with the size of a component.
    """
    a, b = F.col(first), F.col(second)
    edges = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = stage_table(edges, "edges")
    while True:
        # done when every node has one edge, to a node that has none to a smaller one
        parents = edges.groupBy("a").agg(F.count("*").alias("n"))
        roots = edges.select(F.col("b").alias("a")).distinct()
        open_ = parents.where("n > 1").select("a").union(parents.join(roots, "a", "left_semi").select("a"))
        if open_.isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        edges = stage_table(_small_star(_large_star(edges)), "edges")
