"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinfer.session import cut


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each right end has one left end, and no left end is a right end."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("right"), F.lit(0).alias("left")).union(
        edges.select("a", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("right").alias("right"), F.max("left").alias("left"))
    return seen.where((F.col("right") > 1) | (F.col("right") * F.col("left") > 0)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b); root is the least node of the component.

    Each round links every node's larger neighbours, then its smaller ones, to the least
    of them. Minima are combined before the shuffle; no neighbourhood is gathered in one
    place. The number of rounds is logarithmic in the longest path.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e = cut(e)
    while not _is_forest_of_stars(e):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        # The row that holds the minimum itself stands for the edge to it.
        small = large.join(least, "b").select(
            F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")
        )
        e = cut(small.distinct())
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
