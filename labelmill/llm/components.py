"""Connected components of an edge table by alternating stars.

Large star joins every larger neighbour of a node to the smallest neighbour, small star does
the same for the smaller ones; the two leave the components as they are and end, after a
number of rounds logarithmic in the longest path, in one star per component whose centre is
the smallest node. Each round is written to the shared folder, so no round depends on the
tasks of an earlier one. The minima are written before a hub's rows meet them, so that nothing
ties the join to the aggregate's partitions and AQE may split the hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    least = stored(least.select("a", F.least("a", "low").alias("low")), "least")
    up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return up.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a > b`` in every row: all smaller neighbours of ``a`` are tied to the smallest."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("low")), "least")
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = least.select("a", F.col("low").alias("b"))
    return tied.where("a > b").unionByName(own).distinct()


def _state(edges: DataFrame) -> tuple:
    hashes = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashes)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node.

    Loops are dropped, so a node with no other edge has no row; an empty table gives none.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = stored(e.distinct(), "edges")
    before, now = None, _state(e)
    while now != before:
        e = stored(_small_star(stored(_large_star(e), "edges")), "edges")
        before, now = now, _state(e)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
