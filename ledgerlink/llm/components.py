"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.llm.tables import stage


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node go to the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both).select("v", F.least("v", "low").alias("low"))
    return both.where("b > a").join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    moved = down.join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select(F.col("v").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Both steps keep components and only ever combine minima, so a node with very many edges is
    aggregated before the shuffle; rounds grow with the logarithm of the longest path. Each round
    is a table in the shared folder.
    """
    current = stage(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        current = stage(_small_star(_large_star(current)), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
