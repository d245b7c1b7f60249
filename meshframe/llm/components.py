"""Connected components of an edge table by alternating large and small stars; nothing passes through the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import store


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge in edges (a long, b long); root is the least node of its component.

    Loops and repeated or reversed edges do no harm. Each round links every node's larger neighbours to its
    least one, then its smaller ones, as distinct edges; the rounds grow with the logarithm of the diameter.
    """
    edges = store.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store.stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (from larger to smaller nodes) are stars apart from each other: no node has two edges down, or edges on both sides."""
    ends = edges.selectExpr("a node", "1 down").unionByName(edges.selectExpr("b node", "0 down"))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least")).filter("down > 1 or down > least").isEmpty()
