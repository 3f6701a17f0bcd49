"""Connected components by alternating large and small stars; every round is cut into the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node go to the smallest node around it. Small: those below it, and itself, do."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) of links, any direction, repeats allowed → (node, root) for every node but the roots; root is the least node."""
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while before != (now := state(edges)):
        before = now
        edges = cut(_stars(_stars(edges, large=True), large=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
