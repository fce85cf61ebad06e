"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, checkpointed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): component is the least node reachable.

    Rounds grow with the logarithm of a component's size. A node's neighbours never meet in one row: stars are minima by
    node, joined back, so a hub's join can be split like any skewed join. ``checkpointed`` cuts a round's edges loose.
    """
    edges = checkpointed(edges.where(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
        edges = checkpointed(_star(_star(edges, large=True), large=False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
