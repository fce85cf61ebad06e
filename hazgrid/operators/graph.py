"""Shortest paths, components and timetable rounds over edge tables. Each round is a join and an aggregate, its result cut
loose by checkpoint(); no round's rows come to the driver, only whether anything changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.operators.shared import settled, settled_by
from hazgrid.operators.stars import connected_components


def shortest_paths(edges: DataFrame, source, rounds: int | None = None) -> DataFrame:
    """(node, dist) reachable from ``source`` over edges (src, dst, w): rounds of relaxation until none changes. An edge without
    a weight leads nowhere; a negative weight is an error, and so is a limit of ``rounds`` that is hit before the end.
    Edges are spread by ``src`` once and stay so: a round moves only the nodes that changed and what they reach."""
    edges = settled_by(edges.where(F.col("w").isNotNull()).select("src", "dst", "w"), "src")
    if not edges.where(F.col("w") < 0).isEmpty():
        raise ValueError("shortest paths over a negative weight")
    dist = edges.sparkSession.createDataFrame([(source, 0.0)], "node long, dist double")
    frontier, done = dist, 0
    while rounds is None or done < rounds:
        reached = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        both = settled(dist.join(reached, "node", "full").select("node", "dist", F.least("dist", "new").alias("best")))
        frontier = both.where(F.col("dist").isNull() | (F.col("best") < F.col("dist"))).select("node", F.col("best").alias("dist"))
        dist, done = both.select("node", F.col("best").alias("dist")), done + 1
        if frontier.isEmpty():
            return dist
    raise RuntimeError(f"distances still change after {rounds} rounds")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (src, dst). Rounds grow with the logarithm of a
    component's size. A node that meets only itself is a component."""
    edges = settled(edges.select("src", "dst"))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    found = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), settled)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
