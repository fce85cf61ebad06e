"""Greedy clusters, thinning and hulls of marks on a map.

Clusters and thinning are sequential by definition: rounds over grid cells find the same marks, whatever their number. Hulls
are those of slices' hulls.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.operators.shared import settled


def seeds(marks: DataFrame, keys: list[str], least: float) -> DataFrame:
    """The marks (keys, id, lat, lon, score) that stay when, of each key from the best score on, every mark nearer than ``least``
    (in degrees, on the plane) to one that stayed goes; ties go to the least id. Equal to one pass over all marks in order.

    Rounds over grid cells so small that marks of a cell exclude each other: a cell's best open mark stays if no open mark of
    the cells within reach is better, and what stays closes all marks near it. The best open mark of all always stays, so
    every round gets on; a cell is one row to its neighbours, so no group of marks is gathered and no pairs within a cell
    are made."""
    size = least / math.sqrt(2)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    rank = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    open_ = settled(marks.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*keys, "id", "lat", "lon", rank.alias("_rank"), cell("lat").alias("_row"), cell("lon").alias("_column")))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    kept = None
    while not open_.isEmpty():
        best = open_.groupBy(*keys, "_row", "_column").agg(F.min(F.struct("_rank", "id", "lat", "lon")).alias("b"))
        seen = best.select(*keys, around.alias("o"), "_row", "_column", "b").select(*keys, (F.col("_row") + F.col("o.i")).alias("_row"), (F.col("_column") + F.col("o.j")).alias("_column"), F.col("b._rank").alias("_near"))
        least_near = seen.groupBy(*keys, "_row", "_column").agg(F.min("_near").alias("_near"))
        new = best.join(least_near, [*keys, "_row", "_column"]).where(F.col("b._rank") == F.col("_near")).select(*keys, "_row", "_column", "b.id", "b.lat", "b.lon")
        new = settled(new)
        kept = new if kept is None else kept.unionByName(new)
        refs = new.select(*keys, F.col("lat").alias("_y"), F.col("lon").alias("_x"), around.alias("o"), "_row", "_column").select(*keys, "_y", "_x", (F.col("_row") + F.col("o.i")).alias("_row"), (F.col("_column") + F.col("o.j")).alias("_column"))
        closed = open_.join(refs, [*keys, "_row", "_column"]).where(F.hypot(F.col("lat") - F.col("_y"), F.col("lon") - F.col("_x")) < least).select(*keys, "id").distinct()
        open_ = settled(open_.join(closed, [*keys, "id"], "left_anti"))
    return marks.limit(0).select(*keys, "id", "lat", "lon") if kept is None else kept.select(*keys, "id", "lat", "lon")


def greedy_clusters(marks: DataFrame, key: str, least: float) -> DataFrame:
    """marks (key, id, kind, lat, lon, score): by score, each joins the best seed of its kind and key nearer than ``least``, or
    becomes one. One row a cluster: key, seed, kind, lat and lon weighted by score, n."""
    size = least / math.sqrt(2)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    found = seeds(marks, [key, "kind"], least).join(marks.select(key, "kind", "id", "score"), [key, "kind", "id"])
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    refs = found.select(key, "kind", F.struct((-F.col("score")).alias("s"), F.col("id").alias("seed")).alias("_rank"), F.col("lat").alias("_y"), F.col("lon").alias("_x"), cell("lat").alias("_r"), cell("lon").alias("_c"), around.alias("o"))
    refs = refs.select(key, "kind", "_rank", "_y", "_x", (F.col("_r") + F.col("o.i")).alias("_row"), (F.col("_c") + F.col("o.j")).alias("_column"))
    pairs = marks.withColumns({"_row": cell("lat"), "_column": cell("lon")}).join(refs, [key, "kind", "_row", "_column"]).where(F.hypot(F.col("lat") - F.col("_y"), F.col("lon") - F.col("_x")) < least)
    joined = pairs.groupBy(key, "kind", "id", "lat", "lon", "score").agg(F.min("_rank").alias("_rank"))
    w = F.greatest("score", F.lit(1e-4))
    mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
    return joined.groupBy(key, F.col("_rank.seed").alias("seed"), "kind").agg(mean("lat"), mean("lon"), F.count("*").alias("n"))


def declutter(marks: DataFrame, key: str, least: float) -> DataFrame:
    """The marks kept when each nearer than ``least`` to a better one that is kept goes."""
    return marks.join(seeds(marks, [key], least).select(key, "id"), [key, "id"], "left_semi")


def hulls(points: DataFrame, key: str, slices: int = 64) -> DataFrame:
    """The convex hull of each group's points: corners (key, corner, x, y) anticlockwise; two points or fewer are themselves.
    Each of ``slices`` slices of a group gives the corners of its own hull, and only those meet: a group may be large."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        p = sorted(set(zip(frame["x"], frame["y"], strict=True)))

        def chain(points):
            out: list = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                    out.pop()
                out.append(q)
            return out[:-1]

        corners = p if len(p) < 3 else chain(p) + chain(p[::-1])
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(corners), "corner": range(len(corners)), "x": [c[0] for c in corners], "y": [c[1] for c in corners]})

    shape = f"{key} long, corner int, x double, y double"
    sliced = points.withColumn("_slice", F.pmod(F.xxhash64("x", "y"), F.lit(slices)))
    return sliced.groupBy(key, "_slice").applyInPandas(one, shape).groupBy(key).applyInPandas(one, shape)
