"""Spatial joins by grid cells: Spark has no hash join for distances, so the smaller side is spread over the cells it can
reach, joined by cell, and filtered by the true distance. Minima and maxima are aggregates with partial sums. Where a result
depends on places alone, each place of either side meets the other once, and its rows take what it has found."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from hazgrid.functions.geo import METRES_PER_DEGREE, cell, meters, ring_contains


def _spread(refs: DataFrame, size: float, reach_m: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``refs`` once for each cell within reach; the window of longitudes widens with latitude."""
    rows = math.ceil(reach_m / METRES_PER_DEGREE / size)
    columns = F.ceil(F.lit(reach_m / METRES_PER_DEGREE / size) / F.greatest(F.cos(F.radians(F.abs(F.col(lat)) + rows * size)), F.lit(0.05))).cast("int")
    refs = refs.withColumn("_row", F.explode(F.transform(F.sequence(F.lit(-rows), F.lit(rows)), lambda d: cell(F.col(lat), size) + d)))
    return refs.withColumn("_column", F.explode(F.transform(F.sequence(-columns, columns), lambda d: cell(F.col(lon), size) + d)))


def within(points: DataFrame, refs: DataFrame, reach_m: float, size: float, how: str = "inner", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ``points`` (lat, lon, ...) and ``refs`` (ref_lat, ref_lon, ...) nearer than ``reach_m``, with meters; only those
    that are alike in the columns ``on``."""
    near = _spread(refs, size, reach_m, "ref_lat", "ref_lon")
    points = points.withColumns({"_row": cell(F.col("lat"), size), "_column": cell(F.col("lon"), size)})
    pairs = points.join(near, [*on, "_row", "_column"], how).drop("_row", "_column")
    pairs = pairs.withColumn("meters", meters(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon")))
    return pairs.where(F.col("meters") < reach_m)


def places(points: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Each place (lat, lon) of ``points`` once, for what depends on the place (and the columns ``on``) alone: points that share
    one don't each meet what is near."""
    return points.select(*on, "lat", "lon").distinct()


def nearest_known(points: DataFrame, refs: DataFrame, keys: list[str], ref_key: str, reach_m: float, size: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ref_key, meters) of the nearest ref within reach of each point that has one, the least ref_key on ties. Only refs that
    are alike in the columns ``on`` count. Places meet places, each with its least ref_key."""
    least = refs.groupBy(*on, "ref_lat", "ref_lon").agg(F.min(ref_key).alias(ref_key))
    best = within(places(points, on), least, reach_m, size, on=on).groupBy(*on, "lat", "lon").agg(F.min(F.struct("meters", ref_key)).alias("_b"))
    best = points.join(best, [*on, "lat", "lon"]).groupBy(*keys).agg(F.min("_b").alias("_b"))
    return best.select(*keys, F.col(f"_b.{ref_key}").alias(ref_key), F.col("_b.meters").alias("meters"))


def nearest(points: DataFrame, refs: DataFrame, key: str, ref_key: str, reach_m: float, size: float) -> DataFrame:
    """(key, ref_key, meters) of each point's nearest ref within reach, the least ref_key on ties; null without one."""
    return points.select(key).join(nearest_known(points, refs, [key], ref_key, reach_m, size), key, "left")


def nearest_few(points: DataFrame, refs: DataFrame, key: str, ref_key: str, reach_m: float, size: float, k: int, distance: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, ref_key, meters, distance, rank) of each point's first ``k`` refs within reach, by ``distance`` (of meters and the
    columns ``by``; without one, meters), then by ref_key. Of refs that share a place and ``by``, none but the first ``k`` can
    be among them, and points of one place have the same ones; so neither meets the other row by row."""
    few = refs.withColumn("_n", F.row_number().over(Window.partitionBy("ref_lat", "ref_lon", *by).orderBy(ref_key))).where(F.col("_n") <= k)
    near = within(places(points), few.select("ref_lat", "ref_lon", *by, ref_key), reach_m, size)
    near = near.withColumn("distance", F.col("meters") if distance is None else distance)
    first = Window.partitionBy("lat", "lon").orderBy("distance", ref_key)
    near = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).select("lat", "lon", ref_key, "meters", "distance")
    again = Window.partitionBy(key).orderBy("distance", ref_key)  # for keys of several rows
    found = points.select(key, "lat", "lon").join(near, ["lat", "lon"]).withColumn("rank", F.row_number().over(again))
    return found.where(F.col("rank") <= k).select(key, ref_key, "meters", "distance", "rank")


def beside(points: DataFrame, refs: DataFrame, key: str, reach_m: float, size: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(key) of the points that have a ref within reach, among those that are alike in the columns ``on``; places meet places."""
    near = within(places(points, on), refs.select(*on, "ref_lat", "ref_lon").distinct(), reach_m, size, on=on).select(*on, "lat", "lon").distinct()
    return points.join(near, [*on, "lat", "lon"], "left_semi").select(key).distinct()


def counts(points: DataFrame, refs: DataFrame, key: str, reach_m: float, size: float) -> DataFrame:
    """(key, n, nearest): refs within reach of each point that has any, and metres to the nearest. Refs of a place count at once."""
    held = refs.groupBy("ref_lat", "ref_lon").agg(F.count("*").alias("_n"))
    near = within(places(points), held, reach_m, size).groupBy("lat", "lon").agg(F.sum("_n").alias("n"), F.min("meters").alias("nearest"))
    return points.select(key, "lat", "lon").join(near, ["lat", "lon"]).groupBy(key).agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))


def best_score(points: DataFrame, feed: DataFrame, key: str, base: Column, reach_m: float, size: float, score: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, score): the greatest ``score`` over the rows of ``feed`` within reach, null without one. ``base`` is a column of the
    feed, ``score`` one of base, meters and the columns ``by`` that doesn't fall as base rises; so the greatest base of a place
    stands for all of it, and places meet places."""
    most = feed.withColumn("base", base).groupBy("ref_lat", "ref_lon", *by).agg(F.max("base").alias("base"))
    best = within(places(points), most, reach_m, size).groupBy("lat", "lon").agg(F.max(score).alias("score"))
    best = points.select(key, "lat", "lon").join(best, ["lat", "lon"]).groupBy(key).agg(F.max("score").alias("score"))
    return points.select(key).join(best, key, "left")


def decay_max(points: DataFrame, feed: DataFrame, key: str, base: Column, reach_m: float, size: float, fall: float = 1.0) -> DataFrame:
    """(key, score): the greatest base * (1 - fall * distance / reach) over feed points within reach, 0 without one; ``fall`` is 1
    at most."""
    best = best_score(points, feed, key, base, reach_m, size, F.col("base") * (1 - fall * F.col("meters") / reach_m))
    return best.withColumn("score", F.coalesce("score", F.lit(0.0)))


def containing(points: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """Pairs of points (lat, lon, ...) and areas (ring: array of struct(x, y), ...) that hold them, by the even-odd rule."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    areas = areas.withColumns({"_x0": F.array_min(xs), "_x1": F.array_max(xs), "_y0": F.array_min(ys), "_y1": F.array_max(ys)})
    areas = areas.withColumn("_row", F.explode(F.sequence(cell(F.col("_y0"), size), cell(F.col("_y1"), size))))
    areas = areas.withColumn("_column", F.explode(F.sequence(cell(F.col("_x0"), size), cell(F.col("_x1"), size))))
    points = points.withColumns({"_row": cell(F.col("lat"), size), "_column": cell(F.col("lon"), size)})
    pairs = points.join(areas, ["_row", "_column"])
    boxed = pairs.where(F.col("lon").between(F.col("_x0"), F.col("_x1")) & F.col("lat").between(F.col("_y0"), F.col("_y1")))
    return boxed.where(ring_contains(F.col("lon"), F.col("lat"), F.col("ring"))).drop("_row", "_column", "_x0", "_x1", "_y0", "_y1")


def clip(df: DataFrame, south: float, west: float, north: float, east: float, margin: float = 6.0) -> DataFrame:
    """Rows within a box and its margins; the margin of longitude grows with latitude. Both reach the Parquet scan."""
    wide = max(margin, 500_000 / (METRES_PER_DEGREE * max(0.05, math.cos(math.radians(max(abs(south), abs(north)) + margin)))))
    return df.where(F.col("lat").between(south - margin, north + margin) & F.col("lon").between(west - wide, east + wide))


def _vectors(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """A row a vector, NaN where it is null or empty."""
    lists = column.combine_chunks()
    rows, held = np.full((len(lists), wide), np.nan), lists.is_valid().to_numpy(zero_copy_only=False)
    if len(flat := lists.flatten()):
        rows[held] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(held.sum(), wide)
    return rows


def _terms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis, summed term by term."""
    square = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    for k in range(x.shape[-1]):
        square += (x[..., k] - y[..., k]) ** 2
    return np.sqrt(square)


def _rounded(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """Distances of the rows of ``x`` and ``y``, rounded half up: from a product of matrices, and term by term again wherever the
    product's error, ``off`` at most, could change a digit."""
    scale, wide = 10.0**digits, x.shape[1]
    with np.errstate(all="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        off = (wide + 8) * 1e-15 * (xx.max() + yy.max())
        v = x @ y.T
        v *= -2
        v += xx[:, None]
        v += yy
        np.sqrt(v, out=v)
        v *= scale
        whole = np.floor(v)
        part = v - whole
        # Not a number counts as unsure too.
        unsure = ~((np.abs(part - 0.5) > scale * scale * off / v + 1e-15 * v) & (v > 2 * scale * math.sqrt(off)))
        i, j = np.nonzero(unsure)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            again = _terms(x[a], y[b]) * scale
            whole[a, b] = np.floor(again)
            part[a, b] = again - whole[a, b]
        whole += part >= 0.5
        whole /= scale
    return whole


def query_distances(df: DataFrame, key: str, vector: str, asked: Column, size: int = 1024, digits: int | None = None) -> DataFrame:
    """(a, b, distance) from the rows that are ``asked`` for to all others: Euclidean, null where a vector is; rounded half up to
    ``digits`` if given. The asked rows fall into blocks of about ``size`` and meet every row by block; a task holds one block of
    each side. Vectors have one length."""
    v = F.col(vector) if df.schema[vector].dataType == ArrayType(FloatType()) else F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), v.alias("v"), asked.alias("asked"))
    n, n_asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    blocks, others = max(1, math.ceil(n_asked / size)), max(8, math.ceil(n / size))
    hashed = lambda k: F.pmod(F.xxhash64("key"), F.lit(k)).cast("int")
    left = rows.where("asked").withColumn("row", hashed(blocks)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("row", "col", "key", "v")
    right = rows.withColumn("col", hashed(others)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(*(F.col(c).alias(c) for c in ("row", "col", "key", "v")))  # fresh columns: both sides come from one table

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        keys, their = a["key"].to_numpy(), b["key"].to_numpy()
        wide = max(pc.max(pc.list_value_length(t["v"])).as_py() or 1 for t in (a, b))
        other = keys[:, None] != their
        distance = np.empty(other.shape)
        if other.size:
            x, y = _vectors(a["v"], wide), _vectors(b["v"], wide)
            for at in range(0, len(x), 64):  # as many as stay in a core's cache
                part = x[at : at + 64]
                distance[at : at + 64] = _terms(part[:, None], y) if digits is None else _rounded(part, y, digits)
        some = [np.broadcast_to(keys[:, None], other.shape)[other], np.broadcast_to(their, other.shape)[other], distance[other]]
        return pa.table({"a": some[0], "b": some[1], "distance": pa.array(some[2], from_pandas=True)})

    return left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(one, "a long, b long, distance double")
