"""The nearest row of another table, however far it is.

First a ring of one cell around each point, by the join of ``spatial.within``; what has found nothing goes on to a wider
ring. A ref within a ring's reach is nearer than all beyond it, so a point that finds one is done and the remainder shrinks.
What even the widest ring leaves descends a pyramid of cells: from the boxes of the refs in a few large cells, those that can
hold the nearest one are kept, then their children, down to cells of the first size. Far points cost a few cells each,
not the refs of a whole region.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions.geo import METRES_PER_DEGREE, cell, meters
from hazgrid.operators import spatial
from hazgrid.operators.shared import settled

#: Reach of the rings, in cells; children along a side of a pyramid's cell; what bounds may be off by, relatively.
RINGS, SIDE, SLACK = (1, 4), 4, 1e-9


def nearest_anywhere(points: DataFrame, refs: DataFrame, key: str, ref_key: str, size: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(key, ref_key, meters) of the ref (ref_lat, ref_lon) nearest to each point (key, lat, lon), the least ref_key on ties; among
    those that are alike in the columns ``on``, if any. Null where there is none, or a place is null. Cells are ``size``
    degrees wide; ``key`` tells points apart."""
    refs = refs.where(F.col("ref_lat").isNotNull() & F.col("ref_lon").isNotNull()).select(*on, ref_key, F.col("ref_lat").cast("double").alias("ref_lat"), F.col("ref_lon").cast("double").alias("ref_lon"))
    all_points = points.select(key, *on, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rest, found = all_points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), None
    for ring in RINGS:
        reach = ring * size * METRES_PER_DEGREE
        if ring == RINGS[0]:
            pairs = spatial.within(rest, refs, reach, ring * size, on=on)
        else:  # few points are left: they are spread over cells, not the refs
            swapped = rest.select(key, *on, F.col("lat").alias("_y"), F.col("lon").alias("_x"))
            near = spatial.within(refs.withColumnsRenamed({"ref_lat": "lat", "ref_lon": "lon"}), swapped.withColumnsRenamed({"_y": "ref_lat", "_x": "ref_lon"}), reach, ring * size, on=on)
            pairs = near.select(key, ref_key, "meters")
        best = settled(_best(pairs, key, ref_key))
        found = best if found is None else found.unionByName(best)
        rest = settled(rest.join(best, key, "left_anti"))
        if rest.isEmpty():
            break
    else:
        found = found.unionByName(_descended(rest, refs, key, ref_key, size, on))
    return all_points.select(key).join(found, key, "left")


def _best(pairs: DataFrame, key: str, ref_key: str) -> DataFrame:
    best = pairs.groupBy(key).agg(F.min(F.struct("meters", ref_key)).alias("_b"))
    return best.select(key, F.col(f"_b.{ref_key}").alias(ref_key), F.col("_b.meters").alias("meters"))


def _bounds(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres from a place to a box (s, n, w, e) at least and at most, by the same formula as between places."""
    zero = F.lit(0.0)
    lowest, highest = (lat + F.col("s")) / 2, (lat + F.col("n")) / 2
    near_y, near_x = F.greatest(F.col("s") - lat, lat - F.col("n"), zero), F.greatest(F.col("w") - lon, lon - F.col("e"), zero)
    far_y, far_x = F.greatest(F.abs(lat - F.col("s")), F.abs(lat - F.col("n"))), F.greatest(F.abs(lon - F.col("w")), F.abs(lon - F.col("e")))
    steep = F.greatest(F.abs(lowest), F.abs(highest))
    flat = F.when((lowest <= 0) & (highest >= 0), zero).otherwise(F.least(F.abs(lowest), F.abs(highest)))
    metres = lambda y, x, a: METRES_PER_DEGREE * F.sqrt(y * y + F.pow(x * F.cos(F.radians(a)), 2))
    return metres(near_y, near_x, steep) * (1 - SLACK), metres(far_y, far_x, flat) * (1 + SLACK)


def _descended(points: DataFrame, refs: DataFrame, key: str, ref_key: str, size: float, on: tuple[str, ...]) -> DataFrame:
    top = math.ceil(math.log(90 / size, SIDE)) if size < 90 else 0
    level = refs.groupBy(*on, cell(F.col("ref_lat"), size).alias("_row"), cell(F.col("ref_lon"), size).alias("_column"))
    boxes = [settled(level.agg(*_box("ref_lat", "ref_lat", "ref_lon", "ref_lon")))]
    parent = lambda c: F.floor(F.col(c) / SIDE).cast("long").alias(c)
    for _ in range(top):
        boxes.append(settled(boxes[-1].groupBy(*on, parent("_row"), parent("_column")).agg(*_box("s", "n", "w", "e"))))
    wide = size * SIDE**top  # 90 degrees at least: a handful of cells
    cells = lambda low, high: F.explode(F.sequence(*(F.lit(math.floor(d / wide)).cast("long") for d in (low, high))))
    among = points.withColumn("_row", cells(-90, 90)).withColumn("_column", cells(-540, 540))
    for boxed in reversed(boxes):
        here = among.join(boxed, [*on, "_row", "_column"])
        least, most = _bounds(F.col("lat"), F.col("lon"))
        here = here.withColumns({"_least": least, "_most": most})
        here = here.withColumn("_cut", F.min("_most").over(Window.partitionBy(key))).where(F.col("_least") <= F.col("_cut")).select(*points.columns, "_row", "_column")
        among = here
        if boxed is not boxes[0]:
            children = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda d: F.col(c) * SIDE + d))
            among = among.withColumn("_r", children("_row")).withColumn("_c", children("_column")).drop("_row", "_column").withColumnsRenamed({"_r": "_row", "_c": "_column"})
    rows = refs.withColumns({"_row": cell(F.col("ref_lat"), size), "_column": cell(F.col("ref_lon"), size)})
    pairs = among.join(rows, [*on, "_row", "_column"]).withColumn("meters", meters(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon")))
    return _best(pairs, key, ref_key)


def _box(s: str, n: str, w: str, e: str) -> list[Column]:
    return [F.min(s).alias("s"), F.max(n).alias("n"), F.min(w).alias("w"), F.max(e).alias("e")]
