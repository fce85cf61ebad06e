"""Lines against lines: which roads run along a route, and which closures it drives.

A road is walked at even steps, and each step looks for the nearest of the route segments that cross its grid cell. Steps in
a row that are near the same route are a stretch; running minima and maxima tell how much of the route it spans. No road
meets a route that isn't near it, and no route is gathered. What is shuffled are the pieces of a road in a cell, each once
for each segment that it comes near. Their steps are never rows: they are laid out as arrays where the sorted pieces of a road
and a route pass through a task, one such pair after the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazgrid.functions.geo import METRES_PER_DEGREE, meters
from hazgrid.functions.roads import posted_limit_counts
from hazgrid.operators import routes

# Metres of a step and steps of a hop at most; metres that a limit and a closure reach; metres of a route that a
# stretch has to span, and the share of its own length.
STEP, MOST_STEPS, LIMIT_REACH, CLOSED_REACH, SPAN, PARALLEL = 10.0, 2000, 20.0, 40.0, 30.0, 0.9


def hops_to_walk(ways: DataFrame, on: list[str], step: float = STEP) -> DataFrame:
    """(way, on, _k0, _j, _n, _y, _x, lat, lon, _before, _hop, length): the hops of ``ways`` (way, seq, lat, lon), walked in _n steps of
    ``step`` metres at most, of which the first is the way's _k0 + 1st; and each way's first vertex, as a hop of one step numbered
    0. _before are the metres up to the hop. Ways of one vertex, or with a place that is no number, have none."""
    w = Window.partitionBy("way").orderBy("seq")
    whole = Window.partitionBy("way")
    hop = meters(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    df = ways.select("way", *on, "seq", "lat", "lon", F.lag("lat").over(w).alias("_y"), F.lag("lon").over(w).alias("_x"), hop.alias("_hop"))
    df = df.withColumns({"length": F.sum("_hop").over(whole), "_all": F.count("*").over(whole), "_before": F.sum("_hop").over(w) - F.col("_hop")})
    df = df.where((F.col("_all") > 1) & ~F.isnan("length") & (F.col("length") < float("inf")))
    n = F.least(F.greatest(F.ceil(F.col("_hop") / step), F.lit(1)), F.lit(MOST_STEPS)).cast("long")
    first = F.col("_hop").isNull()
    df = df.withColumn("_n", F.coalesce(n, F.lit(1).cast("long"))).withColumn("_j", F.when(first, F.lit(0)).otherwise(F.lit(1)).cast("long"))
    df = df.withColumn("_k0", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    start = {"_y": F.col("lat"), "_x": F.col("lon"), "_hop": F.lit(0.0), "_before": F.lit(0.0)}
    return df.withColumns({c: F.when(first, v).otherwise(F.col(c)) for c, v in start.items()}).select("way", *on, *_HOP)


#: What a hop that is walked carries along; its first step is _j, its last one _n (or _j, for a single place).
_HOP = ["_k0", "_j", "_n", "_y", "_x", "lat", "lon", "_before", "_hop", "length"]


def _step(a: str, b: str, k: Column) -> Column:
    """The column at step ``k`` of a hop from ``a`` to ``b``."""
    return F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("_n"))


def pieces(hops: DataFrame, by: list[str], size: float) -> DataFrame:
    """``hops`` (by, ...) cut by cells: a row for each cell (_row, _column) with the steps _from to _to that lie in it, and the places
    of these (_y0, _x0, _y1, _x1)."""
    rest = [c for c in hops.columns if c not in (*by, "_k0")]
    steps = hops.withColumn("_k", F.explode(F.sequence("_j", F.when(F.col("_j") > 0, F.col("_n")).otherwise(F.col("_j")))))
    steps = steps.withColumns({"_row": F.floor(_step("_y", "lat", F.col("_k")) / size), "_column": F.floor(_step("_x", "lon", F.col("_k")) / size)})
    cut = steps.groupBy(*by, "_k0", "_row", "_column").agg(F.min("_k").alias("_from"), F.max("_k").alias("_to"), *(F.first(c).alias(c) for c in rest))
    return cut.withColumns({f"{c}{i}": _step(c, to, F.col(k)) for c, to in (("_y", "lat"), ("_x", "lon")) for i, k in enumerate(("_from", "_to"))})


def segments(vertices: DataFrame, on: list[str], reach: float, size: float) -> DataFrame:
    """The segments of routes, with the metres along the route up to them, once for each cell that comes within ``reach`` metres."""
    w = Window.partitionBy("route").orderBy("seq")
    v = routes.hops(vertices.select("route", *on, "seq", "lat", "lon"))
    v = v.select("route", *on, "seq", F.lag("lat").over(w).alias("ay"), F.lag("lon").over(w).alias("ax"), F.col("lat").alias("by"), F.col("lon").alias("bx"), (F.col("along") - F.col("hop")).alias("from"), "hop").where("ay is not null")
    for c in ("ay", "ax", "by", "bx"):
        v = v.where(~F.isnan(c))
    pad = 1.01 * reach / METRES_PER_DEGREE
    wide = pad / F.greatest(F.cos(F.radians(F.greatest(F.abs("ay"), F.abs("by")) + pad)), F.lit(0.01))
    cells = lambda a, b, more: F.explode(F.sequence(F.floor((F.least(a, b) - more) / size), F.floor((F.greatest(a, b) + more) / size)))
    v = v.withColumn("_row", cells(F.col("ay"), F.col("by"), F.lit(pad)))
    # Of a row's columns only those count that the segment comes near within the row and its margins.
    rise = F.col("by") - F.col("ay")
    at = lambda y: F.when(rise != 0, F.least(F.greatest((y - F.col("ay")) / rise, F.lit(0.0)), F.lit(1.0)))
    x = lambda t: F.col("ax") + (F.col("bx") - F.col("ax")) * t
    low, high = x(F.coalesce(at(F.col("_row") * size - 1.01 * pad), F.lit(0.0))), x(F.coalesce(at((F.col("_row") + 1) * size + 1.01 * pad), F.lit(1.0)))
    return v.withColumn("_column", cells(low, high, 1.01 * wide))


def _apart(reach: float) -> Column:
    """Whether a piece of a hop lies to one side of a segment, or beyond one end of it, by more than ``reach`` metres: no step of it
    can be near. Metres are those at the piece's first step; what they lose over the piece is allowed for."""
    y, x = [F.col("_y0"), F.col("_y1")], [F.col("_x0"), F.col("_x1")]
    k = METRES_PER_DEGREE * F.cos(F.radians(y[0]))
    far = F.greatest(*(F.abs(a - b) for a in (F.col("ax"), F.col("bx")) for b in x))
    slack = 1.01 * reach + 0.01 + METRES_PER_DEGREE * F.radians(F.abs(y[1] - y[0])) * far
    vx, vy = (F.col("bx") - F.col("ax")) * k, (F.col("by") - F.col("ay")) * METRES_PER_DEGREE
    px, py = [(c - F.col("ax")) * k for c in x], [(c - F.col("ay")) * METRES_PER_DEGREE for c in y]
    length = F.sqrt(vx * vx + vy * vy)
    across = [vx * b - vy * a for a, b in zip(px, py, strict=True)]
    ahead = [vx * a + vy * b for a, b in zip(px, py, strict=True)]
    beyond = (F.least(*ahead) > (length + slack) * length) | (F.greatest(*ahead) < -slack * length)
    return (length > 0) & (beyond | (F.least(*across) > slack * length) | (F.greatest(*across) < -slack * length))


def meetings(hops: DataFrame, vertices: DataFrame, reach: float, by: tuple[str, ...] = (), on: tuple[str, ...] = (), size: float = 0.005) -> DataFrame:
    """(way, by, route, along, length, runs, ahead) for ``hops`` (way, by, on, ...) of a way and each route of its map (``on``) that passes
    within ``reach`` metres of a step: the metres along the route to the first such step's nearest place (the earlier segment on ties),
    whether a stretch of steps runs along the route, and whether one does so in the way's own direction."""
    pairs = pieces(hops, ["way", *on, *by], size).join(segments(vertices, list(on), reach, size), [*on, "_row", "_column"]).where(~F.coalesce(_apart(reach), F.lit(False)))
    keys = ["way", "route", *by]
    pairs = pairs.select(*keys, *_HOP, "_from", "_to", "seq", "ay", "ax", "by", "bx", "from", "hop").repartition("way", "route").sortWithinPartitions(*keys, "_k0", "_from")
    found = [("along", T.DoubleType()), ("length", T.DoubleType()), ("runs", T.BooleanType()), ("ahead", T.BooleanType())]
    schema = T.StructType([pairs.schema[k] for k in keys] + [T.StructField(name, kind) for name, kind in found])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            new = np.flatnonzero(_changes(batch, keys, held[-1] if held else None))
            if not len(new):
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, new[-1])], batch.schema)
            held = [batch.slice(new[-1])]
            yield from _walk(whole, keys, reach)
        if held:
            yield from _walk(pa.Table.from_batches(held), keys, reach)

    return pairs.mapInArrow(run, schema)


def _changes(batch: pa.RecordBatch | pa.Table, keys: list[str], before: pa.RecordBatch | None = None) -> np.ndarray:
    """Where the keys of a row aren't those of the row before; the first row's are told from the last of ``before``."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
        if batch.num_rows and (before is None or before.column(k)[-1].as_py() != batch.column(k)[0].as_py()):
            new[0] = True
    return new


def _running(values: np.ndarray, run: np.ndarray, most: bool) -> np.ndarray:
    """The greatest (or least) value of a run up to each row; ``run`` numbers the runs upward."""
    order = np.argsort(values if most else -values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order[np.maximum.accumulate(rank + run * len(values)) - run * len(values)]]


def _walk(pairs: pa.Table, keys: list[str], reach: float) -> Iterator[pa.RecordBatch]:
    """Steps of the pieces of whole keys, in order: the nearest place of each on the route, and what its stretch spans."""
    if not pairs.num_rows:
        return
    new = _changes(pairs, keys)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    col = {c: pairs.column(c).to_numpy() for c in (*_HOP, "_from", "_to", "seq", "ay", "ax", "by", "bx", "from", "hop")}
    count = col["_to"] - col["_from"] + 1
    i = np.repeat(np.arange(len(count)), count)
    k = col["_from"][i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    at = lambda c: col[c][i]
    part = k / at("_n")
    lat, lon = at("_y") + (at("lat") - at("_y")) * part, at("_x") + (at("lon") - at("_x")) * part
    m = METRES_PER_DEGREE * np.cos(np.radians(lat))
    bx, by, px, py = (at("bx") - at("ax")) * m, (at("by") - at("ay")) * METRES_PER_DEGREE, (lon - at("ax")) * m, (lat - at("ay")) * METRES_PER_DEGREE
    length2 = bx * bx + by * by
    t = np.where(length2 > 0, np.clip((px * bx + py * by) / np.where(length2 > 0, length2, 1.0), 0.0, 1.0), 0.0)
    off = np.sqrt((px - t * bx) ** 2 + (py - t * by) ** 2)
    near = np.flatnonzero(off <= reach)
    place = at("_k0")[near] + np.maximum(k[near], 1)
    near = near[np.lexsort((at("seq")[near], off[near], place, group[i[near]]))]
    place, g = at("_k0")[near] + np.maximum(k[near], 1), group[i[near]]
    if not len(near):
        return
    least = np.concatenate([[True], (g[1:] != g[:-1]) | (place[1:] != place[:-1])])
    near, place, g = near[least], place[least], g[least]
    j = i[near]
    along, walked = col["from"][j] + t[near] * col["hop"][j], col["_before"][j] + col["_hop"][j] * part[near]
    begins = np.concatenate([[True], (g[1:] != g[:-1]) | (place[1:] != place[:-1] + 1)])
    run = np.cumsum(begins) - 1
    span = _running(along, run, True) - _running(along, run, False)
    runs = (span > 0) & (span >= np.minimum(SPAN, col["length"][j] / 2)) & (span >= PARALLEL * (walked - _running(walked, run, False)))
    ahead = runs & (along > along[np.flatnonzero(begins)][run])
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    rows = pairs.select(keys).take(pa.array(first[g[start]])).combine_chunks()
    columns = [pa.array(along[start]), pa.array(col["length"][j[start]]), pa.array(np.logical_or.reduceat(runs, start)), pa.array(np.logical_or.reduceat(ahead, start))]
    yield from pa.Table.from_arrays([*rows.columns, *columns], names=[*keys, "along", "length", "runs", "ahead"]).to_batches()


def runs_along(vertices: DataFrame, ways: DataFrame, directed: Column | None = None, reach: float = LIMIT_REACH, on: tuple[str, ...] = ()) -> DataFrame:
    """(route, way) where a stretch of the way (way, seq, lat, lon) runs along the route (route, seq, lat, lon): within ``reach``
    for 30 metres of the route (or half a shorter way), with it rather than across, and, where ``directed`` (a column of
    ``ways``) holds, in the way's own direction. Routes and ways may lie on maps, told by the columns ``on``; only those of one
    map meet."""
    met = meetings(hops_to_walk(ways, list(on)), vertices, reach, on=on).where("runs")
    if directed is not None:
        met = met.join(ways.groupBy("way").agg(F.max(directed).alias("_directed")), "way").where(~F.col("_directed") | F.col("ahead"))
    return met.select("route", "way")


def limits_on_route(vertices: DataFrame, ways: DataFrame, tags: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(route, way): the restricted ways that a route drives, of those whose ``tags`` (way, tags) make them public roads."""
    count = tags.where(posted_limit_counts(F.col("tags"))).select("way")
    return runs_along(vertices, ways.join(count, "way", "left_semi"), on=on)


def drives_closures(vertices: DataFrame, closures: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(route, way) of the closures (way, seq, lat, lon, directed) that a route drives: it runs along them within 40 metres, the way
    they run where directed; or passes both ends of one given by two places, one after the other, without driving much more
    than the gap. Closures of under 40 metres are points, which a route passes within 40 metres of. Those of one map (``on``)
    meet. Points, ends and stretches are told apart by a kind and meet the segments in one join."""
    w, whole = Window.partitionBy("way").orderBy("seq"), Window.partitionBy("way")
    hop = meters(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    df = closures.withColumns({"_m": hop, "_i": F.row_number().over(w), "_all": F.count("*").over(whole), "_directed": F.max("directed").over(whole)})
    df = df.withColumn("length", F.coalesce(F.sum("_m").over(whole), F.lit(0.0)))
    point, end = (F.col("length") < CLOSED_REACH) & (F.col("_i") == 1), (F.col("_all") == 2) & (F.col("length") >= CLOSED_REACH)
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    places = df.withColumn("_kind", F.when(point, _POINT).when(end & (F.col("_i") == 1), _START).when(end, _END)).where("_kind is not null")
    places = places.withColumns({"_k0": zero, "_j": zero, "_n": F.lit(1).cast("long"), "_y": F.col("lat"), "_x": F.col("lon"), "_before": none, "_hop": none})
    walks = hops_to_walk(df.where(F.col("length") >= CLOSED_REACH), [*on, "_directed"]).withColumn("_kind", F.lit(_WALK))
    columns = ["way", *on, "_kind", "_directed", *_HOP]
    near = meetings(places.select(columns).unionByName(walks.select(columns)), vertices, CLOSED_REACH, ("_kind", "_directed"), on)
    kind, along = F.col("_kind"), F.col("along")
    both = near.groupBy("route", "way").agg(
        F.max((kind == _POINT) | ((kind == _WALK) & F.col("runs") & (~F.col("_directed") | F.col("ahead")))).alias("_hit"), F.max("_directed").alias("_directed"),
        F.max(F.when(kind == _START, along)).alias("a"), F.max(F.when(kind == _END, along)).alias("b"), F.max("length").alias("_length"),
    )
    passed = (~F.col("_directed") | (F.col("b") > F.col("a"))) & (F.abs(F.col("b") - F.col("a")) <= 2 * F.col("_length") + 2 * CLOSED_REACH)
    met = both.where(F.col("_hit") | passed).select("route", "way")
    lone = routes_of_one(vertices, on).join(places.where(kind == _POINT).select("way", *on, F.col("lat").alias("_y"), F.col("lon").alias("_x"), *_cell("lat", "lon")), [*on, "_row", "_column"])
    return met.unionByName(lone.where(meters(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon")) <= CLOSED_REACH).select("route", "way"))


#: Kinds of what a closure is met by.
_POINT, _WALK, _START, _END = range(4)


def _cell(lat: str, lon: str, size: float = 0.01) -> list[Column]:
    """The cells that a place's reach touches, one a row."""
    pad = 2 * CLOSED_REACH / METRES_PER_DEGREE
    wide = pad / F.greatest(F.cos(F.radians(F.abs(lat) + pad)), F.lit(0.01))
    spread = lambda c, more: F.sequence(F.floor((F.col(c) - more) / size), F.floor((F.col(c) + more) / size))
    pairs = F.flatten(F.transform(spread(lat, F.lit(pad)), lambda r: F.transform(spread(lon, wide), lambda c: F.struct(r.alias("_row"), c.alias("_column")))))
    return [F.inline(pairs)]


def routes_of_one(vertices: DataFrame, on: tuple[str, ...] = (), size: float = 0.01) -> DataFrame:
    """Routes of a single vertex, with their cell."""
    lone = vertices.groupBy("route").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in (*on, "lat", "lon"))).where("_n = 1")
    return lone.select("route", *on, "lat", "lon", F.floor(F.col("lat") / size).alias("_row"), F.floor(F.col("lon") / size).alias("_column"))
