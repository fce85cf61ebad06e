"""Operators on routes: rows (route, seq, lat, lon) in turn, seq from 0. Running lengths are windows by route; what depends on
the last row that was kept is a fold over the route's vertices in order, one state a route."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions.geo import METRES_PER_DEGREE, meters, segment_distance
from hazgrid.operators import spatial
from hazgrid.operators.asof import asof
from hazgrid.operators.nearby import nearest_anywhere
from hazgrid.operators.shared import settled
from hazgrid.operators.streams import fold

# Vertices behind and ahead of the last match, and metres beyond which a fix has left them; metres of a closure;
# percent of a steep grade and the most marks for them.
BEHIND, AHEAD, LOST, CLOSED, STEEP, MARKS = 12, 80, 250.0, 40.0, 6.0, 12


def _turn(route: str = "route", seq: str = "seq"):
    return Window.partitionBy(route).orderBy(seq)


def hops(vertices: DataFrame) -> DataFrame:
    """Adds hop (metres from the vertex before, 0 at the first) and along (their running sum)."""
    w = _turn()
    before = meters(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    df = vertices.withColumn("hop", F.coalesce(before, F.lit(0.0)))
    return df.withColumn("along", F.sum("hop").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def match_fixes(vertices: DataFrame, fixes: DataFrame, size: float = 0.01) -> DataFrame:
    """(fix, seq, metres): the vertex nearest to each of ``fixes`` (fix, route, last, fix_lat, fix_lon) from a few behind its
    last match to some ahead; among all vertices where that is too far. Ties go to the first vertex.

    A fix meets the vertices of its stretch by blocks of places in the route; where these are the whole route, it has met all.
    Other fixes that it has left are looked for by cells of ``size`` degrees, so no fix meets all vertices of a long route."""
    reach = BEHIND + AHEAD
    d = meters(F.col("lat"), F.col("lon"), F.col("fix_lat"), F.col("fix_lon"))
    blocks = F.sequence(F.floor((F.col("last") - BEHIND) / reach), F.floor((F.col("last") + AHEAD - 1) / reach))
    some = fixes.select("fix", "route", "last", "fix_lat", "fix_lon", F.explode(blocks).alias("_block"))
    pairs = some.join(vertices.select("route", "seq", "lat", "lon", F.floor(F.col("seq") / reach).alias("_block")), ["route", "_block"])
    pairs = pairs.where((F.col("seq") >= F.col("last") - BEHIND) & (F.col("seq") < F.col("last") + AHEAD))
    extent = vertices.groupBy("route").agg(F.min("seq").alias("_from"), F.max("seq").alias("_to"))
    whole = (F.col("_from") >= F.col("last") - BEHIND) & (F.col("_to") < F.col("last") + AHEAD)
    inside = fixes.join(extent, "route").where(whole).select("fix").distinct().withColumn("_whole", F.lit(True))
    best = pairs.groupBy("fix").agg(F.min(F.struct(d.alias("d"), "seq")).alias("v")).join(inside, "fix", "left")
    near = settled(best.where((F.col("v.d") <= LOST) | F.col("_whole")).select("fix", F.col("v.seq").alias("seq"), F.col("v.d").alias("metres")))
    lost = settled(fixes.join(near, "fix", "left_anti").select("fix", "route", F.col("fix_lat").alias("lat"), F.col("fix_lon").alias("lon")))
    if lost.isEmpty():
        return near
    refs = vertices.join(lost.select("route").distinct(), "route", "left_semi").select("route", "seq", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    far = nearest_anywhere(lost, refs, "fix", "seq", size, on=("route",))
    return near.unionByName(far.where("seq is not null").select("fix", "seq", F.col("meters").alias("metres")))


def progress(vertices: DataFrame, steps: DataFrame, matched: DataFrame, width: float | None = None) -> DataFrame:
    """For each of ``matched`` (fix, route, seq, step): the step it is in (``steps``: route, step, end_seq, later steps ending
    later; the first not passed from its own on, else the last), metres along, remaining and to the step's end, and the share
    that is left. Vertices, steps and fixes are one stream a route, read along it, back, and back by steps: one shuffle, no joins. Running lengths need a route's vertices in
    one task in any case, so ``width`` changes nothing; it stays for callers that give it."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    fix = dict(matched.dtypes)["fix"]
    rows = vertices.select("route", F.col("seq").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), none("step", "long"), none("fix", fix))
    for part, at, kind, name in ((steps, "end_seq", 1, none("fix", fix)), (matched, "seq", 2, F.col("fix"))):
        rows = rows.unionByName(part.select("route", F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"), none("lat", "double"), none("lon", "double"), F.col("step").cast("long").alias("step"), name))
    stop, at_vertex = F.col("kind") == 1, F.col("kind") == 0
    route = Window.partitionBy("route")
    on = route.orderBy("at", "kind")
    place = F.last(F.when(at_vertex, F.struct("lat", "lon")), ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, -1))
    so_far = on.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("route is not null").withColumns({"_p": place, "_seen": F.last(F.when(at_vertex, F.col("at")), ignorenulls=True).over(so_far)})
    hop = F.when(at_vertex, meters(F.col("_p.lat"), F.col("_p.lon"), F.col("lat"), F.col("lon")))
    rows = rows.withColumn("along", F.sum(F.coalesce(hop, F.lit(0.0))).over(so_far)).where(F.col("_seen") == F.col("at"))  # no place, no step
    ends = F.when(stop, F.struct("step", F.col("along").alias("end_along")))
    back = route.orderBy(F.desc("at"), F.desc("kind"), F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_open": F.last(ends, ignorenulls=True).over(back), "total": F.first("along").over(back)}).where(~at_vertex)
    first = F.when(stop, F.col("step")).when(F.col("_open").isNotNull(), F.greatest("_open.step", "step"))
    by_step = route.orderBy(F.desc("_from"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_from", first).withColumns({"_next": F.last(ends, ignorenulls=True).over(by_step), "_last": F.max(ends).over(route)})
    s = F.coalesce(F.when(F.col("_from").isNotNull(), F.col("_next")), F.col("_last"))
    best = rows.where(~stop & F.col("_last").isNotNull()).withColumn("s", s)
    left = F.greatest(F.col("total") - F.col("along"), F.lit(0.0))
    return best.select(
        "fix", F.col("s.step").cast(dict(steps.dtypes)["step"]).alias("step"), "along", left.alias("remaining"), F.greatest(F.col("s.end_along") - F.col("along"), F.lit(0.0)).alias("to_end"),
        F.when(F.col("total") > 0, left / F.col("total")).otherwise(0.0).alias("left"),
    )


def _vertex_from(vertices: DataFrame, marks: DataFrame, width: float | None) -> DataFrame:
    """``marks`` (route, along, seq: the first place that counts) with found, the first vertex from there on, else the last,
    and _last, the route's last vertex."""
    points = hops(vertices).select("route", "along", "seq", F.col("seq").alias("found"))
    ends = points.groupBy("route").agg(F.max("seq").alias("_last"))
    ahead = asof(marks, points, "route", ["along", "seq"], ["found"], strict=False, width=width, forward=True)
    return ahead.join(ends, "route").withColumn("found", F.coalesce("found", "_last"))


def vertex_ahead(vertices: DataFrame, marks: DataFrame, width: float | None = 100_000.0) -> DataFrame:
    """(mark, seq): the first vertex at least ``metres`` (0 or more) beyond that of each of ``marks`` (mark, route, from_seq,
    metres); the last one if none is. Both come in one stream along the route."""
    along = hops(vertices).select("route", F.col("seq").alias("from_seq"), F.col("along").alias("start"))
    target = marks.join(along, ["route", "from_seq"]).select("mark", "route", (F.col("start") + F.col("metres")).alias("along"), F.col("from_seq").cast(vertices.schema["seq"].dataType).alias("seq"))
    return _vertex_from(vertices, target, width).select("mark", F.col("found").alias("seq"))


def check_points(vertices: DataFrame, every: float) -> DataFrame:
    """(route, seq) of the vertices that cut a route: where the metres since the last cut reach ``every``."""
    return cut_every(hops(vertices), every)


def cut_every(df: DataFrame, every: float) -> DataFrame:
    """(route, seq) of the rows (route, seq, hop) where the sum of hops since the last cut reaches ``every``; a route's rows pass
    in order, with that sum as the state."""

    def add(since: float | None, row: tuple) -> tuple[float, list]:
        since = (since or 0.0) + row[2]
        return (0.0, [row[:2]]) if since >= every else (since, [])

    kind = dict(df.dtypes)["route"]
    return fold(df.select("route", F.col("seq").cast("long").alias("seq"), F.col("hop").cast("double").alias("hop")), ["route"], ["seq"], ["hop"], f"route {kind}, seq long", add)


def decimated(vertices: DataFrame, step: float, limit: int) -> DataFrame:
    """(route, place, seq) of the vertices that are kept: the first, each one ``step`` metres from the last kept, the last; of
    more than ``limit`` evenly as many. A limit under 1 keeps none. A route's vertices pass in order, with the last kept one
    as the state; what is thinned evenly follows from places and counts."""
    kind = dict(vertices.dtypes)["route"]
    if limit < 1:
        return vertices.select("route", F.lit(0).alias("place"), F.col("seq").cast("long").alias("seq")).limit(0)

    def far(a: tuple, b: tuple) -> float:
        dy, dx = (b[2] - a[2]) * METRES_PER_DEGREE, (b[3] - a[3]) * METRES_PER_DEGREE * math.cos(math.radians((a[2] + b[2]) / 2))
        return math.sqrt(dx * dx + dy * dy)

    def keep(last: tuple | None, row: tuple) -> tuple[tuple, list]:
        return (row, [row[:2]]) if last is None or far(last, row) >= step else (last, [])

    rows = vertices.select("route", F.col("seq").cast("long").alias("seq"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    kept = fold(rows, ["route"], ["seq"], ["lat", "lon"], f"route {kind}, seq long", keep, lambda last, end: [end[:2]] if far(last, end) > 1 else [])
    whole = Window.partitionBy("route")
    kept = kept.withColumns({"_i": F.row_number().over(whole.orderBy("seq")) - 1, "_n": F.count("*").over(whole)})
    few = kept.where(F.col("_n") <= limit).select("route", F.col("_i").alias("place"), "seq")
    stride = (F.col("_n") - 1) / (limit - 1) if limit > 1 else F.lit(1.0)
    # The places whose pick, k * stride rounded, is this row: of the two or three near it.
    near = F.sequence(F.greatest(F.floor((F.col("_i") - 0.6) / stride), F.lit(0)), F.least(F.ceil((F.col("_i") + 0.6) / stride), F.lit(limit - 1)))
    picked = F.filter(near, lambda k: F.round(k * stride).cast("int") == F.col("_i"))
    places = F.when(F.size(near) > 0, F.transform(picked, lambda k: k.cast("int")))
    return few.unionByName(kept.where((F.col("_n") > limit) & (F.floor((F.col("_i") - 0.6) / stride) <= limit - 1)).select("route", F.explode(places).alias("place"), "seq"))


def halves(vertices: DataFrame) -> DataFrame:
    """(route, seq, lat, lon): the point half way along each route of two or more vertices, and the vertex that it comes before."""
    df = hops(vertices)
    total = F.max("along").over(Window.partitionBy("route"))
    w = _turn()
    df = df.withColumns({"half": total / 2, "_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w)})
    reach = df.where((F.col("seq") > 0) & (F.col("along") >= F.col("half")))
    t = F.when(F.col("hop") > 0, (F.col("half") - (F.col("along") - F.col("hop"))) / F.col("hop")).otherwise(0.0)
    at = F.struct("seq", (F.col("_lat") + (F.col("lat") - F.col("_lat")) * t).alias("lat"), (F.col("_lon") + (F.col("lon") - F.col("_lon")) * t).alias("lon"))
    return reach.groupBy("route").agg(F.min(at).alias("m")).select("route", "m.*")


def steep_marks(vertices: DataFrame, profile: DataFrame, width: float | None = 100_000.0) -> DataFrame:
    """(route, start_mile, seq, grade): the first steep pieces of ``profile`` (route, start_mile, end_mile, grade), each at the
    first vertex from its middle on, never the first of the route."""
    w = Window.partitionBy("route").orderBy("start_mile", "end_mile", "grade")
    steep = profile.where(~F.isnan("grade") & (F.abs("grade") >= STEEP)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MARKS)
    middle = (F.col("start_mile") + F.col("end_mile")) / 2 * 1609.344
    targets = steep.select("route", "start_mile", "grade", middle.alias("along"), F.lit(-1).cast(vertices.schema["seq"].dataType).alias("seq"))
    found = _vertex_from(vertices, targets, width)
    return found.where("_last > 0").select("route", "start_mile", F.greatest("found", F.lit(1)).alias("seq"), "grade")


def next_steep(profile: DataFrame, marks: DataFrame, percent: float, lookahead: float, width: float | None = 1000.0) -> DataFrame:
    """(mark, start_mile, grade): the first piece of the profile, whose pieces don't overlap, ahead of ``marks`` (mark, route, mile)
    that is steep enough, the steeper on ties. Any unit of length serves if all share it."""
    steep = profile.where(F.abs("grade") >= percent).select("route", F.col("end_mile").alias("mile"), F.struct("start_mile", (-F.abs("grade")).alias("g"), "grade").alias("b"))
    first = steep.groupBy("route", "mile").agg(F.min("b").alias("b"))
    ahead = asof(marks, first, "route", "mile", ["b"], width=width, forward=True)
    return ahead.where(F.col("b.start_mile") < F.col("mile") + lookahead).select("mark", F.col("b.start_mile").alias("start_mile"), F.col("b.grade").alias("grade"))


def grades_at(profile: DataFrame, marks: DataFrame, width: float | None = 1000.0) -> DataFrame:
    """(mark, grade) of the first piece that holds each mark's mile, ends included, 0 outside all pieces, which don't overlap. Pieces
    of one end come in order of their start and grade, a mark before them all; so none have to be grouped first."""
    kinds = dict(profile.dtypes)
    ends = profile.select("route", F.col("end_mile").alias("mile"), F.col("start_mile").alias("_start"), F.col("grade").alias("_grade"), F.struct("start_mile", "grade").alias("b"))
    at = marks.select("mark", "route", F.col("mile").cast(kinds["end_mile"]).alias("mile"), F.lit(None).cast(kinds["start_mile"]).alias("_start"), F.lit(None).cast(kinds["grade"]).alias("_grade"))
    ahead = asof(at, ends, "route", ["mile", "_start", "_grade"], ["b"], strict=False, width=width, forward=True)
    return ahead.select("mark", F.when(F.col("b.start_mile") <= F.col("mile"), F.col("b.grade")).otherwise(0.0).alias("grade"))


def arrivals(samples: DataFrame, seconds: Column) -> DataFrame:
    """``samples`` (route, seq) with the offset of their arrival, ``seconds`` spread evenly over them."""
    n = F.count("*").over(Window.partitionBy("route"))
    return samples.withColumn("offset", F.when(n > 1, F.greatest(seconds, F.lit(0.0)) * F.col("seq") / (n - 1)).otherwise(0.0))


def look_ahead(samples: DataFrame, spacing: float, along: Column, reach: Column, pace: Column) -> DataFrame:
    """The samples (seq from 0) from the one at ``along`` to one past its reach, with seconds until each."""
    last = F.max("seq").over(Window.partitionBy("route"))
    low = F.floor(F.least(F.greatest(along / spacing, F.lit(0.0)), last))
    high = F.floor(F.least(F.greatest((along + reach) / spacing + 1, F.lit(0.0)), last))
    df = samples.withColumns({"_low": low, "_high": high}).where(F.col("seq").between(F.col("_low"), F.col("_high")))
    return df.withColumn("offset", F.greatest((F.col("seq") * spacing - along) * pace, F.lit(0.0))).drop("_low", "_high")


def through_closures(vertices: DataFrame, closures: DataFrame, size: float = 0.02) -> DataFrame:
    """Routes that pass within 40 metres of a closed point (closure_lat, closure_lon). A route with a vertex that near is settled
    by its places; of the others, segments meet the closures of the cells that they cross, each segment and place once."""
    closures = closures.select(F.col("closure_lat").cast("double").alias("closure_lat"), F.col("closure_lon").cast("double").alias("closure_lon")).distinct()
    k = F.cos(F.radians("closure_lat")) * METRES_PER_DEGREE
    x, y = lambda c: (F.col(c) - F.col("closure_lon")) * k, lambda c: (F.col(c) - F.col("closure_lat")) * METRES_PER_DEGREE
    # The cosine that counts is the closure's; what lies on the border is left to the segments.
    tight = spatial.within(spatial.places(vertices), closures.withColumns({"ref_lat": F.col("closure_lat"), "ref_lon": F.col("closure_lon")}), 1.01 * CLOSED, 0.001)
    at = tight.where(F.hypot(x("lon"), y("lat")) <= CLOSED * (1 - 1e-9)).select("lat", "lon").distinct()
    settled_by_place = settled(vertices.join(at, ["lat", "lon"], "left_semi").select("route").distinct())
    vertices = vertices.join(settled_by_place, "route", "left_anti")
    w = _turn()
    segments = vertices.withColumns({"b_lat": F.lead("lat").over(w), "b_lon": F.lead("lon").over(w), "_n": F.count("*").over(Window.partitionBy("route"))})
    segments = segments.where(F.col("b_lat").isNotNull() | (F.col("_n") == 1)).withColumns({"b_lat": F.coalesce("b_lat", "lat"), "b_lon": F.coalesce("b_lon", "lon")})
    pad = 2 * CLOSED / METRES_PER_DEGREE
    wide = pad / F.greatest(F.cos(F.radians(F.greatest(F.abs("lat"), F.abs("b_lat")))), F.lit(0.05))
    cells = lambda a, b, more: F.sequence(F.floor((F.least(a, b) - more) / size), F.floor((F.greatest(a, b) + more) / size))
    ends = ["lat", "lon", "b_lat", "b_lon"]
    each = segments.select(*ends).distinct()
    each = each.withColumn("_row", F.explode(cells("lat", "b_lat", F.lit(pad)))).withColumn("_column", F.explode(cells("lon", "b_lon", wide)))
    points = closures.withColumns({"_row": F.floor(F.col("closure_lat") / size), "_column": F.floor(F.col("closure_lon") / size)})
    pairs = each.join(points, ["_row", "_column"])
    hit = pairs.where(segment_distance(F.lit(0.0), F.lit(0.0), x("lon"), y("lat"), x("b_lon"), y("b_lat")) <= CLOSED).select(*ends).distinct()
    return settled_by_place.unionByName(segments.join(hit, ends, "left_semi").select("route").distinct())


def metres_to_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Metres from a point to the nearest edge of a ring (array of struct(x, y)); sizes under three corners are no ring."""
    k = F.cos(F.radians(lat)) * METRES_PER_DEGREE
    x, y = lambda p: (p["x"] - lon) * k, lambda p: (p["y"] - lat) * METRES_PER_DEGREE
    n = F.size(ring)

    def edge(a: Column, i: Column) -> Column:
        b = F.get(ring, (i + n - 1) % n)
        return segment_distance(F.lit(0.0), F.lit(0.0), x(a), y(a), x(b), y(b))

    return F.when(n >= 3, F.array_min(F.transform(ring, edge)))


def edge_keys(vertices: DataFrame) -> DataFrame:
    """(route, seq, key) of each pair of neighbours: their cells of a hundredth of a degree, the lesser first."""
    w = _turn()
    cell = lambda c: F.round(F.col(c) * 100).cast("long")
    here = F.struct(cell("lat").alias("y"), cell("lon").alias("x"))
    df = vertices.select("route", "seq", here.alias("a")).withColumn("b", F.lead("a").over(w)).where(F.col("b").isNotNull())
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return df.select("route", "seq", F.concat_ws(",", low["y"], low["x"], high["y"], high["x"]).alias("key"))


def even_picks(count: Column, most: int) -> Column:
    """array<long> of at most ``most`` places among ``count``, from the first to the last."""
    n = count.cast("long")
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda k: F.floor((k * (n - 1) + (most - 1) // 2) / max(most - 1, 1)))
    few = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(most)) - 1)).otherwise(F.array().cast("array<long>"))
    return few if most < 2 else F.when(n <= most, few).otherwise(spread)
