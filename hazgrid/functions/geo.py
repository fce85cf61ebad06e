"""Distances, bearings and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
EARTH_KM = 6371.0


def meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres with the cosine of the mean latitude."""
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + dy * dy)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))
    return F.pmod(F.degrees(angle) + 360, F.lit(360.0))


def heading_delta(a: Column, b: Column) -> Column:
    """Signed turn from ``a`` to ``b`` in (-180, 180]."""
    d = F.pmod(b - a, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Plane distance from a point to a segment; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(0.0)
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def ring_contains(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over an array of structs (x, y); fewer than three corners hold nothing."""
    n = F.size(ring)

    def crosses(a: Column, i: Column) -> Column:
        b = F.get(ring, (i + n - 1) % n)
        straddles = (a["y"] > y) != (b["y"] > y)
        return straddles & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    return (n >= 3) & (F.size(F.filter(ring, crosses)) % 2 == 1)


def ring_centroid(ring: Column) -> Column:
    """struct(x, y): the centre of a ring's area (array of struct(x, y)); of one without area the mean of its corners."""
    n = F.size(ring)
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        cross = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct((s["area"] + cross).alias("area"), (s["x"] + (a["x"] + b["x"]) * cross).alias("x"), (s["y"] + (a["y"] + b["y"]) * cross).alias("y"))

    def centre(s: Column) -> Column:
        mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[c]) / n
        flat = F.abs(s["area"]) <= 1e-12
        return F.struct(F.when(flat, mean("x")).otherwise(s["x"] / (3 * s["area"])).alias("x"), F.when(flat, mean("y")).otherwise(s["y"] / (3 * s["area"])).alias("y"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, add, centre))


def circle_ring(lat: Column, lon: Column, metres: Column, corners: int) -> Column:
    """The ring (array of struct(x, y)) of a circle, its first corner to the east."""
    dy = metres / METRES_PER_DEGREE
    dx = metres / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    turn = lambda k: 2 * F.pi() * k / corners
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda k: F.struct((lon + dx * F.cos(turn(k))).alias("x"), (lat + dy * F.sin(turn(k))).alias("y")))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ring_spans(ring: Column, y: Column) -> Column:
    """array of struct(a, b): the stretches inside a ring along the latitude ``y``, from west to east."""
    n = F.size(ring)

    def crossing(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        return F.when((p["y"] <= y) != (q["y"] <= y), p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]))

    xs = F.array_sort(F.array_compact(F.transform(ring, crossing)))
    pairs = lambda x: F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1), lambda k: F.struct(F.get(x, 2 * k).alias("a"), F.get(x, 2 * k + 1).alias("b"))))
    return F.coalesce(_once(xs, pairs), F.array().cast("array<struct<a:double,b:double>>"))


def icon_anchor(ring: Column) -> Column:
    """struct(x, y) at which an area's one icon stands: its centroid where that lies inside, else the middle of the widest
    stretch on the centroid's latitude, the most western on ties."""

    def anchor(c: Column) -> Column:
        nothing = F.struct(F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
        widest = F.aggregate(ring_spans(ring, c["y"]), nothing, lambda best, s: F.when(best["a"].isNull() | (s["b"] - s["a"] > best["b"] - best["a"]), s).otherwise(best))
        beside = _once(widest, lambda s: F.when(s["a"].isNull(), c).otherwise(F.struct(((s["a"] + s["b"]) / 2).alias("x"), c["y"].alias("y"))))
        return F.when((F.size(ring) < 3) | ring_contains(c["x"], c["y"], ring), c).otherwise(beside)

    return _once(ring_centroid(ring), anchor)


#: Points along a side of the grid that samples an area.
SIDE = 4


def interior_samples(ring: Column, limit: int) -> Column:
    """array of struct(x, y): up to ``limit`` points inside a ring, its icon's place first, then those of a grid of 4 by 4 over its
    box that lie inside, evenly thinned. Empty for fewer than three corners."""
    none = F.array().cast("array<struct<x:double,y:double>>")
    if limit < 1:
        return none
    low, high = (lambda c: F.array_min(F.transform(ring, lambda p: p[c]))), (lambda c: F.array_max(F.transform(ring, lambda p: p[c])))
    at = lambda box, c, k: box[f"{c}0"] + (box[f"{c}1"] - box[f"{c}0"]) * (k + 0.5) / SIDE
    box = F.struct(*(f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((low, high))))
    grid = _once(box, lambda b: F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda k: F.struct(at(b, "x", k % SIDE).alias("x"), at(b, "y", F.floor(k / SIDE)).alias("y"))))
    points = F.concat(F.array(icon_anchor(ring)), F.filter(grid, lambda p: ring_contains(p["x"], p["y"], ring)))

    def thinned(all_: Column) -> Column:
        if limit == 1:
            return F.slice(all_, 1, 1)
        picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.get(all_, F.round(k * (F.size(all_) - 1) / (limit - 1)).cast("int")))
        return F.when(F.size(all_) <= limit, all_).otherwise(picks)

    return F.when(F.size(ring) >= 3, _once(points, thinned)).otherwise(none)
