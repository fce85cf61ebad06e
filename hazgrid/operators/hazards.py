"""Live feeds scored at points: the greatest score over the features of a feed within its reach.

Each feed is joined by grid cells sized to its reach, so a point meets only features near it; scores are maxima with
partial aggregation, and a dense feed or a busy place never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions import levels
from hazgrid.functions.geo import segment_distance
from hazgrid.operators import spatial

# Reaches of the feeds in metres, and hours that a quake counts.
FIRE, QUAKE, PERIMETER, GAUGE, WATER, VOLCANO, TSUNAMI, CLOSURE, CLOSURE_FULL = 30_000.0, 150_000.0, 12_000.0, 20_000.0, 6_000.0, 80_000.0, 500_000.0, 2_000.0, 300.0
QUAKE_HOURS = 24.0

#: Degrees of a piece of a perimeter's edge.
PIECE = 0.25


def _best(points: DataFrame, feed: DataFrame, key: str, reach: float, size: float, base: Column, falls: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """The greatest base * falls, of which ``falls`` (of meters and the columns ``by``) is never negative. A base that is no number,
    as of a reading that is none, counts as none."""
    best = spatial.best_score(points, feed, key, F.when(~F.isnan(base), base), reach, size, F.col("base") * falls, by)
    return best.select(key, F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))).alias("score"))


def fire(points: DataFrame, hotspots: DataFrame, key: str) -> DataFrame:
    """hotspots: ref_lat, ref_lon, frp."""
    power = F.when(~F.isnan("frp"), F.least(F.lit(1.0), 0.3 + 0.7 * F.least(F.greatest("frp", F.lit(1.0)) / 100, F.lit(1.0))))
    return _best(points, hotspots, key, FIRE, 0.5, power, 1 - F.col("meters") / FIRE)


def seismic(points: DataFrame, quakes: DataFrame, key: str) -> DataFrame:
    """quakes: ref_lat, ref_lon, magnitude, age_hours."""
    strength = F.when(~F.isnan("magnitude"), F.least(F.greatest(F.col("magnitude") - 3, F.lit(0.0)) / 4, F.lit(1.0)))
    fresh = 0.5 + 0.5 * (1 - F.col("age_hours") / QUAKE_HOURS)
    return _best(points, quakes.where(~F.isnan("age_hours") & (F.col("age_hours") < QUAKE_HOURS)), key, QUAKE, 1.5, strength * fresh, 1 - F.col("meters") / QUAKE)


def volcanic(points: DataFrame, volcanoes: DataFrame, key: str) -> DataFrame:
    """volcanoes: ref_lat, ref_lon, level."""
    base = levels.volcano(F.col("level"))
    return _best(points, volcanoes.where(base > 0), key, VOLCANO, 1.0, base, 1 - 0.5 * F.col("meters") / VOLCANO)


def tropical(points: DataFrame, storms: DataFrame, key: str) -> DataFrame:
    """storms: ref_lat, ref_lon, knots. The reach grows with the wind from 150 to 400 km, so storms of one place and wind are one."""
    reach = 150_000 + 250_000 * F.least(F.greatest((F.col("knots") - 34) / 103, F.lit(0.0)), F.lit(1.0))
    falls = F.when(F.col("meters") < reach, 1 - 0.6 * F.col("meters") / reach)
    return _best(points, storms.where(~F.isnan("knots")), key, 400_000.0, 4.0, levels.tropical(F.col("knots")), falls, ("knots",))


def tsunami(points: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """events: ref_lat, ref_lon, level."""
    base = levels.tsunami(F.col("level"))
    return _best(points, events.where(base > 0), key, TSUNAMI, 5.0, base, 1 - 0.5 * F.col("meters") / TSUNAMI)


def gauges(points: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """feed: ref_lat, ref_lon, category."""
    return _best(points, feed, key, GAUGE, 0.5, levels.flood_category(F.col("category")), 1 - F.col("meters") / GAUGE)


def water(points: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    return _best(points, feed, key, WATER, 0.2, F.lit(1.0), 1 - F.col("meters") / WATER)


def closures(points: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """1 up to 300 metres, falling to 0 at two kilometres."""
    falls = F.when(F.col("meters") <= CLOSURE_FULL, 1.0).otherwise(1 - (F.col("meters") - CLOSURE_FULL) / (CLOSURE - CLOSURE_FULL))
    return _best(points, feed, key, CLOSURE, 0.05, F.lit(1.0), falls)


def perimeters(points: DataFrame, rings: DataFrame, key: str, size: float = 0.5) -> DataFrame:
    """Fire perimeters (ring_id, ring): 1 inside, up to 0.7 within 12 km of an edge. Edges are cut into pieces of a quarter
    degree at most, so that one long edge doesn't widen the search for all."""
    inside = spatial.containing(points, rings, size).select(key).distinct().withColumn("_in", F.lit(1.0))
    n = F.size("ring")
    edges = rings.select("ring_id", F.posexplode("ring").alias("i", "a"), "ring").withColumn("b", F.get("ring", (F.col("i") + 1) % n)).drop("ring")
    pieces = F.greatest(F.ceil(F.hypot(F.col("a.y") - F.col("b.y"), F.col("a.x") - F.col("b.x")) / PIECE), F.lit(1)).cast("int")
    edges = edges.withColumn("_n", pieces).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda k: F.struct(*((F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * (k / F.col("_n"))).alias(c) for c in ("x", "y")))
    edges = edges.select("ring_id", at(F.col("_k")).alias("a"), at(F.col("_k") + 1).alias("b"))
    edges = edges.withColumns({"ref_lat": (F.col("a.y") + F.col("b.y")) / 2, "ref_lon": (F.col("a.x") + F.col("b.x")) / 2})
    reach = PERIMETER + PIECE / 2 * 111_320.0
    near = spatial.within(points, edges, reach, max(size, reach / 111_320.0))
    k = F.cos(F.radians("lat"))
    d = segment_distance(F.lit(0.0), F.lit(0.0), (F.col("a.x") - F.col("lon")) * k, F.col("a.y") - F.col("lat"), (F.col("b.x") - F.col("lon")) * k, F.col("b.y") - F.col("lat")) * 111_320.0
    edge = near.groupBy(key).agg(F.max(F.when(d < PERIMETER, 0.7 * (1 - d / PERIMETER))).alias("_e"))
    return points.select(key).join(inside, key, "left").join(edge, key, "left").select(key, F.coalesce("_in", "_e", F.lit(0.0)).alias("score"))


def rated_zones(points: DataFrame, zones: DataFrame, key: str, score: Column, size: float = 1.0) -> DataFrame:
    """The greatest rating of the zones (ring, rating) that hold a point."""
    best = spatial.containing(points, zones, size).groupBy(key).agg(F.max(score).alias("_s"))
    return points.select(key).join(best, key, "left").select(key, F.coalesce("_s", F.lit(0.0)).alias("score"))


def worst_alert(points: DataFrame, alerts: DataFrame, key: str, arrival: str, size: float = 1.0) -> DataFrame:
    """The worst alert (alert_id, event, severity, expires, ring) over a point at its arrival; ties to the least alert_id."""
    active = spatial.containing(points, alerts, size).where(F.col("expires").isNull() | (F.col("expires") > F.col(arrival)))
    best = active.groupBy(key).agg(F.min(F.struct((-levels.severity(F.col("severity"))).alias("rank"), "alert_id", "event")).alias("w"))
    return best.select(key, F.col("w.alert_id").alias("alert_id"), F.col("w.event").alias("event"), (-F.col("w.rank")).alias("severity_score"))
