"""Timetables from feed tables: patterns, frequencies, footpaths, fares. Each is joins and aggregates over trips and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.geo import haversine_km
from hazgrid.operators import spatial

SAME_FEED, OTHER_FEED, WALK_SPEED = 400.0, 800.0, 1.25


def patterns(stop_events: DataFrame) -> DataFrame:
    """(trip_id, pattern, n_stops): trips that call at the same stops in the same order share a pattern. A trip's stops are few."""
    trips = stop_events.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("s"))
    calls = F.transform("s", lambda x: x["stop_id"].cast("string"))
    return trips.select("trip_id", F.sha2(F.array_join(calls, "\x1f"), 256).alias("pattern"), F.size("s").alias("n_stops"))


def expand_frequencies(stop_events: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Trips that run by headway as one trip a start in [start, end); others as they are."""
    first = stop_events.groupBy("trip_id").agg(F.min("depart").alias("_first"))
    starts = F.when((F.col("headway") > 0) & (F.col("start") < F.col("end")), F.sequence(F.col("start"), F.col("end") - 1, F.col("headway")))
    runs = frequencies.select("trip_id", F.explode(starts).alias("_start")).join(first, "trip_id").withColumn("_shift", F.col("_start") - F.col("_first"))
    moved = stop_events.join(runs, "trip_id").select(
        F.concat_ws("@", F.col("trip_id").cast("string"), F.col("_start").cast("string")).alias("trip_id"), "stop_sequence", "stop_id",
        (F.col("arrive") + F.col("_shift")).alias("arrive"), (F.col("depart") + F.col("_shift")).alias("depart"),
    )
    fixed = stop_events.join(frequencies.select("trip_id").distinct(), "trip_id", "left_anti").select(F.col("trip_id").cast("string").alias("trip_id"), "stop_sequence", "stop_id", "arrive", "depart")
    return fixed.unionByName(moved)


def footpaths(stops: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Pairs of stops (stop_id, feed_no, lat, lon) near enough to walk, closer within a feed than across; pairs that a feed
    publishes itself are left to it."""
    other = stops.select(F.col("stop_id").alias("to_stop"), F.col("feed_no").alias("to_feed"), F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    near = spatial.within(stops, other, OTHER_FEED * 1.1, 0.02).where(F.col("stop_id") != F.col("to_stop"))
    metres = 1000 * haversine_km(F.col("lat"), F.col("lon"), F.col("ref_lat"), F.col("ref_lon"))
    near = near.withColumn("walk_m", metres).where(F.col("walk_m") <= F.when(F.col("feed_no") == F.col("to_feed"), SAME_FEED).otherwise(OTHER_FEED))
    pairs = near.select(F.col("stop_id").alias("from_stop"), "to_stop", F.ceil(F.col("walk_m") / WALK_SPEED).cast("int").alias("seconds"))
    return pairs if published is None else pairs.join(published, ["from_stop", "to_stop"], "left_anti")


def route_fares(routes: DataFrame, rules: DataFrame, fares: DataFrame) -> DataFrame:
    """The fare of each route (route_id, agency_id): its own rules', else its agency's; the least price of those named adult if
    any, else of those not named reduced; null where currencies mix. is_from says that there were several."""
    own = routes.join(rules, "route_id").join(fares.drop("agency_id"), "fare_id").withColumn("_own", F.lit(0))
    wide = routes.join(fares.join(rules.select("fare_id").distinct(), "fare_id", "left_anti"), "agency_id").withColumn("_own", F.lit(1))
    every = own.select("route_id", "fare_id", "price", "currency", "_own").unionByName(wide.select("route_id", "fare_id", "price", "currency", "_own"))
    kind = F.when(F.lower("fare_id").contains("adult"), 0).when(F.lower("fare_id").rlike("reduced|senior|child|student|youth|disab"), 2).otherwise(1)
    every = every.withColumn("_kind", kind)
    best = every.groupBy("route_id").agg(F.min(F.struct("_own", "_kind")).alias("_best"))
    ranked = every.join(best, "route_id").where((F.col("_own") == F.col("_best._own")) & (F.col("_kind") == F.col("_best._kind")) & (F.col("_kind") < 2))
    g = ranked.groupBy("route_id").agg(F.min("price").alias("price"), F.min("currency").alias("currency"), F.countDistinct("currency").alias("_c"), F.countDistinct("price").alias("_p"))
    return g.select("route_id", F.when(F.col("_c") == 1, F.col("price")).alias("price"), F.when(F.col("_c") == 1, F.col("currency")).alias("currency"), (F.col("_p") > 1).alias("is_from"))
