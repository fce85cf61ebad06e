"""Merging a new snapshot of warned areas into those that are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.operators import covers, spatial

#: Fixed value: metres within which the first corners of two shapes of an event make them one warning.
SAME = 50.0


def merged(shown: DataFrame, live: DataFrame, looked: DataFrame, now: Column, size: float = 0.05) -> DataFrame:
    """(id, event, ring, expires, source) after a pass: ``shown`` and ``live`` are shapes (id, event, ring, expires), ``looked``
    (lat, lon) the places that a complete pass has checked.

    A shape that has expired goes, from either side; no end means none yet. A shown shape whose warning is among the live
    ones stays as it is (source shown), unless the end has moved: then the live one takes its place (source renewed), the
    first by id of several. One that isn't live any more goes if a place inside it was checked, and stays otherwise. Live
    warnings that weren't shown join (source new). A warning is known by its event and its first corner.
    """
    alive = lambda df: df.where(F.col("expires").isNull() | (F.col("expires") > now)).select("id", "event", "ring", "expires")
    corner = lambda c: F.get("ring", F.lit(0))[c]
    old = alive(shown).withColumns({"lat": corner("y"), "lon": corner("x")})
    new = alive(live)
    # A live shape tells of a shown one's warning even if it has expired meanwhile.
    every = live.select(F.col("id").alias("n_id"), F.col("event"), F.col("ring").alias("n_ring"), F.col("expires").alias("n_expires"), corner("y").alias("ref_lat"), corner("x").alias("ref_lon"))
    # Shapes whose first corners share a place have the same mates: places meet places, each with the first live shape there.
    alive_now = F.col("n_expires").isNull() | (F.col("n_expires") > now)
    first = every.groupBy("event", "ref_lat", "ref_lon").agg(F.min(F.when(alive_now, F.struct("n_id", "n_ring", "n_expires"))).alias("n"))
    pairs = spatial.within(spatial.places(old, ("event",)), first, SAME, size, on=("event",))
    at = pairs.groupBy("event", "lat", "lon").agg(F.min("n").alias("n"))
    mates = old.select("id", "event", "lat", "lon").join(at, ["event", "lat", "lon"]).groupBy("id").agg(F.min("n").alias("n")).withColumn("_live", F.lit(True))
    known = every.join(pairs.select("event", "ref_lat", "ref_lon").distinct(), ["event", "ref_lat", "ref_lon"], "left_semi").select(F.col("n_id").alias("id")).distinct()
    # Equal rings hold the same places.
    rings = old.groupBy("ring").agg(F.min("id").alias("_ring_id"))
    held = covers.containing(spatial.places(looked), rings, ["_ring_id"], size).select("_ring_id").distinct()
    checked = old.select("id", "ring").join(rings.join(held, "_ring_id", "left_semi"), "ring").select("id").distinct().withColumn("_checked", F.lit(True))
    kept = old.join(mates, "id", "left").join(checked, "id", "left")
    kept = kept.where(F.col("_live") | F.col("_checked").isNull())
    moved = F.col("n").isNotNull() & ~F.col("n.n_expires").eqNullSafe(F.col("expires"))
    kept = kept.select(
        F.when(moved, F.col("n.n_id")).otherwise(F.col("id")).alias("id"), "event", F.when(moved, F.col("n.n_ring")).otherwise(F.col("ring")).alias("ring"),
        F.when(moved, F.col("n.n_expires")).otherwise(F.col("expires")).alias("expires"), F.when(moved, "renewed").otherwise("shown").alias("source"),
    )
    fresh = new.join(known, "id", "left_anti")
    return kept.unionByName(fresh.withColumn("source", F.lit("new")))
