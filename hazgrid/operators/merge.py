"""Merging what is new into what is known: incidents, stations, corridors, recent places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions.clock import decay
from hazgrid.operators import spatial


def drop_near_duplicates(known: DataFrame, new: DataFrame, reach_m: float, size: float) -> DataFrame:
    """``known`` (id, kind, lat, lon, ...) without rows that a new one of the same kind stands near, and all of ``new``."""
    refs = new.select("kind", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    doubled = spatial.beside(known, refs, "id", reach_m, size, on=("kind",))
    return known.join(doubled, "id", "left_anti").unionByName(new)


def unshown(candidates: DataFrame, shown: DataFrame, reach_m: float, size: float) -> DataFrame:
    """Candidates (id, kind, lat, lon, ...) with none of the same kind shown near them."""
    refs = shown.select("kind", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    near = spatial.beside(candidates, refs, "id", reach_m, size, on=("kind",))
    return candidates.join(near, "id", "left_anti")


def newest(df: DataFrame, keys: list[str], time: str, keep: int, age_days: Column, most_days: float) -> DataFrame:
    """The newest ``keep`` rows a key that aren't older than ``most_days``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    return df.where(age_days <= most_days).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def recents(uses: DataFrame, key: str, name: str, age_days: Column, keep: int) -> DataFrame:
    """Places by use, each use halved every 21 days; the best ``keep`` a key."""
    scored = uses.groupBy(key, name).agg(F.round(F.sum(decay(age_days, 21.0)), 6).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), name)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
