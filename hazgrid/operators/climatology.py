"""Event counts to seasonal hazard scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.clock import WEEKS
from hazgrid.functions.scoring import log_score

TOP = 0.6


def p95(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank 95th percentile of the values above 0, by ``keys``."""
    return df.where(F.col(value) > 0).groupBy(*keys).agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def history_scores(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` with p95 of its ``keys`` and its score on the logarithmic scale against it."""
    return counts.join(p95(counts, keys, value), keys, "left").withColumn("score", log_score(F.col(value), F.col("p95"), TOP))


def harmonics(curve: DataFrame, keys: list[str], week: str, value: str) -> DataFrame:
    """Mean and two harmonics of a curve of 52 weeks, missing weeks as 0: two passes over its rows become five sums."""

    def wave(k: int, f) -> Column:
        return F.sum(F.col(value) * f(F.lit(2 * math.pi * k / WEEKS) * F.col(week))) * (2 / WEEKS)

    return curve.groupBy(*keys).agg(
        (F.sum(value) / WEEKS).alias("mean"), wave(1, F.cos).alias("a1"), wave(1, F.sin).alias("b1"), wave(2, F.cos).alias("a2"), wave(2, F.sin).alias("b2")
    )


def harmonic_value(week: Column) -> Column:
    t = F.lit(2 * math.pi / WEEKS) * week
    v = F.col("mean") + F.col("a1") * F.cos(t) + F.col("b1") * F.sin(t) + F.col("a2") * F.cos(2 * t) + F.col("b2") * F.sin(2 * t)
    return F.least(F.lit(TOP), F.greatest(F.lit(0.0), v))


def upsert(existing: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """(key, score): history, rounded to three decimals, wins where it is above 0 and not below what exists."""
    both = existing.join(history.withColumnRenamed("score", "_h"), key, "full")
    h = F.round("_h", 3)
    return both.select(key, F.when((h > 0) & (h >= F.coalesce("score", F.lit(0.0))), h).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def spread_weight(events: DataFrame, bridge: DataFrame, key: str, weight: str) -> DataFrame:
    """Events of a group shared out evenly over its members: weight / n for each of them."""
    sizes = bridge.groupBy(key).agg(F.count("*").alias("_n"))
    return events.join(bridge, key).join(sizes, key).withColumn("share", F.col(weight) / F.col("_n")).drop("_n")


def build_history(storms: DataFrame, zips: DataFrame, relations: DataFrame, reach_m: float = 200_000.0) -> DataFrame:
    """(zip, week, family, n) from recorded events: the weighted count of what struck a ZIP in a week of the year.

    storms: as ``readers.storm_events`` gives them, with an id. zips: zip, lat, lon. relations: zip, county (five digits).
    An event with a position inside the continent's box counts for the nearest ZIP, or for none; one without a position is
    shared out evenly over the ZIPs of its county.
    """
    from hazgrid.functions.events import event_families, event_weight
    from hazgrid.operators import spatial

    year, month, day = F.floor(F.col("BEGIN_YEARMONTH") / 100).cast("int"), F.col("BEGIN_YEARMONTH") % 100, F.col("BEGIN_DAY")
    # Days count on from the first of their month, however many it really has.
    of_year = F.dayofyear(F.make_date(year, month, F.lit(1))) + day - 1
    week = F.when(month.between(1, 12) & day.between(1, 31), F.least(F.floor((of_year - 1) / 7), F.lit(51)).cast("int"))
    e = storms.select(
        "id", week.alias("week"), event_families(F.col("EVENT_TYPE")).alias("families"), event_weight(F.col("EVENT_TYPE"), F.col("MAGNITUDE")).alias("weight"),
        F.col("BEGIN_LAT").alias("lat"), F.col("BEGIN_LON").alias("lon"), F.concat(F.lpad(F.col("STATE_FIPS").cast("string"), 2, "0"), F.lpad(F.col("CZ_FIPS").cast("string"), 3, "0")).alias("county"),
    ).where(F.col("week").isNotNull() & (F.size("families") > 0))
    placed = F.col("lat").between(15, 75) & F.col("lon").between(-180, -50)
    refs = zips.select("zip", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    at = spatial.nearest(e.where(placed), refs, "id", "zip", reach_m, 0.2).where(F.col("zip").isNotNull())
    direct = e.join(at, "id").select("zip", "week", "families", F.col("weight").alias("share"))
    shared = spread_weight(e.where(~F.coalesce(placed, F.lit(False))), relations.select("zip", "county").distinct(), "county", "weight").select("zip", "week", "families", "share")
    each = direct.unionByName(shared).select("zip", "week", F.explode("families").alias("family"), "share")
    return each.groupBy("zip", "week", "family").agg(F.sum("share").alias("n"))


def national_field(history: DataFrame) -> DataFrame:
    """(zip, family, mean, a1, b1, a2, b2): scores against each family's 95th percentile, as harmonics over the year."""
    return harmonics(history_scores(history, ["family"], "n"), ["zip", "family"], "week", "score")
