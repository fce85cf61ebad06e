"""Exponentially decayed statistics and the ladders that read them, as batch aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.clock import decay, week_distance

HALF_LIFE_WEEKS = 52.0
# Kernel of the seasonal prior, by distance in weeks; weight for full confidence.
KERNEL = {0: 1.0, 1: 0.5}
FULL_CONFIDENCE = 5.0
# Trips that a route needs for a prior, and a long one.
TRIPS, TRIPS_FAR = 6, 2


def decayed(df: DataFrame, keys: list[str], age: Column, half_life: float, **sums: Column) -> DataFrame:
    """By ``keys``: weight (the decayed count), n, and each of ``sums`` decayed."""
    w = decay(age, half_life)
    return df.groupBy(*keys).agg(F.sum(w).alias("weight"), F.count("*").alias("n"), *(F.sum(w * c).alias(name) for name, c in sums.items()))


def seasonal_prior(cells: DataFrame, keys: list[str], week: Column, trips: Column | None = None, far: Column | None = None) -> DataFrame:
    """Prior and confidence for ``week`` from cells (keys, week, weight, observed): the week and its neighbours at half weight; the
    confidence is the week's own. A key needs six trips (``trips``, of all its cells together), two where ``far`` holds."""
    d = week_distance(F.col("week"), week)
    k = F.when(d == 0, KERNEL[0]).when(d == 1, KERNEL[1])
    total = F.sum(k * F.col("weight"))
    gate = F.lit(True) if trips is None else F.sum(trips) >= F.when(F.lit(False) if far is None else F.coalesce(F.bool_or(far), F.lit(False)), TRIPS_FAR).otherwise(TRIPS)
    own = F.coalesce(F.sum(F.when(d == 0, F.col("weight"))), F.lit(0.0))
    found = cells.groupBy(*keys).agg(gate.alias("_gate"), (F.sum(k * F.col("observed")) / total).alias("prior"), F.least(F.lit(1.0), own / FULL_CONFIDENCE).alias("confidence"), total.alias("_total"))
    return found.where(F.col("_gate") & (F.col("_total") > 0)).drop("_gate", "_total")


def ladder(local: DataFrame, pooled: DataFrame, keys: list[str], pooled_keys: list[str], least: int, low: float, high: float) -> DataFrame:
    """Each local cell's factor: its own mean once it has ``least`` samples, else its pool's, else 1; clamped."""
    pooled = pooled.select(*pooled_keys, F.col("mean").alias("_pm"), F.col("n").alias("_pn"))
    clamp = lambda c: F.least(F.lit(high), F.greatest(F.lit(low), c))
    factor = F.when(F.col("n") >= least, clamp(F.col("mean"))).when(F.col("_pn") >= least, clamp(F.col("_pm"))).otherwise(1.0)
    return local.join(pooled, pooled_keys, "left").select(*keys, factor.alias("factor"))


def everyday_radius(trips: DataFrame, key: str, miles: str) -> DataFrame:
    """The 0.85 quantile of a traveller's trips, within 3 to 150 miles; 20 until there are 30 trips."""
    good = F.when(F.col(miles) >= 0, F.col(miles))
    q = F.percentile(good, 0.85)
    return trips.groupBy(key).agg(F.when(F.count(good) < 30, 20.0).otherwise(F.least(F.lit(150.0), F.greatest(F.lit(3.0), q))).alias("radius"))


def destination_scores(evidence: DataFrame, age_days: Column) -> DataFrame:
    """Counts by context, time and total, weighted 3, 1.5 and 1, halved every 21 days."""
    counts = 3 * F.col("context_hits") + 1.5 * F.col("time_hits") + F.col("total_hits")
    return evidence.where(counts > 0).withColumn("score", counts * decay(age_days, 21.0))


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average over an array in its order, from its first element."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda m, x: m + alpha * (x - m))


def displayed_risk(samples: DataFrame, keys: list[str], risk: str, length: str) -> DataFrame:
    """Length-weighted mean of risks, lifted to the peak where that is red."""
    return samples.groupBy(*keys).agg((F.sum(F.col(risk) * F.col(length)) / F.sum(length)).alias("_mean"), F.max(risk).alias("peak")).select(
        *keys, "peak", F.when(F.col("peak") > 0.8751, F.greatest("_mean", "peak")).otherwise(F.col("_mean")).alias("displayed")
    )
