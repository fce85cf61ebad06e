"""What trips teach: arrival and buffer averages, economy, homes, impacts, driving time. Averages that depend on order are
weighted sums, their weights known from a row's rank and the count; arrays are for short histories only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions.clock import decay

# Plausible ratios, floors and clamps of the arrival average.
ETA_SECONDS, ETA_LOW, ETA_HIGH, ETA_ALPHA, ETA_SAMPLES, ETA_DEADBAND, ETA_CLAMP = 60.0, 0.6, 1.8, 0.08, 5, 0.03, (0.75, 1.4)
# Economy learned after these miles, as a share of the rated one; and the smoothing of waits.
ECONOMY_MILES, ECONOMY_RATIO, WAIT_ALPHA, WAIT_SAMPLES, WAIT_RANGE = 25.0, (0.5, 1.6), 0.35, 3, (1.0, 180.0)
# Peaks of an impact, in g.
HARD_IMPACT, IMPACT, CONFIRM = 8.0, 5.0, 2.5


def history(df: DataFrame, key: str, order: list[str], keep: int, *columns: str) -> DataFrame:
    """The latest ``keep`` rows of each key as an array in order: a bounded history, cut before anything is gathered."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    df = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("history"))


def smoothed(df: DataFrame, key: str, order: list[str], block: Column, usable: Column, value: Column, weight: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, samples, mean) of every key: the sum of ``value`` times ``weight(rank, samples)`` over all usable rows, ranked from
    1 by ``order``; mean is null without one. ``block`` grows with ``order``: rows are ranked within a key's block and moved by
    the counts of the blocks before, so that no key's rows meet in one task."""
    rows = df.where(usable).select(F.col(key).alias("_key"), block.alias("_block"), *order, value.alias("_value"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("_key").alias("_k"), F.col("_block").alias("_b")).agg(F.count("*").alias("_c"))
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_c").over(earlier), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy("_k"))})
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_block").orderBy(*order)))
    rows = rows.join(totals, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_block").eqNullSafe(F.col("_b")))
    sums = rows.groupBy("_key").agg(F.count("*").alias("samples"), F.sum(F.col("_value") * weight(F.col("_before") + F.col("_rank"), F.col("_n"))).alias("mean"))
    found = df.select(key).distinct().join(sums, F.col(key).eqNullSafe(F.col("_key")), "left")
    return found.select(key, F.coalesce("samples", F.lit(0)).cast("int").alias("samples"), "mean")


def eta_usable(predicted: Column, actual: Column) -> Column:
    return (predicted > ETA_SECONDS) & (actual > ETA_SECONDS) & (actual / predicted).between(ETA_LOW, ETA_HIGH)


def eta_weight(rank: Column, n: Column) -> Column:
    """The share of a trip's logarithm after n usable trips: the mean of the first ones, then a fixed rate."""
    early = int(1 / ETA_ALPHA)
    later = F.when(rank <= early, F.pow(F.lit(1 - ETA_ALPHA), n - early) / early).otherwise(ETA_ALPHA * F.pow(F.lit(1 - ETA_ALPHA), n - rank))
    return F.when(n <= early, 1.0 / n).otherwise(later)


def eta_states(df: DataFrame, key: str, order: list[str], block: Column, predicted: Column, actual: Column) -> DataFrame:
    """(key, samples, log_ratio) after all trips of each key; implausible trips don't count."""
    found = smoothed(df, key, order, block, eta_usable(predicted, actual), F.log(actual / predicted), eta_weight)
    return found.select(key, "samples", F.coalesce("mean", F.lit(0.0)).alias("log_ratio"))


def wait_means(df: DataFrame, key: str, order: list[str], block: Column, value: str, prior: float) -> DataFrame:
    """(key, wait): the smoothed wait after all of each key's usable waits, or the prior until there are enough."""
    weight = lambda rank, n: F.when(rank == 1, 1.0).otherwise(WAIT_ALPHA) * F.pow(F.lit(1 - WAIT_ALPHA), n - rank)
    found = smoothed(df, key, order, block, F.col(value).between(*WAIT_RANGE), F.col(value), weight)
    return found.select(key, F.when(F.col("samples") >= WAIT_SAMPLES, F.col("mean")).otherwise(F.lit(prior)).alias("wait"))


def eta_state(rows: Column, predicted: str, actual: str) -> Column:
    """struct(log_ratio, samples) after a history of trips; implausible trips don't count."""
    zero = F.struct(F.lit(0.0).alias("log_ratio"), F.lit(0).alias("samples"))

    def add(s: Column, r: Column) -> Column:
        ratio = r[actual] / r[predicted]
        usable = eta_usable(r[predicted], r[actual])
        n = s["samples"] + 1
        alpha = F.greatest(1.0 / n, F.lit(ETA_ALPHA))
        return F.when(usable, F.struct((s["log_ratio"] * (1 - alpha) + F.log(ratio) * alpha).alias("log_ratio"), n.alias("samples"))).otherwise(s)

    return F.aggregate(rows, zero, add)


def eta_multiplier(state: Column) -> Column:
    raw = F.exp(state["log_ratio"])
    clamped = F.least(F.lit(ETA_CLAMP[1]), F.greatest(F.lit(ETA_CLAMP[0]), raw))
    return F.when((state["samples"] < ETA_SAMPLES) | (F.abs(raw - 1) < ETA_DEADBAND), 1.0).otherwise(clamped)


def wait_mean(rows: Column, value: str, prior: float) -> Column:
    """The smoothed wait after a history, or the prior until there are enough usable samples."""
    good = F.filter(rows, lambda r: r[value].between(*WAIT_RANGE))
    mean = F.aggregate(F.slice(good, F.lit(2), F.greatest(F.size(good), F.lit(1))), F.get(good, F.lit(0))[value], lambda m, r: m + WAIT_ALPHA * (r[value] - m))
    return F.when(F.size(good) >= WAIT_SAMPLES, mean).otherwise(F.lit(prior))


def economy(df: DataFrame, local: list[str], pool: list[str], miles: Column, units: Column, rated: float, age_days: Column) -> DataFrame:
    """Miles a unit by cell: its own, once driven far enough, else its pool's, else the rated one; half-life 180 days."""
    w = decay(age_days, 180.0)

    def cells(keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum(w * miles).alias("miles"), F.sum(w * units).alias("units"))

    mine, all_ = cells(local), cells(pool).select(*pool, F.col("miles").alias("_m"), F.col("units").alias("_u"))
    ratio = lambda m, u: F.least(F.lit(ECONOMY_RATIO[1]), F.greatest(F.lit(ECONOMY_RATIO[0]), m / u / rated)) * rated
    both = mine.join(all_, pool, "left")
    value = F.when(F.col("miles") >= ECONOMY_MILES, ratio(F.col("miles"), F.col("units"))).when(F.col("_m") >= ECONOMY_MILES, ratio(F.col("_m"), F.col("_u"))).otherwise(F.lit(rated))
    return both.select(*local, value.alias("economy"))


def home(origins: DataFrame, key: str, cell: str, age_days: Column, least: int = 15) -> DataFrame:
    """The origin with the greatest decayed weight (half-life 30 days), for travellers with ``least`` trips; ties to the least cell."""
    by_cell = origins.groupBy(key, cell).agg(F.sum(decay(age_days, 30.0)).alias("weight"), F.count("*").alias("n"))
    best = by_cell.groupBy(key).agg(F.sum("n").alias("trips"), F.min(F.struct((-F.round("weight", 9)).alias("w"), cell)).alias("b"))
    return best.where(F.col("trips") >= least).select(key, F.col(f"b.{cell}").alias(cell), "trips")


def is_impact(window: Column) -> Column:
    """A window of readings with a hard peak, or a peak confirmed by three readings."""
    peak = F.array_max(window)
    return (peak >= HARD_IMPACT) | ((peak >= IMPACT) & (F.size(F.filter(window, lambda g: g >= CONFIRM)) >= 3))


def share_scores(df: DataFrame, key: str, age_days: Column) -> DataFrame:
    return df.groupBy(key).agg(F.sum(decay(age_days, 30.0)).alias("score"), F.max("ts").alias("latest"))
