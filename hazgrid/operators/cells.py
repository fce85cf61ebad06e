"""Alerts held by grid cells, and samples of a route that look theirs up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions import alerting

#: Cells a degree.
CELLS = 4


def alert_cell(lat: Column, lon: Column) -> Column:
    return F.concat_ws("|", F.round(lat * CELLS).cast("long"), F.round(lon * CELLS).cast("long"))


def worst_in_cell(samples: DataFrame, alerts: DataFrame, key: str, now: Column, warnings_first: bool = False) -> DataFrame:
    """For each of ``samples`` (key, lat, lon, arrival) whose cell is among those of ``alerts`` (cell, place, alert_id, event,
    severity, expires): the worst alert that is active on arrival, by severity, or by tier first; the first in place on
    ties. Risk is 0 and the rest null where none is active; samples of cells that weren't looked at are left out.

    Of a cell's alerts that end at one time only the first in order can be the worst, and of these only those that outlast every
    one before them; samples of one cell and arrival have one answer. So neither a hot cell's alerts nor its samples meet row by row."""
    s = samples.select(key, "arrival", alert_cell(F.col("lat"), F.col("lon")).alias("cell"))
    order = [-F.col("severity"), F.col("place")]
    if warnings_first:
        order.insert(0, -alerting.sample_tier(F.col("event"), F.col("severity")))
    names = [f"o{i}" for i in range(len(order))]
    first = F.min(F.struct(*(c.alias(n) for c, n in zip(order, names, strict=True)), "severity", "event", "alert_id")).alias("w")
    ends = alerts.groupBy("cell", "expires").agg(first)
    before = Window.partitionBy("cell").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce(F.col("expires").cast("double"), F.lit(float("inf")))
    ends = ends.withColumn("_until", F.max(until).over(before)).where(F.col("_until").isNull() | (until > F.col("_until"))).drop("_until")
    pairs = s.select("cell", "arrival").distinct().join(ends, "cell")
    active = alerting.is_active(F.col("expires"), F.col("arrival"), now)
    worst = pairs.groupBy("cell", "arrival").agg(F.min(F.when(active, F.col("w"))).alias("w")).withColumnsRenamed({"cell": "_cell", "arrival": "_arrival"})
    found = s.join(worst, (F.col("cell") == F.col("_cell")) & F.col("arrival").eqNullSafe(F.col("_arrival"))).groupBy(key).agg(F.min("w").alias("w"))
    return found.select(key, F.coalesce("w.severity", F.lit(0.0)).alias("risk"), F.col("w.event").alias("event"), F.col("w.alert_id").alias("alert_id"))


def corridor_noisy_or(hits: DataFrame, route: str, alert: str, severity: str, coverage: str) -> DataFrame:
    """(route, risk) over its distinct alerts: the chance that one of them, as strong as severity times coverage, strikes."""
    each = hits.groupBy(route, alert).agg(F.max(F.col(severity) * F.col(coverage)).alias("_p"))
    p = F.least(F.greatest("_p", F.lit(0.0)), F.lit(1.0))
    return each.groupBy(route).agg((1 - F.product(1 - p)).alias("risk"))
