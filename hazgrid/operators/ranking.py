"""Rankings of candidates and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions.geo import meters

# Driving speed that turns a detour into time, and the worth of an hour.
METRES_PER_HOUR, DOLLARS_PER_HOUR = 60 * 1609.344, 30.0


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows by ``keys``. Spark cuts each task's rows to k before it shuffles them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def admissible(df: DataFrame, max_detour: float) -> DataFrame:
    return df.where((F.col("ahead_meters") > -500) & (F.col("detour_meters") <= max_detour))


def detour_hours() -> Column:
    return F.col("detour_meters") / METRES_PER_HOUR


def soonest() -> Column:
    return F.col("ahead_meters") + 3 * F.col("detour_meters")


def fuel_cost(fill: float, average: float) -> Column:
    return F.coalesce("price", F.lit(average)) * fill + detour_hours() * DOLLARS_PER_HOUR


def hotel_value(average: float) -> Column:
    return F.coalesce("rating", F.lit(3.5)) / 5.0 * 2 - F.coalesce("price", F.lit(average)) / max(average, 1.0) - detour_hours() * 1.5


def parking_cost(tier: Column) -> Column:
    return F.coalesce(F.col("price"), tier * 4.0) + soonest() / 1000


def spread_along(df: DataFrame, keys: list[str], ahead: str, total: str, order: list[Column], parts: int) -> DataFrame:
    """The best row of each equal part of a trip."""
    part = F.least(F.lit(parts - 1), F.floor(F.col(ahead) * parts / F.col(total))).cast("int")
    return top_k(df.withColumn("part", part), [*keys, "part"], order, 1).drop("rank")


def designations(routes: DataFrame, group: str, route: str, risk: str, cost: str, seconds: str) -> DataFrame:
    """The safest, cheapest and fastest route of each group, ties to the least route; groups of one have none."""
    best = lambda c: F.min(F.struct(c, route))[route]
    return routes.groupBy(group).agg(F.count("*").alias("_n"), best(risk).alias("safest"), best(cost).alias("cheapest"), best(seconds).alias("fastest")).where("_n > 1").drop("_n")


def closest_matches(routes: DataFrame, group: str, route: str, broken: list[Column], risk: str, seconds: str) -> DataFrame:
    """(group, route, broken): the route of each group that breaks the fewest of the rules (true where a rule is broken), then
    the least risk, then the soonest, then the least route."""
    n = F.lit(0)
    for rule in broken:
        n = n + F.coalesce(rule, F.lit(False)).cast("int")
    best = routes.groupBy(group).agg(F.min(F.struct(n.alias("broken"), F.col(risk), F.col(seconds), F.col(route))).alias("b"))
    return best.select(group, F.col("b")[route].alias(route), F.col("b.broken").alias("broken"))


def planned(routes: DataFrame, group: str, route: str, kind: str, key: Column, seconds: str, order: dict[str, int], rescued: list[str], k: int = 5) -> DataFrame:
    """(group, route, kind, seconds) of at most ``k`` routes of each group: of routes with one ``key`` the first kind in ``order``
    counts, the soonest stay, and a kind of ``rescued`` that has none among them takes the last place of those not taken."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(kind))
    first = routes.withColumns({"_key": key, "_rank": rank}).groupBy(group, "_key").agg(F.min(F.struct("_rank", F.col(seconds).alias("s"), F.col(route).alias("r"), F.col(kind).alias("k"))).alias("f"))
    each = first.select(group, F.col("f.s").alias("s"), F.col("f.r").alias("r"), F.col("f.k").alias("k"))
    w = Window.partitionBy(group).orderBy("s", "r")
    each = each.withColumn("_n", F.row_number().over(w))
    has = lambda c: F.max(F.when((F.col("_n") <= k) & (F.col("k") == c), 1).otherwise(0)).over(Window.partitionBy(group))
    best = lambda c: (F.col("k") == c) & (F.row_number().over(Window.partitionBy(group, "k").orderBy("s", "r")) == 1)
    taken, saved = F.lit(0), F.lit(False)
    for c in rescued:
        missing = (has(c) == 0) & (F.max(F.when(F.col("k") == c, 1).otherwise(0)).over(Window.partitionBy(group)) == 1)
        saved = saved | (missing & best(c))
        taken = taken + missing.cast("int")
    kept = each.withColumns({"_taken": taken, "_saved": saved}).where(F.col("_saved") | (F.col("_n") <= k - F.col("_taken")))
    return kept.select(group, F.col("r").alias(route), F.col("k").alias(kind), F.col("s").alias(seconds))


def ranked_stations(stations: DataFrame, key: str, station: str, k: int) -> DataFrame:
    """The first ``k`` stations (key, lat, lon, station, ref_lat, ref_lon, bitrate) of each key: those with a place nearest first, the
    others after them; of equal ones those with the higher bitrate, then the least station. Without a position only bitrate counts."""
    d = meters(F.col("ref_lat"), F.col("ref_lon"), F.col("lat"), F.col("lon"))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("meters"), F.desc("bitrate"), station)
    return stations.withColumn("meters", d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, station, "meters", "rank")
