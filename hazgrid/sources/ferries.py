"""The ferry census: four files joined to routes in service, and how often they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazgrid.sources.readers import _csv, _typed

# The census's files and the columns that are read of them; days of a year before each month.
FILES = {
    "terminals": "terminal_id int, in_operation string, latitude double, longitude double, terminal_name string, term_city string, term_state string",
    "operators": "operator_id int, operator_name string, url string",
    "segments": "segment_id int, segment_name string, seg_terminal1_id int, seg_terminal2_id int",
    "operator_segments": "operator_id int, segment_id int, segment_season_start string, segment_season_end string, segment_length double, average_trip_time int, trips_per_year int, vehicles double",
}
BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def month_day(text: Column) -> Column:
    """struct(m, d) of a date like 5/28/2024 or 2024-05-28; null for none."""
    pattern = r"^\s*(?:\d{4}-)?(\d{1,2})[/-](\d{1,2})"
    m, d = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    return F.when(m.between(1, 12) & d.between(1, 31), F.struct(m.alias("m"), d.alias("d")))


def season_days(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end`` (struct(m, d)), both counted, over the year's end if need be; a year without a season."""
    day = lambda s: F.get(F.array(*map(F.lit, BEFORE)), s["m"] - 1) + s["d"]
    days = day(end) - day(start)
    return F.when(start.isNull() | end.isNull(), 365).otherwise(F.when(days >= 0, days + 1).otherwise(days + 366))


def crossings_a_day(trips_per_year: Column, start: Column, end: Column) -> Column:
    return F.when(trips_per_year == 0, 0.0).otherwise(trips_per_year / season_days(start, end))


def census(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: _typed(_csv(spark, f"{folder}/{name}.csv"), schema) for name, schema in FILES.items()}


def routes(tables: dict[str, DataFrame]) -> DataFrame:
    """(segment, operator, name, a, b, miles, minutes, start, end, trips_per_year, cars, per_day, operator_name, url) of the segments
    that an operator runs between two different terminals in service with a real place; one row for each segment and operator,
    the first by its season of several. Numbers that can't be read are 0, cars null; a link that is no web address is empty."""
    sound = (F.col("in_operation") == "1") & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & (F.col("latitude") != 0)
    terminals = tables["terminals"].where(sound & F.col("terminal_id").isNotNull()).select("terminal_id").distinct()
    link = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise("")
    operators = tables["operators"].where(F.col("operator_id").isNotNull()).groupBy(F.col("operator_id").alias("operator")).agg(F.max(F.struct("operator_name", link.alias("url"))).alias("o"))
    segments = tables["segments"].select(F.col("segment_id").alias("segment"), F.col("segment_name").alias("name"), F.col("seg_terminal1_id").alias("a"), F.col("seg_terminal2_id").alias("b")).where("segment is not null and a <> b")
    for end in ("a", "b"):
        segments = segments.join(terminals.withColumnRenamed("terminal_id", end), end, "left_semi")
    segments = segments.groupBy("segment").agg(F.max(F.struct("name", "a", "b")).alias("s")).select("segment", "s.*")
    start, end_ = month_day(F.col("segment_season_start")), month_day(F.col("segment_season_end"))
    season = lambda c: F.when(start.isNotNull() & end_.isNotNull(), c)
    runs = tables["operator_segments"].select(
        F.col("operator_id").alias("operator"), F.col("segment_id").alias("segment"), F.coalesce("segment_length", F.lit(0.0)).alias("miles"), F.coalesce("average_trip_time", F.lit(0)).alias("minutes"),
        season(start).alias("start"), season(end_).alias("end"), F.coalesce("trips_per_year", F.lit(0)).alias("trips_per_year"), (F.col("vehicles") > 0).alias("cars"),
    )
    rest = ["start", "end", "miles", "minutes", "trips_per_year", "cars"]
    runs = runs.groupBy("segment", "operator").agg(F.min(F.struct(*rest)).alias("r")).select("segment", "operator", "r.*")
    found = runs.join(segments, "segment").join(operators, "operator")
    return found.select("segment", "operator", "name", "a", "b", *rest[2:4], *rest[:2], *rest[4:], crossings_a_day(F.col("trips_per_year"), F.col("start"), F.col("end")).alias("per_day"), "o.operator_name", "o.url")
