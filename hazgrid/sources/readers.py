"""Readers of the public input files, each with a stated schema. Rows that don't fit come as nulls, and filters say which stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazgrid.functions.clock import service_seconds
from hazgrid.functions.text import county_key

# Columns of a transit feed's files.
GTFS = {
    "agency": "agency_id string, agency_timezone string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double, parent_station string, location_type int",
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, pickup_type int, drop_off_type int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
    "frequencies": "trip_id string, start_time string, end_time string, headway_secs int",
    "transfers": "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int",
    "fare_attributes": "fare_id string, price double, currency_type string, payment_method int, transfers int, agency_id string, transfer_duration int",
    "fare_rules": "fare_id string, route_id string, origin_id string, destination_id string, contains_id string",
    "feed_info": "feed_publisher_name string, feed_publisher_url string, feed_lang string, feed_start_date string, feed_end_date string, feed_version string",
}


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", **options).csv(path)
    return df.toDF(*(c.replace("﻿", "").strip() for c in df.columns))


def _typed(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns by name, in any order in the file; missing ones are null."""
    fields = [f.split() for f in schema.split(", ")]
    return df.select(*((F.trim(df[n]).try_cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields))


def storm_events(spark: SparkSession, path: str) -> DataFrame:
    """Storm events with quoted fields and line ends in them; rows without a real date go."""
    df = _typed(_csv(spark, path), "BEGIN_YEARMONTH int, BEGIN_DAY int, EVENT_TYPE string, STATE_FIPS int, CZ_TYPE string, CZ_FIPS int, CZ_NAME string, BEGIN_LAT double, BEGIN_LON double, MAGNITUDE double")
    month, day = F.col("BEGIN_YEARMONTH") % 100, F.col("BEGIN_DAY")
    return df.where(month.between(1, 12) & day.between(1, 31)).withColumn("county", county_key(F.col("CZ_NAME")))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(zip, lat, lon) of a tab-separated gazetteer; one row for each five-digit id, the least position first."""
    df = _typed(spark.read.options(header=True, sep="\t", ignoreTrailingWhiteSpace=True, ignoreLeadingWhiteSpace=True).csv(path), "GEOID string, INTPTLAT double, INTPTLONG double")
    df = df.where(F.col("GEOID").rlike("^[0-9]{5}$"))
    return df.groupBy(F.col("GEOID").alias("zip")).agg(F.min(F.struct(F.col("INTPTLAT").alias("lat"), F.col("INTPTLONG").alias("lon"))).alias("p")).select("zip", "p.*")


def county_relations(spark: SparkSession, path: str) -> DataFrame:
    """(zip, county, name) of a pipe-separated relation file, which may begin with a byte-order mark."""
    df = _typed(_csv(spark, path, sep="|"), "GEOID_ZCTA5_20 string, GEOID_COUNTY_20 string, NAMELSAD_COUNTY_20 string")
    df = df.where(F.col("GEOID_ZCTA5_20").rlike("^[0-9]{5}$"))
    return df.select(F.col("GEOID_ZCTA5_20").alias("zip"), F.col("GEOID_COUNTY_20").alias("county"), county_key(F.col("NAMELSAD_COUNTY_20")).alias("name")).distinct()


def gtfs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file of a transit feed by its header; a file that isn't there is an empty table."""
    schema = GTFS[name]
    path = f"{folder}/{name}.txt"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return _typed(_csv(spark, path), schema)


#: Files without which a feed is of no use; of the calendars one will do.
NEEDED, CALENDARS = ("agency", "stops", "routes", "trips", "stop_times"), ("calendar", "calendar_dates")
_IDS = ("agency_id", "stop_id", "parent_station", "route_id", "service_id", "trip_id", "from_stop_id", "to_stop_id", "fare_id", "origin_id", "destination_id", "contains_id")


def gtfs_feeds(spark: SparkSession, folders: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All files of many feeds, by name, and (feed_no, folder, problem) of the feeds that were left out: those without a file
    that is needed, without a calendar, or without a trip. Rows carry feed_no, the feed's place in ``folders``, and ids are
    led by it, so that those of different feeds don't meet; its agency's zone is that of its first row."""
    kept: dict[str, list[DataFrame]] = {name: [] for name in GTFS}
    problems = []
    for number, folder in enumerate(folders):
        files = {name: gtfs(spark, folder, name) for name in GTFS}
        empty = [name for name in NEEDED if files[name].isEmpty()]
        if not empty and all(files[name].isEmpty() for name in CALENDARS):
            empty = ["calendar"]
        if empty:
            problems.append((number, folder, f"no {empty[0]}"))
            continue
        for name, df in files.items():
            ids = {c: F.concat(F.lit(f"{number}:"), F.col(c)) for c in df.columns if c in _IDS}
            kept[name].append(df.withColumns(ids).withColumn("feed_no", F.lit(number)))
    none = {name: spark.createDataFrame([], schema + ", feed_no int") for name, schema in GTFS.items()}
    tables = {name: reduce(DataFrame.unionByName, parts) if parts else none[name] for name, parts in kept.items()}
    return tables, spark.createDataFrame(problems, "feed_no int, folder string, problem string")


def agency_zones(agency: DataFrame) -> DataFrame:
    """(feed_no, zone): the zone of each feed's first agency that states one, by agency id."""
    stated = agency.where(F.trim("agency_timezone") != "")
    return stated.groupBy("feed_no").agg(F.min(F.struct(F.coalesce("agency_id", F.lit("")).alias("a"), F.trim("agency_timezone").alias("zone")))["zone"].alias("zone"))


def stop_events(stop_times: DataFrame) -> DataFrame:
    """stop_times with times as seconds; a blank time lies on the straight line between its neighbours that have one."""
    from pyspark.sql import Window

    df = stop_times.withColumns({"arrive": service_seconds(F.coalesce("arrival_time", "departure_time")), "depart": service_seconds(F.coalesce("departure_time", "arrival_time"))})
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col("arrive").isNotNull(), F.struct("_i", "arrive", "depart"))
    df = df.withColumns({"_a": F.last(at, ignorenulls=True).over(back), "_b": F.first(at, ignorenulls=True).over(ahead)})
    line = F.col("_a.depart") + F.floor((F.col("_b.arrive") - F.col("_a.depart")) * (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))).cast("int")
    return df.withColumns({"arrive": F.coalesce("arrive", line), "depart": F.coalesce("depart", line)}).drop("_i", "_a", "_b")


def active_services(calendar: DataFrame, dates: DataFrame, day: str) -> DataFrame:
    """service_ids that run on ``day`` (YYYYMMDD): the week's pattern, and what the day adds, without what it removes."""
    d = F.to_date(F.lit(day), "yyyyMMdd")
    names = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    flag = F.element_at(F.array(*names), F.weekday(d) + 1) == 1
    regular = calendar.where(flag & F.lit(day).between(F.col("start_date"), F.col("end_date"))).select("service_id")
    today = dates.where(F.col("date") == day)
    added = today.where("exception_type = 1").select("service_id")
    removed = today.where("exception_type = 2").select("service_id")
    return regular.union(added).distinct().join(removed, "service_id", "left_anti")


def alerts_json(spark: SparkSession, path: str) -> DataFrame:
    """Features of alert collections as rows: id, event, severity, expires, ring of the first polygon, affected zones."""
    schema = "features array<struct<id:string,properties:struct<event:string,severity:string,expires:string,affectedZones:array<string>>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select("f.id", "f.properties.event", "f.properties.severity", F.to_timestamp("f.properties.expires").alias("expires"), ring.alias("ring"), F.col("f.properties.affectedZones").alias("zones"))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, description, pubDate."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)


def zone_counties(spark: SparkSession, path: str) -> DataFrame:
    """(state, zone, county) of a pipe-separated file without a header: zones to three digits, real states and counties only."""
    c = spark.read.text(path).select(F.split("value", r"\|").alias("c")).where(F.size("c") >= 7)
    at = lambda i: F.trim(F.get("c", F.lit(i)))
    rows = c.select(at(0).alias("state"), at(1).alias("zone"), at(6).alias("county"))
    rows = rows.where((F.length("state") == 2) & (F.col("zone") != "") & (F.length("county") == 5))
    # Zones of more than three characters stay as they are.
    return rows.withColumn("zone", F.when(F.length("zone") < 3, F.lpad("zone", 3, "0")).otherwise(F.col("zone"))).distinct()


def zone_zips(zones: DataFrame, relations: DataFrame) -> DataFrame:
    """(state, zone, zip): the postal areas of a zone's counties, each once."""
    return zones.join(relations.select("county", "zip"), "county").select("state", "zone", "zip").distinct()


def zones_by_name(zones: DataFrame, counties: DataFrame) -> DataFrame:
    """(state, zone_name, county) for zones (state, zone_name in capitals) and counties (state, name, county): the county of just
    that name, else every county whose name stands in it as a word. Counties meet zones of their state by their first word."""
    first = lambda c: F.regexp_extract(c, "([A-Z0-9]+)", 1)
    zones = zones.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all("zone_name", F.lit("[A-Z0-9]+"), F.lit(0)))))
    pairs = zones.join(counties.withColumn("word", first(F.col("name"))), ["state", "word"])
    bounded = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), "name", F.lit("\\E(?![A-Za-z0-9])"))
    found = pairs.where(F.regexp_like("zone_name", bounded)).withColumn("exact", F.col("name") == F.col("zone_name"))
    some = found.groupBy("state", "zone_name").agg(F.bool_or("exact").alias("any_exact"))
    return found.join(some, ["state", "zone_name"]).where(F.col("exact") | ~F.col("any_exact")).select("state", "zone_name", "county").distinct()


def airports(spark: SparkSession, path: str) -> DataFrame:
    """(iata, name, city, country, region, lat, lon, size) of airports with scheduled service in three countries, one a code."""
    df = _typed(_csv(spark, path), "type string, name string, latitude_deg double, longitude_deg double, iso_country string, iso_region string, municipality string, scheduled_service string, iata_code string")
    size = F.regexp_extract("type", "^(large|medium|small)_airport$", 1)
    rows = df.select(
        F.upper("iata_code").alias("iata"), F.col("name"), F.col("municipality").alias("city"), F.upper("iso_country").alias("country"), F.upper("iso_region").alias("region"), F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"),
        size.alias("size"), "scheduled_service",
    )
    good = (F.col("scheduled_service") == "yes") & F.col("iata").rlike("^[A-Z]{3}$") & F.col("country").isin("US", "CA", "MX") & (F.col("size") != "") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    names = ["name", "city", "country", "region", "lat", "lon", "size"]
    return rows.where(good).groupBy("iata").agg(F.min(F.struct(*names)).alias("a")).select("iata", "a.*")


def transit_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of a catalogue with the reason why each is not used (null for those that are): id, provider, url, box and dropped."""
    raw = _csv(spark, path)
    names = {
        "id": "id", "data_type": "type", "location.country_code": "country", "provider": "provider", "urls.direct_download": "direct", "urls.latest": "latest", "urls.authentication_type": "auth", "status": "status", "redirect.id": "redirect",
        "location.bounding_box.minimum_latitude": "south", "location.bounding_box.maximum_latitude": "north", "location.bounding_box.minimum_longitude": "west", "location.bounding_box.maximum_longitude": "east",
    }
    df = raw.select(*(F.trim(F.coalesce(F.col(f"`{old}`"), F.lit(""))).alias(new) for old, new in names.items()))
    edge = lambda c: F.col(c).try_cast("double")
    link = lambda c: F.col(c).rlike("^https?://")
    flat = (edge("south") >= edge("north")) | (edge("west") >= edge("east")) | (edge("north") - edge("south") > 25) | (edge("east") - edge("west") > 40)
    why = (
        F.when(F.col("type") != "gtfs", "not static").when(~F.upper("country").isin("US", "CA", "MX"), "other country").when(~F.col("auth").isin("", "0"), "needs a key").when(~link("direct") & ~link("latest"), "no link")
        .when(F.lower("status") == "deprecated", "deprecated").when(F.col("redirect") != "", "redirected").when(edge("south").isNull() | edge("north").isNull() | edge("west").isNull() | edge("east").isNull(), "no box").when(flat, "unusable box")
        .when(F.col("id") == "", "no id")
    )
    key = F.when(F.col("id").rlike("^[0-9]+$"), F.concat(F.lit("mdb-"), "id")).otherwise(F.col("id"))
    return df.select(key.alias("id"), "provider", F.when(link("direct"), F.col("direct")).otherwise(F.col("latest")).alias("url"), *(edge(c).alias(c) for c in ("south", "north", "west", "east")), why.alias("dropped"))


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows for training without a header of their own kind: eight numbers, the target within 0..1, the weight not below 0; rows
    with fewer, or with one that isn't a number, are left out."""
    names = ("o_lat", "o_lon", "d_lat", "d_lon", "week", "target", "weight", "cross_country")
    parts = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    df = spark.read.text(path).where(~F.col("value").startswith("oLat")).select(parts.alias("f"))
    df = df.where((F.size("f") >= 8) & F.forall(F.slice("f", 1, 8), lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = df.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))
    return rows.withColumns({"target": F.least(F.greatest("target", F.lit(0.0)), F.lit(1.0)), "weight": F.greatest("weight", F.lit(0.0)), "cross_country": F.col("cross_country") > 0.5})


def model_head(model: DataFrame, path: str) -> None:
    """Write a one-row table of weights as JSON; Spark commits it whole."""
    model.coalesce(1).write.mode("overwrite").json(path)
