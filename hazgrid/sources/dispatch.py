"""Cities' open feeds of calls: rows as JSON, read by a table of feeds, to incidents with kinds and lifetimes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.functions.geo import meters


@dataclass(frozen=True)
class Feed:
    """Where a city's feed is, which fields hold what, and the words that tell a call's kind, in order."""

    id: str
    lat: float
    lon: float
    radius: float
    id_field: str
    type_fields: tuple[str, ...]
    time_field: str
    place_field: str
    zone: str
    words: tuple[tuple[str, str], ...]
    default: str
    point_field: str | None = None
    place_fields: tuple[str, str] | None = None
    priority_field: str | None = None
    priorities: tuple[str, ...] = ()


# The feeds, seconds that a call stays by kind, the words of threats, and metres of one that is near and that a
# feed reaches beyond its city.
FEEDS = (
    Feed(
        "sf-police", 37.7749, -122.4194, 16_000, "cad_number", ("call_type_final_desc", "call_type_original_desc"), "received_datetime", "intersection_name", "America/Los_Angeles",
        (("medical", "medical"), ("injur", "medical"), ("collision", "traffic")), "police", point_field="intersection_point", priority_field="priority_final", priorities=("A", "B"),
    ),
    Feed(
        "seattle-fire", 47.6062, -122.3321, 18_000, "incident_number", ("type",), "datetime", "address", "America/Los_Angeles",
        (("aid", "medical"), ("medic", "medical"), ("mvi", "traffic"), ("motor vehicle", "traffic"), ("rescue", "rescue"), ("hazmat", "hazard"), ("hazardous", "hazard"), ("fire", "fire")), "fire",
        place_fields=("latitude", "longitude"),
    ),
)
LONG_KINDS, LONG, USUAL = ("fire", "hazard"), 5_400, 3_600
THREATS = ("shot", "shoot", "gun", "firearm", "armed", "weapon", "robbery", "stab", "carjack", "hostage", "kidnap", "explosi", "bomb", "fire")
NO_THREATS = ("alarm", "fireworks", "false")
NEAR, BEYOND = 1_600.0, 25_000.0


def lifetime(kind: Column) -> Column:
    return F.when(kind.isin(*LONG_KINDS), LONG).otherwise(USUAL)


def local_seconds(text: Column, zone: str) -> Column:
    """Seconds since 1970 of a local time without zone, whatever the session's zone; null for no time."""
    whole = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))
    return F.unix_seconds(F.to_utc_timestamp(whole, zone))


def incidents(rows: DataFrame, feeds: tuple[Feed, ...] = FEEDS) -> DataFrame:
    """(feed, id, kind, type, place, lat, lon, heard, lifetime) of ``rows`` (feed, row: JSON). Rows without a place, a time or a
    name, of a priority that the feed's users don't need, at 0, 0, of an unknown feed, or that are no JSON are left out."""
    names = {n: "string" for f in feeds for n in (f.id_field, *f.type_fields, f.time_field, f.place_field, *(f.place_fields or ()), f.priority_field) if n}
    names |= {f.point_field: "struct<coordinates:array<double>>" for f in feeds if f.point_field}
    read = rows.select("feed", F.from_json("row", ", ".join(f"`{n}` {kind}" for n, kind in names.items())).alias("p"))

    def by_feed(of) -> Column:
        return F.coalesce(*(F.when(F.col("feed") == f.id, of(f)) for f in feeds))

    field = lambda name: F.col("p")[name]
    at = lambda f, k: F.get(field(f.point_field)["coordinates"], F.lit(1 - k)) if f.point_field else field(f.place_fields[k]).try_cast("double")
    read = read.select(
        "feed", by_feed(lambda f: field(f.id_field)).alias("_id"), by_feed(lambda f: F.coalesce(*(F.when(field(t) != "", field(t)) for t in f.type_fields))).alias("type"), by_feed(lambda f: field(f.time_field)).alias("_at"),
        by_feed(lambda f: F.coalesce(field(f.place_field), F.lit(""))).alias("place"), by_feed(lambda f: at(f, 0)).alias("lat"), by_feed(lambda f: at(f, 1)).alias("lon"),
        by_feed(lambda f: field(f.priority_field).isin(*f.priorities) if f.priority_field else F.lit(True)).alias("_wanted"),
    )
    sound = F.col("_wanted") & F.col("type").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ((F.abs("lat") > 0.01) | (F.abs("lon") > 0.01))
    lower = F.lower("type")

    def kind(f: Feed) -> Column:
        found = F.lit(f.default)
        for word, named in reversed(f.words):
            found = F.when(F.contains(lower, F.lit(word)), named).otherwise(found)
        return found

    read = read.where(sound).select(
        "feed", F.concat_ws("|", "feed", F.coalesce("_id", F.concat_ws("|", "_at", "type"))).alias("id"), by_feed(kind).alias("kind"), "type", "place", "lat", "lon", by_feed(lambda f: local_seconds(F.col("_at"), f.zone)).alias("heard")
    )
    return read.where(F.col("heard").isNotNull()).withColumn("lifetime", lifetime(F.col("kind")))


def current(calls: DataFrame, now: Column) -> DataFrame:
    """Those still within their lifetime, and no more than ten minutes ahead of the clock."""
    age = now - F.col("heard")
    return calls.where((age >= -600) & (age < F.col("lifetime")))


def is_threat(kind_of_call: Column) -> Column:
    name = F.lower(kind_of_call)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    return has(THREATS) & ~has(NO_THREATS)


def near_threats(calls: DataFrame, lat: float, lon: float, delay: str | None = None) -> DataFrame:
    """Each threat within a mile of a place once, though every poll of a feed repeats it: a stream forgets an id when the
    watermark, ``delay`` behind the latest call, has passed it."""
    found = calls.where(is_threat(F.col("type")) & (meters(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= NEAR))
    if found.isStreaming:
        timed = found.withColumn("at", F.timestamp_seconds("heard")).withWatermark("at", delay)
        return timed.dropDuplicatesWithinWatermark(["id"]).drop("at")
    return found.dropDuplicates(["id"])


def covering(points: DataFrame, key: str, feeds: tuple[Feed, ...] = FEEDS) -> DataFrame:
    """(key, feed, meters, rank) of the feeds whose city a point (key, lat, lon) lies in or near, nearest first. The feeds are a
    fixed list, so they are columns, not a join."""
    rows = points.select(key, "lat", "lon", F.explode(F.array(*(F.struct(F.lit(f.id).alias("feed"), F.lit(f.lat).alias("y"), F.lit(f.lon).alias("x"), F.lit(float(f.radius)).alias("r")) for f in feeds))).alias("f"))
    rows = rows.withColumn("meters", meters(F.col("lat"), F.col("lon"), F.col("f.y"), F.col("f.x"))).where(F.col("meters") <= F.col("f.r") + BEYOND)
    order = F.array_sort(F.collect_list(F.struct("meters", "f.feed")))
    return rows.groupBy(key).agg(order.alias("o")).select(key, F.posexplode("o").alias("p", "f")).select(key, "f.feed", "f.meters", (F.col("p") + 1).alias("rank"))
