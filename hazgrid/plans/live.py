"""Queries on streams: drives by keyed state and timers, and cities' feeds of calls, with SQL that states its constants itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazgrid.sources import dispatch
from hazgrid.streaming import drives
from hazgrid.plans.points import table

CALLS = ("SHOTS FIRED", "False Alarm", "Injury collision", "Armed robbery", "Noise", "", "Person with a gun", "MEDICAL AID")
FIRES = ("Aid Response", "Fire in Building", "MVI - Motor Vehicle", "Auto Fire Alarm", "Rescue", "Explosion - HazMat", "Medic", "Fireworks")
#: Noon in San Francisco on a summer's day, in seconds since 1970.
NOON = 1_718_478_000


def stream_drives(spark, sf):
    """Events as fixes of a traveller; purchases fill up, every fifth fix tows. A drive ends half a day after its last fix."""
    schema = table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    fixes = e.select("user_id", "ts", F.col("event_id").alias("fix"), F.col("event_type").alias("kind"), (F.col("value") / 10).alias("speed"), (F.col("value") * 10).alias("metres"), (F.col("event_id") % 5 == 0).alias("towing"), (F.col("event_type") == "purchase").alias("filled"))
    d = drives.settled_stream(spark, drives.drives(fixes, 43_200.0, "1 day"))
    return d.select("user_id", *(F.round(c, 6).alias(c) for c in ("start", "end", "miles", "since_fill", "mph", "idle")), "fixes", "kinds")


def _calls(events):
    """Events as rows of two cities' feeds, by day, around noon."""
    k = F.col("event_id")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.lpad((k % 8 + 10).cast("string"), 2, "0"), F.lit(":"), F.lpad((k * 7 % 60).cast("string"), 2, "0"), F.lit(":00.000"))
    of = lambda names: F.get(F.array(*map(F.lit, names)), (k % 8).cast("int"))
    lat, lon = k * 13 % 100 / 2000.0, k * 29 % 100 / 2000.0
    named = lambda **columns: F.to_json(F.named_struct(*(x for name, c in columns.items() for x in (F.lit(name), c))))
    sf = named(
        cad_number=F.when(k % 11 != 0, k.cast("string")), call_type_final_desc=of(CALLS), call_type_original_desc=F.lit("Suspicious person"), received_datetime=at,
        intersection_point=F.named_struct(F.lit("coordinates"), F.array(-122.42 + lon, 37.77 + lat)), priority_final=F.get(F.array(*map(F.lit, "ABC")), (k % 3).cast("int")),
    )
    sea = named(incident_number=k.cast("string"), type=of(FIRES), datetime=at, latitude=F.when(k % 7 != 0, (47.6 + lat).cast("string")), longitude=(-122.33 + lon).cast("string"))
    polls = F.explode(F.array_repeat(F.lit(1), F.when(k % 3 == 0, 2).otherwise(1)))  # a third of the rows come twice
    return events.select(F.when(k % 2 == 0, "sf-police").otherwise("seattle-fire").alias("feed"), F.when(k % 2 == 0, sf).otherwise(sea).alias("row"), polls.alias("_")).drop("_")


def stream_threats(spark, sf):
    """Threats within a mile of a place in San Francisco, each once."""
    schema = table(spark, sf, "events").schema
    calls = dispatch.incidents(_calls(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")))
    return drives.settled_stream(spark, dispatch.near_threats(calls, 37.7749, -122.4194, "2 hours").select("id", "kind", "heard"))


def read_calls(spark, sf):
    c = dispatch.incidents(_calls(table(spark, sf, "events")))
    return c.select("feed", "id", "kind", "type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "heard", "lifetime")


def current_calls(spark, sf):
    """Calls that a map shows at noon, all days laid upon one."""
    c = dispatch.incidents(_calls(table(spark, sf, "events").withColumn("ts", F.lit("2024-06-15").cast("timestamp"))))
    return dispatch.current(c, F.lit(NOON)).groupBy("feed", "kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("calls"))


def covering_feeds(spark, sf):
    k = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select("s_suppkey", (37 + k % 120 / 10).alias("lat"), (-122.5 + k % 7 / 10).alias("lon"))
    return dispatch.covering(p, "s_suppkey").select("s_suppkey", "feed", F.round("meters", 3).alias("meters"), "rank")


def _list(names):
    return "[" + ", ".join("'" + n + "'" for n in names) + "]"


_CALLS = f"""e AS (SELECT event_id AS k, ts, unnest(range(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END)) AS poll FROM events),
r AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'sf-police' ELSE 'seattle-fire' END AS feed, CASE WHEN k % 2 = 1 THEN {_list(FIRES)}[k % 8 + 1] WHEN k % 8 = 5 THEN 'Suspicious person' ELSE {_list(CALLS)}[k % 8 + 1] END AS type,
 CASE WHEN k % 2 = 0 THEN 37.77 + k * 13 % 100 / 2000.0 WHEN k % 7 <> 0 THEN 47.6 + k * 13 % 100 / 2000.0 END AS lat, CASE WHEN k % 2 = 0 THEN -122.42 ELSE -122.33 END + k * 29 % 100 / 2000.0 AS lon,
 date_trunc('day', {{day}}) + to_hours((k % 8 + 10)::INT) + to_minutes((k * 7 % 60)::INT) AS at_ FROM e WHERE k % 2 = 1 OR k % 3 < 2),
i AS (SELECT *, lower(type) AS n, epoch(at_ AT TIME ZONE 'America/Los_Angeles')::BIGINT AS heard, feed || '|' || CASE WHEN k % 2 = 1 OR k % 11 <> 0 THEN k::VARCHAR ELSE strftime(at_, '%Y-%m-%dT%H:%M:%S.000') || '|' || type END AS id FROM r WHERE lat IS NOT NULL),
c AS (SELECT *, CASE WHEN k % 2 = 0 THEN CASE WHEN contains(n, 'medical') OR contains(n, 'injur') THEN 'medical' WHEN contains(n, 'collision') THEN 'traffic' ELSE 'police' END
 WHEN contains(n, 'aid') OR contains(n, 'medic') THEN 'medical' WHEN contains(n, 'mvi') OR contains(n, 'motor vehicle') THEN 'traffic' WHEN contains(n, 'rescue') THEN 'rescue' WHEN contains(n, 'hazmat') THEN 'hazard' ELSE 'fire' END AS kind FROM i)"""

SQL = {
    "stream_drives": """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, event_type AS kind, value, event_id % 5 = 0 AS towing, event_type = 'purchase' AS filled, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
g AS (SELECT *, p IS NULL OR t - p >= 43200 AS fresh, value * 10 / 1609.344 / CASE WHEN towing THEN 0.7 ELSE 1 END AS d, value / 10 * 2.236936 AS v FROM e),
f AS (SELECT user_id, r, CASE WHEN filled THEN d ELSE 0 + d END AS since, CASE WHEN v > 1 THEN 45.0 * (1 - 0.0003) + v * 0.0003 ELSE 45.0 END::DOUBLE AS mph, 0.1 * (1 - 0.0003) + CASE WHEN v <= 1 THEN 0.0003 ELSE 0 END::DOUBLE AS idle FROM g WHERE r = 1
 UNION ALL SELECT g.user_id, g.r, CASE WHEN filled THEN 0 ELSE since END + d, CASE WHEN v > 1 THEN mph * (1 - 0.0003) + v * 0.0003 ELSE mph END, idle * (1 - 0.0003) + CASE WHEN v <= 1 THEN 0.0003 ELSE 0 END FROM f JOIN g ON g.user_id = f.user_id AND g.r = f.r + 1),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY r) AS s FROM g JOIN f USING (user_id, r)),
k AS (SELECT user_id, s, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds FROM (SELECT user_id, s, kind, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id, s),
z AS (SELECT user_id, s, min(t) AS start, max(t) AS fin, sum(d) AS miles, arg_max(since, r) AS since_fill, arg_max(mph, r) AS mph, arg_max(idle, r) AS idle, count(*) AS fixes, max(s) OVER (PARTITION BY user_id) AS last FROM s GROUP BY user_id, s)
SELECT user_id, round(start, 6) AS start, round(fin, 6) AS "end", round(miles, 6) AS miles, round(since_fill, 6) AS since_fill, round(mph, 6) AS mph, round(idle, 6) AS idle, fixes, kinds FROM z JOIN k USING (user_id, s)
WHERE s < last OR fin + 43200 < (SELECT epoch(max(ts)) - 86400 FROM events)""",
    "stream_threats": f"""WITH {_CALLS.format(day='ts')} SELECT DISTINCT id, kind, heard FROM c WHERE sqrt(power((lat - 37.7749) * 111320.0, 2) + power((lon + 122.4194) * 111320.0 * cos(radians((lat + 37.7749) / 2)), 2)) <= 1600
 AND type IN ('SHOTS FIRED', 'Armed robbery', 'Person with a gun')""",
    "read_calls": f"WITH {_CALLS.format(day='ts')} SELECT feed, id, kind, type, round(lat, 6) AS lat, round(lon, 6) AS lon, heard, CASE WHEN kind IN ('fire', 'hazard') THEN 5400 ELSE 3600 END AS lifetime FROM c",
    "current_calls": f"""WITH {_CALLS.format(day="TIMESTAMP '2024-06-15'")} SELECT feed, kind, count(*) AS n, count(DISTINCT id) AS calls FROM c
WHERE 1718478000 - heard >= -600 AND 1718478000 - heard < CASE WHEN kind IN ('fire', 'hazard') THEN 5400 ELSE 3600 END GROUP BY ALL""",
    "covering_feeds": """WITH p AS (SELECT s_suppkey, 37 + s_suppkey % 120 / 10 AS lat, -122.5 + s_suppkey % 7 / 10 AS lon FROM supplier), f AS (SELECT * FROM (VALUES ('sf-police', 37.7749, -122.4194, 16000), ('seattle-fire', 47.6062, -122.3321, 18000)) t(feed, y, x, r)),
d AS (SELECT s_suppkey, feed, r, sqrt(power((y - lat) * 111320.0, 2) + power((x - lon) * 111320.0 * cos(radians((lat + y) / 2)), 2)) AS m FROM p, f)
SELECT s_suppkey, feed, round(m, 3) AS meters, row_number() OVER (PARTITION BY s_suppkey ORDER BY m, feed)::INTEGER AS rank FROM d WHERE m <= r + 25000""",
}
QUERIES = {name: globals()[name] for name in SQL}
