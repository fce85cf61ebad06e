"""Text, time, streaming-twin and relational queries, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazgrid.functions import clock, families, text
from hazgrid.operators.shared import shared_dir
from hazgrid.plans.points import FAMILY_OF, family_of, table
from hazgrid.sources import places
from hazgrid.streaming import live

# Alert names for the classifier's test.
EVENTS = (
    "Tornado Warning", "Severe Thunderstorm Warning", "Fire Warning", "Fire Weather Watch", "Flash Flood Warning", "Tsunami Warning", "Hurricane Warning",
    "Ashfall Advisory", "Volcano Warning", "Winter Storm Watch", "Heat Advisory", "Wind Chill Warning", "Red Flag Warning", "High Wind Watch",
    "Air Quality Alert", "Flood Watch", "Tornado Watch", "Gale Warning", "Earthquake Warning", "Avalanche Watch", "Test Message",
)
FAMILIES = (
    "storm", "storm", "fire", "heat", "qpf_flood", "tsunami", "tropical", "air", "volcanic", "winter", "heat", "cold", "heat", "wind", "air", "precip", "convective", "wind", "seismic", "avalanche", None,
)


def alert_classifier(spark, sf):
    names = F.array(*map(F.lit, EVENTS))
    s = table(spark, sf, "supplier").select("s_suppkey", F.get(names, F.col("s_suppkey") % len(EVENTS)).alias("event"))
    return s.select("s_suppkey", "event", families.alert_family(F.col("event")).alias("family"))


def maxspeed_parse(spark, sf):
    unit = F.get(F.array(F.lit(" mph"), F.lit(""), F.lit(" km/h"), F.lit(" knots"), F.lit(" walk")), F.col("p_partkey") % 5)
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("tag"))
    return p.select("p_partkey", "tag", F.round(text.maxspeed_mph(F.col("tag")), 6).alias("mph"))


def clearance_parse(spark, sf):
    size = F.col("p_size").cast("string")
    tag = F.when(F.col("p_partkey") % 4 == 0, F.concat(size, F.lit("'6\""))).when(F.col("p_partkey") % 4 == 1, F.concat(size, F.lit(" ft"))).when(F.col("p_partkey") % 4 == 2, F.concat(size, F.lit(".5 m"))).otherwise(F.lit("default"))
    p = table(spark, sf, "part").select("p_partkey", tag.alias("tag"))
    return p.select("p_partkey", "tag", F.round(text.clearance_meters(F.col("tag")), 6).alias("meters"))


def county_names(spark, sf):
    ending = F.get(F.array(*(F.lit(x) for x in (" County", " Parish", " City and Borough", " City", ""))), F.col("n_nationkey") % 5)
    return table(spark, sf, "nation").select("n_nationkey", text.county_key(F.concat(F.lit(" "), "n_name", ending)).alias("county"))


def service_times(spark, sf):
    o = table(spark, sf, "orders").withColumn("seconds", (F.col("o_orderkey") * 97 % 180_000).cast("int"))
    o = o.withColumn("text", clock.service_time(F.col("seconds")))
    return o.select("o_orderkey", "text", clock.service_seconds(F.col("text")).alias("seconds"))


def week_and_weekday(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", clock.week_of_year(F.col("o_orderdate")).alias("week"), clock.weekday(F.col("o_orderdate")).cast("int").alias("weekday"))


def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"), F.max(k).alias("most"))


def array_ops(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size(F.filter("v", lambda x: x > 0)).alias("n_positive"), F.array_position("v", F.array_max("v")).alias("argmax"))


def map_ops(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))  # five event types at most
    return m.select("user_id", F.size("m").cast("long").alias("kinds"), F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0)).alias("purchases"))


def polyline_decode(spark, sf):
    """Lines of the test key: the published example of the format and shorter ones."""
    lines = F.array(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"), F.lit("??"), F.lit("_ibE_seK"))
    n = table(spark, sf, "nation").select("n_nationkey", text.decode_polyline(F.get(lines, F.col("n_nationkey") % 3)).alias("p"))
    return n.select("n_nationkey", F.posexplode("p").alias("pos", "point")).select("n_nationkey", "pos", "point.lat", "point.lon")


def fsq_like_categories(spark, sf):
    t = F.lower("text")
    kind = F.when(t.contains("the "), "english").when(t.contains("und "), "german").when(t.contains("que "), "roman").otherwise("other")
    return table(spark, sf, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_LABELS = (
    ("Travel > Gas Station",), ("Retail > Drugstore", "Health > Pharmacy"), ("Pets > Veterinarian > Animal Hospital",), ("Travel > Lodging > Hotel",), ("Dining and Drinking > Hotel Bar",), ("Travel > Airport",), ("Travel > Airport > Gate",),
    ("Dining and Drinking > Pizza", "Retail"), ("Landmarks and Outdoors > States and Municipalities",), ("Landmarks and Outdoors > Park",), ("Travel > Truck Stop", "Travel > Fuel Station"), (), None, ("Travel > Bus Station",),
)
_REGIONS = ("WI", " wisconsin ", "Ontario", "Washington D.C.", "tx", "", None, "New York")


def selected_places(spark, sf):
    """Customers as places: open ones of a country, by kind and state."""
    k = F.col("c_custkey")
    labels = F.array(*(F.lit(None).cast("array<string>") if x is None else F.array(*map(F.lit, x)).cast("array<string>") for x in _LABELS))
    c = table(spark, sf, "customer").select(
        k, F.when(k % 9 == 0, "CA").otherwise("US").alias("country"), F.when(k % 10 == 0, "2020-01-01").alias("date_closed"), (k % 190 - 95.0).alias("latitude"), (k % 360 - 180.0).alias("longitude"),
        F.when(k % 31 == 0, "  ").otherwise(F.concat(F.lit(" a\t\n"), "c_name")).alias("name"), F.get(labels, (k % len(_LABELS)).cast("int")).alias("fsq_category_labels"), F.get(F.array(*map(F.lit, _REGIONS)), (k % 8).cast("int")).alias("region"),
        *(F.lit(None).cast("string").alias(x) for x in ("address", "locality", "postcode", "website", "tel")),
    )
    return places.select(c).select("grp", "latitude", "longitude", "name", "st", "category_label")


def family_pairs(spark, sf):
    """Families of a user in order of their first event, and their numbers in the fixed list of families, joined by name."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    w = Window.partitionBy("user_id").orderBy("first")
    left = e.select("user_id", F.when(F.col("event_type") != "signup", family_of()).otherwise("other").alias("family"), (F.row_number().over(w) - 1).alias("i"))
    right = spark.range(1).select(F.posexplode(F.array(*map(F.lit, sorted(FAMILY_OF.values())))).alias("h", "family"))
    return left.join(right, "family").select("user_id", "i", "h")


def event_sessions(spark, sf):
    s = live.sessions(table(spark, sf, "events"))
    return s.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n", F.round("value", 2).alias("value"))


def stream_sessions(spark, sf):
    """Sessions that a stream of the events has closed once its watermark, a day behind the latest event, has passed them: the
    stream reads what is there, writes what is closed to a table in the shared folder, and ends."""
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    query = live.sessions(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    s = spark.read.schema("user_id long, start timestamp, end timestamp, n long, value double").parquet(f"{folder}/out")
    return s.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n", F.round("value", 2).alias("value"))


def tumbling_day(spark, sf):
    w = live.windows(table(spark, sf, "events"), "1 day")
    return w.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("value", 2).alias("value"))


def sliding_window(spark, sf):
    w = live.windows(table(spark, sf, "events"), "12 hours", "6 hours")
    return w.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("value", 2).alias("value"))


def alert_lengths(spark, sf):
    """Length of each (user, day, type) as an event: first to last time, members, and quantiles by type."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg((F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).alias("length"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.percentile("length", 0.5).alias("median"), F.percentile("length", 0.9).alias("p90"))


def rollup_sales(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


def cube_sales(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


def grouping_sets_sales(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"))


def pivot_types(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


def approx_distinct_users(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


_CASE = " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(EVENTS)))
SQL = {
    "selected_places": f"""WITH c AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 10 <> 0 AND c_custkey % 31 <> 0 AND c_custkey % 190 BETWEEN 5 AND 185),
p AS (SELECT *, [0, 4, NULL, 3, 1, 6, NULL, 1, NULL, 5, 7, NULL, NULL, 6][k % 14 + 1] AS grp, ['WI', 'WI', NULL, 'DC', 'TX', NULL, NULL, 'NY'][k % 8 + 1] AS st FROM c)
SELECT grp, (k % 190 - 95)::DOUBLE AS latitude, (k % 360 - 180)::DOUBLE AS longitude, 'a ' || c_name AS name, st,
 ['Travel > Gas Station', 'Retail > Drugstore', '', 'Travel > Lodging > Hotel', 'Dining and Drinking > Hotel Bar', 'Travel > Airport', '', 'Dining and Drinking > Pizza', '', 'Landmarks and Outdoors > Park', 'Travel > Truck Stop', '', '', 'Travel > Bus Station'][k % 14 + 1] AS category_label
FROM p WHERE grp IS NOT NULL AND st IS NOT NULL""",
    "family_pairs": """WITH e AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL), l AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'closure' WHEN 'purchase' THEN 'storm' WHEN 'view' THEN 'wind' WHEN 'click' THEN 'heat' END AS family, row_number() OVER (PARTITION BY user_id ORDER BY f) - 1 AS i FROM e)
SELECT user_id, i::INTEGER AS i, list_position(['air', 'closure', 'heat', 'storm', 'wind'], family) - 1 AS h FROM l WHERE family IS NOT NULL""",
    "alert_classifier": "SELECT s_suppkey, CASE s_suppkey % {n} {e} END AS event, CASE s_suppkey % {n} {f} END AS family FROM supplier".format(
        n=len(EVENTS), e=" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(EVENTS)), f=" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FAMILIES) if x)
    ),
    "maxspeed_parse": """SELECT p_partkey, p_size || [' mph', '', ' km/h', ' knots', ' walk'][p_partkey % 5 + 1] AS tag,
round(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 0.621371 WHEN 2 THEN p_size * 0.621371 WHEN 3 THEN p_size * 1.150779 END::DOUBLE, 6) AS mph FROM part""",
    "clearance_parse": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '''6"' WHEN 1 THEN p_size || ' ft' WHEN 2 THEN p_size || '.5 m' ELSE 'default' END AS tag,
round(CASE p_partkey % 4 WHEN 0 THEN (p_size + 0.5) * 0.3048 WHEN 1 THEN p_size * 0.3048 WHEN 2 THEN p_size + 0.5 END::DOUBLE, 6) AS meters FROM part""",
    "county_names": "SELECT n_nationkey, upper(trim(n_name)) AS county FROM nation",
    "service_times": """WITH s AS (SELECT o_orderkey, CAST(o_orderkey * 97 % 180000 AS INTEGER) AS s FROM orders)
SELECT o_orderkey, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS text, CASE WHEN s // 3600 <= 168 THEN s END AS seconds FROM s""",
    "week_and_weekday": "SELECT o_orderkey, CAST(least((dayofyear(o_orderdate) - 1) // 7, 51) AS INTEGER) AS week, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders",
    "json_props": "SELECT event_type, CAST(sum(CAST(props->>'k' AS INTEGER)) AS BIGINT) AS total, count(props->>'k') AS n, max(CAST(props->>'k' AS INTEGER)) AS most FROM events GROUP BY event_type",
    "array_ops": """SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_positive,
CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS argmax FROM embeddings""",
    "map_ops": "SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY user_id",
    "polyline_decode": """WITH l(k, pos, lat, lon) AS (VALUES (0, 0, 38.5, -120.2), (0, 1, 40.7, -120.95), (0, 2, 43.252, -126.453), (1, 0, 0.0, 0.0), (2, 0, 1.0, 2.0))
SELECT n_nationkey, pos, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM nation JOIN l ON k = n_nationkey % 3""",
    "fsq_like_categories": """SELECT CASE WHEN contains(lower(text), 'the ') THEN 'english' WHEN contains(lower(text), 'und ') THEN 'german' WHEN contains(lower(text), 'que ') THEN 'roman' ELSE 'other' END AS kind,
count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL""",
    "event_sessions": """WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE AND ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS "end", count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, s""",
    "stream_sessions": """WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS "end", count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, s
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "tumbling_day": "SELECT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "sliding_window": """SELECT event_type, CAST(floor(epoch(ts) / 21600) * 21600 - 21600 * k AS BIGINT) AS start, count(*) AS n, round(sum(value), 2) AS value
FROM events, (VALUES (0), (1)) AS o(k) GROUP BY ALL""",
    "alert_lengths": """WITH l AS (SELECT event_type, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS length FROM events GROUP BY user_id, CAST(ts AS DATE), event_type)
SELECT event_type, count(*) AS n, quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.9) AS p90 FROM l GROUP BY event_type""",
    "rollup_sales": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_sales": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets_sales": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "pivot_types": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
}
del _CASE
QUERIES = {name: globals()[name] for name in [*SQL, "approx_distinct_users"]}
