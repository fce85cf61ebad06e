"""Trip, transit and merge queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazgrid.functions import events
from hazgrid.operators import merge, transit, trips
from hazgrid.plans.paths import NOW
from hazgrid.plans.points import place, table


def _age_days(column="ts"):
    return F.datediff(F.lit(NOW).cast("date"), F.col(column).cast("date")).cast("double")


def eta_multipliers(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("value") * 10).alias("actual"), F.lit(500.0).alias("predicted"))
    s = trips.eta_states(e, "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts"), F.col("predicted"), F.col("actual"))
    state = F.struct("log_ratio", "samples")
    return s.select("user_id", "samples", F.round("log_ratio", 6).alias("log_ratio"), F.round(trips.eta_multiplier(state), 6).alias("multiplier"))


def wait_means(spark, sf):
    s = trips.wait_means(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts"), "value", 12.0)
    return s.select("user_id", F.round("wait", 6).alias("wait"))


def efficiency_ladder(spark, sf):
    out = trips.economy(table(spark, sf, "events"), ["user_id", "event_type"], ["event_type"], F.col("value") / 20, F.col("event_id") % 7 / 50 + 0.05, 28.0, _age_days())
    return out.select("user_id", "event_type", F.round("economy", 6).alias("economy"))


def learned_homes(spark, sf):
    e = table(spark, sf, "events").withColumn("cell", F.floor(F.col("value") / 25).cast("long"))
    return trips.home(e, "user_id", "cell", _age_days())


def event_history_families(spark, sf):
    names = ("Thunderstorm Wind", "Hail", "Flash Flood", "Winter Storm", "Hurricane", "Excessive Heat", "Cold/Wind Chill", "High Wind", "Wildfire", "Drought", "Rip Current")
    e = table(spark, sf, "events").withColumn("name", F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int")))
    e = e.select("event_id", F.explode(events.event_families(F.col("name"))).alias("family"), events.event_weight(F.col("name"), F.col("value")).alias("weight"))
    return e.groupBy("family").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def recent_places(spark, sf):
    return merge.recents(table(spark, sf, "events"), "user_id", "event_type", _age_days(), 3)


def unshown_badges(spark, sf):
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("kind"), "lat", "lon")
    s = place(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select((F.col("s_suppkey") % 3).alias("kind"), "lat", "lon")
    return merge.unshown(c, s, 150_000.0, 1.5).select("id")


def _stop_events(lines):
    li = lines.groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence")).agg((F.min("l_partkey") % 4).alias("stop_id"))
    return li.withColumns({"arrive": (F.col("stop_sequence") * 300).cast("int"), "depart": (F.col("stop_sequence") * 300 + 30).cast("int")})


def trip_patterns(spark, sf):
    p = transit.patterns(_stop_events(table(spark, sf, "lineitem")))
    return p.groupBy("pattern", "n_stops").agg(F.count("*").alias("n_trips"), F.min("trip_id").alias("first_trip"))


def frequency_trips(spark, sf):
    """Every order is a trip; those of even key run by headway, the others once."""
    orders = table(spark, sf, "orders").withColumn("by_headway", F.col("o_orderkey") % 2 == 0).where("by_headway")
    f = orders.select(F.col("o_orderkey").alias("trip_id"), F.lit(21600).alias("start"), F.lit(25200).alias("end"), (F.col("o_orderkey") % 3 * 600 + 600).cast("int").alias("headway"))
    out = transit.expand_frequencies(_stop_events(table(spark, sf, "lineitem")), f)
    return out.groupBy("stop_sequence").agg(F.count("*").alias("n"), F.min("arrive").alias("first"), F.max("arrive").alias("last"))


def route_fares(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("route_id"), F.col("n_regionkey").cast("string").alias("agency_id"))
    p = table(spark, sf, "part")
    name = F.get(F.array(*map(F.lit, ("adult", "senior", "single", "day"))), (F.col("p_partkey") % 4).cast("int"))
    fares = p.select(F.concat(name, F.col("p_partkey").cast("string")).alias("fare_id"), (F.col("p_partkey") % 17 + 1.5).alias("price"), F.when(F.col("p_partkey") % 29 == 0, "CAD").otherwise("USD").alias("currency"), (F.col("p_partkey") % 5).cast("string").alias("agency_id"))
    rules = p.where("p_partkey % 3 = 0").select(F.concat(name, F.col("p_partkey").cast("string")).alias("fare_id"), (F.col("p_partkey") % 20).cast("string").alias("route_id"))
    return transit.route_fares(n, rules, fares)


_AGE = f"date_diff('day', CAST(ts AS DATE), DATE '{NOW}')"
SQL = {
    "efficiency_ladder": f"""WITH d AS (SELECT user_id, event_type, power(2.0, -greatest({_AGE}, 0) / 180.0) AS w, value / 20 AS m, event_id % 7 / 50 + 0.05 AS u FROM events),
l AS (SELECT user_id, event_type, sum(w * m) AS m, sum(w * u) AS u FROM d GROUP BY ALL), p AS (SELECT event_type, sum(w * m) AS pm, sum(w * u) AS pu FROM d GROUP BY ALL)
SELECT user_id, event_type, round(CASE WHEN m >= 25 THEN least(1.6, greatest(0.5, m / u / 28)) * 28 WHEN pm >= 25 THEN least(1.6, greatest(0.5, pm / pu / 28)) * 28 ELSE 28.0 END, 6) AS economy FROM l JOIN p USING (event_type)""",
    "learned_homes": f"""WITH c AS (SELECT user_id, CAST(floor(value / 25) AS BIGINT) AS cell, round(sum(power(2.0, -greatest({_AGE}, 0) / 30.0)), 9) AS w, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, arg_min(cell, (-w, cell)) AS cell, CAST(sum(n) AS BIGINT) AS trips FROM c GROUP BY user_id HAVING sum(n) >= 15""",
    "event_history_families": """WITH e AS (SELECT event_id % 11 AS k, value AS v FROM events), f AS (SELECT CASE k WHEN 0 THEN ['convective'] WHEN 1 THEN ['convective'] WHEN 2 THEN ['qpf_flood'] WHEN 3 THEN ['winter'] WHEN 4 THEN ['wind', 'qpf_flood']
 WHEN 5 THEN ['heat'] WHEN 6 THEN ['cold'] WHEN 7 THEN ['wind'] WHEN 8 THEN ['fire'] WHEN 9 THEN ['air'] ELSE [] END AS fs, CASE WHEN k = 1 AND v >= 2 THEN 1.5 WHEN k IN (0, 6, 7) AND v >= 65 THEN 1.5 ELSE 1.0 END AS w FROM e),
u AS (SELECT unnest(fs) AS family, w FROM f) SELECT family, sum(w)::DOUBLE AS weight, count(*) AS n FROM u GROUP BY family""",
    "recent_places": f"""WITH s AS (SELECT user_id, event_type, round(sum(power(2.0, -greatest({_AGE}, 0) / 21.0)), 6) AS score FROM events GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""",
    "trip_patterns": """WITH s AS (SELECT l_orderkey AS trip_id, l_linenumber AS q, min(l_partkey) % 4 AS stop FROM lineitem GROUP BY ALL),
t AS (SELECT trip_id, sha256(string_agg(stop::VARCHAR, chr(31) ORDER BY q, stop)) AS pattern, CAST(count(*) AS INTEGER) AS n_stops FROM s GROUP BY trip_id)
SELECT pattern, n_stops, count(*) AS n_trips, min(trip_id) AS first_trip FROM t GROUP BY ALL""",
    "frequency_trips": """WITH s AS (SELECT l_orderkey AS trip, l_linenumber AS q FROM lineitem GROUP BY ALL), f AS (SELECT o_orderkey AS trip, o_orderkey % 3 * 600 + 600 AS h FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT trip, min(q) * 300 + 30 AS dep FROM s GROUP BY trip), r AS (SELECT trip, unnest(range(21600, 25200, h)) AS start FROM f),
u AS (SELECT q, q * 300 + start - dep AS arrive FROM s JOIN r USING (trip) JOIN m USING (trip) UNION ALL SELECT q, q * 300 FROM s ANTI JOIN f USING (trip))
SELECT q AS stop_sequence, count(*) AS n, CAST(min(arrive) AS INTEGER) AS first, CAST(max(arrive) AS INTEGER) AS last FROM u GROUP BY q""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "eta_multipliers", "wait_means", "unshown_badges", "route_fares"]}
