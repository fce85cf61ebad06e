"""Queries of habits, places and names, each with SQL that states its constants itself."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hazgrid.functions import binary, geo, names
from hazgrid.functions.clock import decay, week_of_year
from hazgrid.functions.geo import haversine_km, meters
from hazgrid.operators import habits, learning, ranking, spatial
from hazgrid.plans.points import place, place_sql, table
from hazgrid.sources import ferries

NOW = "2024-12-31"


def _age():
    return F.datediff(F.lit(NOW).cast("date"), F.col("ts").cast("date")).cast("double")


def refuel_accuracies(spark, sf):
    """Errors in hundredths, whole ones, so that means don't depend on the order of the sum."""
    e = table(spark, sf, "events").withColumn("error", F.round(F.col("value") / 4))
    return habits.refuel_accuracy(e, "user_id", [F.desc("ts"), F.desc("event_id")], F.col("error"), 100).select("user_id", F.round("accuracy", 9).alias("accuracy"))


def training_rows(spark, sf):
    """Decayed cells of a user and week as rows for training: a place, the week, the mean and the weight."""
    e = table(spark, sf, "events").withColumn("week", week_of_year(F.col("ts")))
    cells = learning.decayed(e, ["user_id", "week"], _age(), 364.0, observed=F.col("value") / 100)
    p = place(cells, "user_id")
    return p.where("weight > 0").select("user_id", "week", (F.round(F.col("lat") * 10) / 10).alias("o_lat"), (F.round(F.col("lon") * 10) / 10).alias("o_lon"), F.round(F.col("observed") / F.col("weight"), 6).alias("mean"), F.round("weight", 6).alias("weight"))


def route_features(spark, sf):
    """Features of the route from a customer to its nation in a week."""
    c = place(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    n = place(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "d_lat", "d_lon")
    a = 2 * math.pi * (F.col("c_custkey") % 52 + 0.25) / 52
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon"))
    values = (F.sin(a), F.cos(a), F.col("lat") / 90, F.col("d_lat") / 90, F.col("lon") / 180, F.col("d_lon") / 180, F.least(km, F.lit(4000.0)) / 4000)
    return c.join(n, "c_nationkey").select("c_custkey", *(F.round(v, 6).alias(f"f{i}") for i, v in enumerate(values)))


def destination_ranks(spark, sf):
    e = table(spark, sf, "events")
    hits = e.groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 150).alias("context_hits"), F.count_if(F.col("value") > 100).alias("time_hits"), F.count("*").alias("total_hits"), F.min(_age()).alias("age"))
    scored = learning.destination_scores(hits, F.col("age")).withColumn("score", F.round("score", 9))
    return habits.destination_ranks(scored, "user_id", "event_type", 3).withColumn("score", F.round("score", 6))


def homes_with_incumbent(spark, sf):
    e = table(spark, sf, "events").withColumn("cell", F.floor(F.col("value") / 25).cast("long"))
    cells = e.groupBy("user_id", "cell").agg(F.round(F.sum(decay(_age(), 30.0)), 9).alias("weight"), F.count("*").alias("trips"), F.max(_age()).alias("days"))
    incumbent = e.select("user_id").distinct().select("user_id", (F.col("user_id") % 4).alias("current"))
    return habits.homes(cells, "user_id", "cell", incumbent)


def evicted_cells(spark, sf):
    e = table(spark, sf, "events").withColumn("cell", F.floor(F.col("value") / 5).cast("long"))
    cells = e.groupBy("user_id", "cell").agg(F.round(F.sum(decay(_age(), 30.0)), 9).alias("weight"))
    return habits.evicted(cells, "user_id", [F.asc("weight"), F.asc("cell")], 10).select("user_id", "cell")


def everyday_order(spark, sf):
    """Places of a user by uses, sightings, last use and name; rank from the front, and which one would go first."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    p = e.groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 50).alias("uses"), F.count("*").alias("seen"), F.max("ts").alias("last"))
    w = Window.partitionBy("user_id")
    front = F.row_number().over(w.orderBy(F.desc("uses"), F.desc("seen"), F.desc("last"), "event_type"))
    back = F.row_number().over(w.orderBy("uses", "seen", "last", "event_type"))
    return p.select("user_id", "event_type", front.alias("rank"), (back == 1).alias("goes"))


def _stations(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select((k % 40).alias("route"), k.alias("station"), (k * 37 % 300).cast("double").alias("miles"), F.when(k % 4 != 0, (k % 7) / 10 + 3).alias("price"))


def reachable_stations(spark, sf):
    return habits.reachable(_stations(spark, sf), "route", "station", 250.0 - F.col("route") * 4)


def recommended_rentals(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", F.format_string("%s Desk %d", F.get(F.array(*map(F.lit, ("Avis", "Hertz", "Budget", "Local"))), (F.col("c_custkey") % 4).cast("int")), F.col("c_custkey") % 3).alias("name"), (F.col("c_custkey") * 13 % 500).cast("double").alias("miles"))
    return habits.recommended_rentals(c, "c_nationkey", "name", ["hertz", "avis", "budget"], 4)


def _airports(spark, sf):
    k = F.col("s_suppkey")
    size = F.get(F.array(*map(F.lit, ("large", "medium", "small"))), (k % 3).cast("int"))
    return place(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "ref_lat", "ref_lon").select(k.alias("airport"), "ref_lat", "ref_lon", size.alias("size"))


def nearest_airports(spark, sf):
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return habits.nearest_airports(c, _airports(spark, sf), "c_custkey", "airport", 240_000.0, 4).select("c_custkey", "airport", F.round("weighted", 3).alias("weighted"), "rank")


def airport_pairs(spark, sf):
    """Flights of a customer to the place of its nation."""
    a = _airports(spark, sf)
    c = place(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    to = c.select("c_custkey", "c_nationkey").transform(lambda d: place(d, "c_nationkey"))
    at = a.select("airport", F.col("ref_lat").alias("lat"), F.col("ref_lon").alias("lon"))
    some = lambda p: habits.nearest_airports(p.select("c_custkey", "lat", "lon"), a, "c_custkey", "airport", 240_000.0, 4).select("c_custkey", "airport", "rank").join(at, "airport")
    return habits.airport_pairs(c, some(c), some(to), "c_custkey", 96_560.0)


def ferry_crossings(spark, sf):
    s = place(place(table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3 + 1).alias("k2")), "s_suppkey", "a_lat", "a_lon"), "k2", "b_lat", "b_lon")
    c = place(place(table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 3 + 1).alias("k2")), "c_custkey", "from_lat", "from_lon"), "k2", "to_lat", "to_lon")
    found = habits.crossings(c, s.withColumnRenamed("s_suppkey", "ferry").drop("k2"), "c_custkey", 300.0, 2)
    return found.select("c_custkey", "ferry", "backward", F.round(F.col("board_km") + F.col("alight_km"), 4).alias("km"), "rank")


def nearest_stops(spark, sf):
    """Stops within 200 km that a picked kind of vehicle serves, the three nearest."""
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    stops = place(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "ref_lat", "ref_lon").withColumn("modes", F.col("s_suppkey") % 8)
    picked = stops.where(F.col("modes").bitwiseAND(F.lit(5)) != 0)
    return spatial.nearest_few(c, picked, "c_custkey", "s_suppkey", 200_000.0, 1.0, 3).select("c_custkey", "s_suppkey", "rank")


def field_selection(spark, sf):
    """The ten places of a box with the greatest score, those of one score by key."""
    c = place(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return c.where(F.col("lat").between(28, 45) & F.col("lon").between(-115, -80) & (F.col("c_custkey") % 3 != 0)).orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


def throttled_events(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return habits.throttled(e, "user_id", "t", 86_400.0 * 5)


def breadcrumbs(spark, sf):
    """Events of a user as fixes a few hundred metres apart; those that the trail keeps."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", (43 + k * 7919 % 1000 / 100_000).alias("lat"), (-90 + k * 104729 % 1000 / 100_000).alias("lon"))
    return habits.spaced(e, "user_id", "event_id", "lat", "lon", 600.0)


def alert_areas(spark, sf):
    """Zones of alerts matched by bundle families: names of both sides that are one, as pairs of places in their lists."""
    left = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("family"))
    right = table(spark, sf, "part").groupBy(F.col("p_brand").alias("family")).agg(F.min("p_partkey").alias("h"))
    return left.join(right, "family").select("i", "h")


def folded_marks(spark, sf):
    k = F.col("c_custkey")
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(k.alias("mark"), "lat", "lon", (k % 10 / 10).alias("risk"), (k % 3).alias("code"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    w = place(o, "o_custkey", "ref_lat", "ref_lon").select(F.col("o_orderkey").alias("w"), "ref_lat", "ref_lon", (F.col("o_orderkey") % 10 / 10).alias("w_risk"), (F.col("o_orderkey") % 3).alias("w_code"))
    return habits.folded_marks(c, w)


def badge_labels(spark, sf):
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("badge"), (F.col("c_custkey") % 3).alias("kind"), "lat", "lon")
    s = place(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "ref_lat", "ref_lon").select(F.col("s_suppkey").alias("item"), (F.col("s_suppkey") % 3).alias("kind"), "ref_lat", "ref_lon", F.col("s_acctbal").alias("score"))
    return habits.labels(c, s, 150_000.0, 1.5)


def box_lattice(spark, sf):
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey").withColumns({"span_lat": 1 + F.col("n_nationkey") % 4 / 2, "span_lon": 2 + F.col("n_nationkey") % 3 / 1})
    p = habits.lattice(n, "n_nationkey", 6)
    return p.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lon"), 6).alias("east"))


def probe_points(spark, sf):
    c = place(place(table(spark, sf, "customer").select("c_custkey"), "c_custkey").withColumn("k2", F.col("c_custkey") + 1), "k2", "to_lat", "to_lon")
    c = c.withColumns({"to_lat": F.col("lat") + (F.col("to_lat") - F.col("lat")) / 20, "to_lon": F.col("lon") + (F.col("to_lon") - F.col("lon")) / 20})
    p = habits.probes(c, "c_custkey", meters(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")))
    return p.groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("place").alias("last"))


def closest_matches(spark, sf):
    """Suppliers of an order as routes, with rules that some break."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    k = F.col("l_suppkey")
    rules = [k % 2 == 0, k % 3 == 0, F.when(k % 7 != 0, k % 5 == 0), F.col("q") > 25]
    return ranking.closest_matches(li.withColumn("risk", k % 4 / 4), "l_orderkey", "l_suppkey", rules, "risk", "q")


def planned_routes(spark, sf):
    """Lines of orders of a customer as routes of three kinds."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") / 50).alias("seconds"))
    kind = F.when(F.col("o_orderkey") % 7 == 0, "toll free").when(F.col("o_orderkey") % 11 == 0, "avoid highways").otherwise("standard")
    o = o.withColumn("kind", kind)
    return ranking.planned(o, "o_custkey", "o_orderkey", "kind", F.floor(F.col("seconds") / 45), "seconds", {"standard": 0, "toll free": 1, "avoid highways": 2}, ["avoid highways", "toll free"])


def ring_centroids(spark, sf):
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", "y", "x")
    k = F.col("n_nationkey")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.when(k % 3 == 0, F.array(corner(0, 0), corner(3, 0), corner(0, 3))).when(k % 3 == 1, F.array(corner(0, 0), corner(4, 0), corner(4, 2), corner(0, 2))).otherwise(F.array(corner(0, 0), corner(1, 1), corner(2, 2)))
    return n.select("n_nationkey", geo.ring_centroid(ring).alias("c")).select("n_nationkey", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


def tire_readings(spark, sf):
    k = F.col("p_partkey")
    low_first = lambda v: F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)))
    data = F.unhex(F.concat(F.repeat(F.lit("00"), 8), low_first(k * 1000 % 1_600_000), low_first((k * 37 % 9000 - 3000).cast("long"))))
    t = binary.tire_reading(F.concat(F.when(k % 9 == 0, "other").otherwise("tpms"), (k % 4).cast("string")), F.when(k % 11 != 0, data))
    return table(spark, sf, "part").select("p_partkey", t.alias("t")).where("t is not null").select("p_partkey", "t.position", F.round("t.psi", 6).alias("psi"), F.round("t.celsius", 6).alias("celsius"))


_NAMES = ("Tornado Shelter", "Pet Rescue", "St. Mary's High Ground", "Cooling Center 12", "Park & Ride", "park and ride lot", "Main St Garage", "KNOW 98.1", "WTMJ 620", "The 5 o'clock bar", "Warming hut", "Free Parking $2", "stormy", "109.9 and 88 and 1000")
_REPLIES = ("Yes please", "no, not now", "take it", "I don't know", "Keep this route", "NOPE", "surely", "go ahead", "hmm", "never  mind")


def read_names(spark, sf):
    k = F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES)).cast("int"))
    reply = F.get(F.array(*map(F.lit, _REPLIES)), (k % len(_REPLIES)).cast("int"))
    lanes = names.turn_lanes(F.get(F.array(*map(F.lit, ("left|through;right|", "", "Sharp_Left;odd|none", "odd|through;slight_right|reverse"))), (k % 4).cast("int")))
    side = F.get(F.array(*map(F.lit, ("left", "right", "none"))), (k % 3).cast("int"))
    country = F.get(F.array(*map(F.lit, ("us", "canada", "mexico"))), (k % 3).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(names.words(name), "_").alias("words"), names.shelter_type(name, F.lit("flood help")).alias("shelter"), names.is_shelter_noise(name).alias("noise"), names.parking_fee(name).alias("fee"), names.dial_label(name).alias("dial"),
        names.yes_or_no(reply).alias("reply"), F.array_join(F.transform(lanes, lambda x: F.array_join(x, ";")), "|").alias("lanes"), F.array_join(names.recommended_lanes(lanes, side).cast("array<string>"), ",").alias("use"),
        names.cost_tier(k % 170 * 1.0, country).alias("tier"), names.estimated_nightly((k % 7).cast("int")).alias("nightly"), names.signs_tier(F.repeat(F.lit("$"), (k % 6).cast("int")), F.when(k % 2 == 0, 4.6)).alias("signs"),
        names.attribute_id(F.lit("x"), k / 7.0, -k / 9.0).alias("id"), names.hour_bucket(k % 7, k % 26 - 1).alias("bucket"), F.round(names.mean_fahrenheit(F.when(k % 3 != 0, k % 40 * 1.0), F.when(k % 5 != 0, k % 30 * 1.0)), 6).alias("warm"),
    )


_PROVIDERS = ("Southeastern Authority (SEPTA)", "Metro (WI)", "(WI)", "A, B, C", "City Bus (Local)", "X (AB&C), Y", "Plain", " Trimmed (CTA) ")


def operator_names(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", names.operator_name(F.get(F.array(*map(F.lit, _PROVIDERS)), (k % len(_PROVIDERS)).cast("int"))).alias("operator"))


def ranked_stations(spark, sf):
    """Stations of a nation by distance from its place; a third of them have none."""
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey")
    k = F.col("c_custkey")
    c = place(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey", "ref_lat", "ref_lon")
    c = c.withColumns({"ref_lat": F.when(k % 3 != 0, F.col("ref_lat")), "bitrate": k % 5 * 32})
    return ranking.ranked_stations(c.join(n, "n_nationkey"), "n_nationkey", "c_custkey", 50).select("n_nationkey", "c_custkey", F.round("meters", 3).alias("meters"), "rank")


def ferry_frequencies(spark, sf):
    """Crossings a day over seasons, some over the year's end, some without one."""
    k = F.col("p_partkey")
    text = F.when(k % 5 != 0, F.concat((k % 12 + 1).cast("string"), F.lit("/"), (k % 28 + 1).cast("string"), F.lit("/2024")))
    other = F.concat(F.lit("2024-"), F.lpad((k * 7 % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((k * 3 % 28 + 1).cast("string"), 2, "0"))
    p = table(spark, sf, "part").select("p_partkey", ferries.month_day(text).alias("start"), ferries.month_day(other).alias("end"))
    start, end = F.col("start"), F.col("end")
    return p.select("p_partkey", ferries.season_days(start, end).alias("days"), F.round(ferries.crossings_a_day(k % 7 * 300, start, end), 6).alias("per_day"))


def wind_fields(spark, sf):
    k = F.col("p_partkey")
    field = lambda key, v, u: F.struct(F.lit(key).alias("key"), v.alias("speed"), u.alias("unit"))
    unit = F.when(k % 2 == 0, "m/s").otherwise("km/h")
    some = F.array(field("avg_wnd_spd_pst2mts", k % 7 - 1.0, unit), field("avg_wnd_spd_10m_pst1hr", k % 9 - 3.0, unit), field("wnd_spd-qa", k * 1.0, unit), field("max_wnd_spd_10m", F.when(k % 4 != 0, k % 30 * 1.0), F.lit(None).cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.round(names.wind_mph(some), 6).alias("mph"))


_AGE_SQL = f"date_diff('day', CAST(ts AS DATE), DATE '{NOW}')"
_LIST = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in _NAMES) + "]"
SQL = {
    "operator_names": "SELECT p_partkey, ['SEPTA', 'Metro', '(WI)', 'A and others', 'City Bus (Local)', 'AB&C and others', 'Plain', 'CTA'][p_partkey % 8 + 1] AS operator FROM part",
    "ranked_stations": f"""WITH n AS (SELECT n_nationkey, {place_sql('n_nationkey')} FROM nation), c AS (SELECT c_custkey, c_nationkey, c_custkey % 5 * 32 AS b, {place_sql('c_custkey', 'rlat', 'rlon')} FROM customer),
d AS (SELECT n_nationkey, c_custkey, b, CASE WHEN c_custkey % 3 <> 0 THEN sqrt(power((rlat - lat) * 111320.0, 2) + power((rlon - lon) * 111320.0 * cos(radians((lat + rlat) / 2)), 2)) END AS m FROM c JOIN n ON n_nationkey = c_nationkey)
SELECT n_nationkey, c_custkey, round(m, 3) AS meters, row_number() OVER (PARTITION BY n_nationkey ORDER BY m NULLS LAST, b DESC, c_custkey)::INTEGER AS rank FROM d QUALIFY rank <= 50""",
    "ferry_frequencies": """WITH p AS (SELECT p_partkey AS k, [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][k % 12 + 1] + k % 28 + 1 AS a, [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][k * 7 % 12 + 1] + k * 3 % 28 + 1 AS b FROM part),
d AS (SELECT k, CASE WHEN k % 5 = 0 THEN 365 WHEN a <= b THEN b - a + 1 ELSE b - a + 366 END AS days FROM p) SELECT k AS p_partkey, days::INTEGER AS days, round(k % 7 * 300 / days, 6)::DOUBLE AS per_day FROM d""",
    "closest_matches": """WITH l AS (SELECT l_orderkey, l_suppkey AS k, max(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT *, (k % 2 = 0)::INT + (k % 3 = 0)::INT + (k % 7 <> 0 AND k % 5 = 0)::INT + (q > 25)::INT AS broken FROM l)
SELECT l_orderkey, k AS l_suppkey, broken FROM b QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY broken, k % 4, q, k) = 1""",
    "planned_routes": """WITH o AS (SELECT o_custkey, o_orderkey AS r, round(o_totalprice / 50) AS s, CASE WHEN o_orderkey % 7 = 0 THEN 'toll free' WHEN o_orderkey % 11 = 0 THEN 'avoid highways' ELSE 'standard' END AS kind FROM orders),
e AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, floor(s / 45) ORDER BY CASE kind WHEN 'standard' THEN 0 WHEN 'toll free' THEN 1 ELSE 2 END, s, r) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, r) AS n, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY s, r) AS m FROM e),
g AS (SELECT o_custkey, bool_or(kind = 'toll free') AND NOT bool_or(kind = 'toll free' AND n <= 5) AS t, bool_or(kind = 'avoid highways') AND NOT bool_or(kind = 'avoid highways' AND n <= 5) AS h FROM n GROUP BY o_custkey)
SELECT o_custkey, r AS o_orderkey, kind, s AS seconds FROM n JOIN g USING (o_custkey) WHERE n <= 5 - t::INT - h::INT OR (m = 1 AND ((t AND kind = 'toll free') OR (h AND kind = 'avoid highways')))""",
    "ring_centroids": f"""WITH n AS (SELECT n_nationkey, {place_sql('n_nationkey', 'y', 'x')} FROM nation) SELECT n_nationkey, round(x + CASE WHEN n_nationkey % 3 = 1 THEN 2 ELSE 1 END, 6) AS x, round(y + 1, 6) AS y FROM n""",
    "tire_readings": """SELECT p_partkey, (p_partkey % 4)::VARCHAR AS position, round(p_partkey * 1000 % 1600000 / 1000 * 0.145038, 6) AS psi, round((p_partkey * 37 % 9000 - 3000) / 100, 6) AS celsius FROM part
WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AND p_partkey * 1000 % 1600000 / 1000 * 0.145038 BETWEEN 3.0000001 AND 199.999999""",
    "breadcrumbs": """WITH RECURSIVE e AS (SELECT user_id, event_id, 43 + event_id * 7919 % 1000 / 100000 AS y, -90 + event_id * 104729 % 1000 / 100000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, event_id, y, x, r, true AS kept FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, CASE WHEN c THEN e.y ELSE f.y END, CASE WHEN c THEN e.x ELSE f.x END, e.r, c FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1,
 LATERAL (SELECT sqrt(power((e.y - f.y) * 111320.0, 2) + power((e.x - f.x) * 111320.0 * cos(radians((e.y + f.y) / 2)), 2)) >= 600 AS c)) SELECT user_id, event_id FROM f WHERE kept""",
    "alert_areas": "SELECT p_partkey AS i, min(p_partkey) OVER (PARTITION BY p_brand) AS h FROM part",
    "refuel_accuracies": "WITH l AS (SELECT user_id, round(value / 4) AS e FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10) SELECT user_id, round(greatest(0.0, 1 - avg(e) / 100), 9) AS accuracy FROM l GROUP BY user_id",
    "training_rows": f"""WITH c AS (SELECT user_id, CAST(least((dayofyear(ts) - 1) // 7, 51) AS INTEGER) AS week, sum(power(2.0, -greatest({_AGE_SQL}, 0) / 364.0)) AS w, sum(power(2.0, -greatest({_AGE_SQL}, 0) / 364.0) * value / 100) AS o FROM events GROUP BY ALL), p AS (SELECT *, {place_sql('user_id')} FROM c)
SELECT user_id, week, round(lat * 10) / 10 AS o_lat, round(lon * 10) / 10 AS o_lon, round(o / w, 6) AS mean, round(w, 6) AS weight FROM p""",
    "route_features": f"""WITH c AS (SELECT c_custkey AS k, c_nationkey, {place_sql('c_custkey')} FROM customer), n AS (SELECT n_nationkey, {place_sql('n_nationkey', 'y', 'x')} FROM nation), j AS (SELECT *, power(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * power(sin(radians(x - lon) / 2), 2) AS a FROM c JOIN n ON n_nationkey = c_nationkey)
SELECT k AS c_custkey, round(sin(2 * pi() * (k % 52 + 0.25) / 52), 6) AS f0, round(cos(2 * pi() * (k % 52 + 0.25) / 52), 6) AS f1, round(lat / 90, 6) AS f2, round(y / 90, 6) AS f3, round(lon / 180, 6) AS f4, round(x / 180, 6) AS f5, round(least(4000.0, 12742 * atan2(sqrt(a), sqrt(1 - a))) / 4000, 6) AS f6 FROM j""",
    "destination_ranks": f"""WITH h AS (SELECT user_id, event_type, count(*) FILTER (value > 150) AS c, count(*) FILTER (value > 100) AS t, count(*) AS n, min({_AGE_SQL}) AS age FROM events GROUP BY ALL), s AS (SELECT *, round((3 * c + 1.5 * t + n) * power(2.0, -greatest(age, 0) / 21.0), 9) AS s FROM h),
b AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS best FROM s) SELECT user_id, event_type, round(s / best, 6) AS score, CASE WHEN c >= 3 THEN 'usually now' WHEN c > 0 THEN 'came at this time' WHEN t >= 3 THEN 'regular at this hour' WHEN n >= 5 THEN 'regular place' ELSE 'recent' END AS reason,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS INTEGER) AS rank FROM b WHERE best > 0 QUALIFY rank <= 3""",
    "homes_with_incumbent": f"""WITH c AS (SELECT user_id, CAST(floor(value / 25) AS BIGINT) AS cell, round(sum(power(2.0, -greatest({_AGE_SQL}, 0) / 30.0)), 9) AS w, count(*) AS n, max({_AGE_SQL}) AS days FROM events GROUP BY ALL),
b AS (SELECT user_id, sum(n) AS trips, arg_min(cell, (-w, cell)) AS bc, max(w) AS bw, arg_min(days, (-w, cell)) AS bd FROM c GROUP BY user_id), i AS (SELECT user_id, cell, w FROM c WHERE cell = user_id % 4)
SELECT b.user_id, CASE WHEN i.cell IS NULL OR (bw >= i.w * 1.5 AND greatest(bd, 0) >= 30) THEN bc ELSE i.cell END AS cell FROM b LEFT JOIN i USING (user_id) WHERE trips >= 15""",
    "evicted_cells": f"""WITH c AS (SELECT user_id, CAST(floor(value / 5) AS BIGINT) AS cell, round(sum(power(2.0, -greatest({_AGE_SQL}, 0) / 30.0)), 9) AS w FROM events GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY w, cell) AS r FROM c)
SELECT user_id, cell FROM n WHERE m > 10 AND r <= m // 2""",
    "everyday_order": """WITH p AS (SELECT user_id, event_type, count(*) FILTER (value > 50) AS u, count(*) AS s, max(ts) AS l FROM events GROUP BY ALL)
SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY u DESC, s DESC, l DESC, event_type) AS INTEGER) AS rank, row_number() OVER (PARTITION BY user_id ORDER BY u, s, l, event_type) = 1 AS goes FROM p""",
    "reachable_stations": """WITH RECURSIVE s AS (SELECT s_suppkey % 40 AS route, s_suppkey AS k, (s_suppkey * 37 % 300)::DOUBLE AS m, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 / 10 + 3 END AS p FROM supplier), n AS (SELECT * FROM s WHERE m <= 250 - route * 4),
q AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY m, k) AS r FROM n WHERE p IS NOT NULL), f AS (SELECT route, k, m, p, r FROM q WHERE r = 1 UNION ALL SELECT q.route, CASE WHEN c THEN q.k ELSE f.k END, CASE WHEN c THEN q.m ELSE f.m END, CASE WHEN c THEN q.p ELSE f.p END, q.r
 FROM f JOIN q ON q.route = f.route AND q.r = f.r + 1, LATERAL (SELECT CASE WHEN abs(q.p - f.p) > 0.001 THEN q.p < f.p ELSE q.m < f.m END AS c)), e AS (SELECT route, arg_max(k, r) AS k FROM f GROUP BY route), g AS (SELECT route, count(*) AS n, arg_min(k, (m, k)) AS near FROM n GROUP BY route)
SELECT g.route, CAST(n AS INTEGER) AS n, CASE WHEN n <= 3 THEN 'last chances' ELSE 'none' END AS level, coalesce(e.k, near) AS cheapest FROM g LEFT JOIN e USING (route)""",
    "recommended_rentals": """WITH r AS (SELECT c_nationkey, c_custkey % 4 AS b, lower(['Avis', 'Hertz', 'Budget', 'Local'][c_custkey % 4 + 1] || ' Desk ' || c_custkey % 3) AS name, (c_custkey * 13 % 500)::DOUBLE AS miles FROM customer),
g AS (SELECT c_nationkey, CASE b WHEN 0 THEN 'avis' WHEN 1 THEN 'hertz' WHEN 2 THEN 'budget' ELSE name END AS brand, CASE b WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 3 END AS o, min(miles) AS miles FROM r GROUP BY ALL)
SELECT c_nationkey, brand, miles, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o, miles, brand) AS INTEGER) AS rank FROM g QUALIFY rank <= 4""",
    "nearest_stops": f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, {place_sql('s_suppkey', 'rlat', 'rlon')} FROM supplier WHERE s_suppkey % 8 & 5 <> 0),
p AS (SELECT *, sqrt(power((rlat - lat) * 111320.0, 2) + power((rlon - lon) * 111320.0 * cos(radians((lat + rlat) / 2)), 2)) AS m FROM c, s) SELECT c_custkey, s_suppkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY m, s_suppkey) AS INTEGER) AS rank FROM p WHERE m < 200000 QUALIFY rank <= 3""",
    "field_selection": f"WITH c AS (SELECT c_custkey, c_acctbal, {place_sql('c_custkey')} FROM customer) SELECT c_custkey, c_acctbal FROM c WHERE lat BETWEEN 28 AND 45 AND lon BETWEEN -115 AND -80 AND c_custkey % 3 <> 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "throttled_events": """WITH RECURSIVE d AS (SELECT DISTINCT user_id, floor(epoch(ts)) AS t FROM events), f(user_id, t) AS (SELECT user_id, min(t) FROM d GROUP BY user_id UNION ALL SELECT f.user_id, min(d.t) FROM f JOIN d ON d.user_id = f.user_id AND d.t >= f.t + 432000 GROUP BY f.user_id, f.t) SELECT user_id, t::DOUBLE AS t FROM f""",
    "badge_labels": f"""WITH b AS (SELECT c_custkey AS badge, c_custkey % 3 AS kind, {place_sql('c_custkey')} FROM customer), i AS (SELECT s_suppkey AS item, s_suppkey % 3 AS kind, s_acctbal AS score, {place_sql('s_suppkey', 'rlat', 'rlon')} FROM supplier),
p AS (SELECT badge, item, score, sqrt(power((rlat - lat) * 111320.0, 2) + power((rlon - lon) * 111320.0 * cos(radians((lat + rlat) / 2)), 2)) AS m FROM b JOIN i USING (kind)), n AS (SELECT * FROM p WHERE m < 150000 QUALIFY row_number() OVER (PARTITION BY item ORDER BY m, badge) = 1),
l AS (SELECT badge, arg_min(item, (-score, item)) AS label FROM n GROUP BY badge) SELECT b.badge, label FROM b LEFT JOIN l USING (badge)""",
    "ferry_crossings": f"""WITH s AS (SELECT s_suppkey AS f, {place_sql('s_suppkey', 'ay', 'ax')}, {place_sql('(s_suppkey * 3 + 1)', 'by_', 'bx')} FROM supplier), d AS (SELECT f, ay, ax, by_, bx, false AS backward FROM s UNION ALL SELECT f, by_, bx, ay, ax, true FROM s),
c AS (SELECT c_custkey, {place_sql('c_custkey', 'fy', 'fx')}, {place_sql('(c_custkey * 3 + 1)', 'ty', 'tx')} FROM customer), p AS (SELECT *, power(sin(radians(ay - fy) / 2), 2) + cos(radians(ay)) * cos(radians(fy)) * power(sin(radians(ax - fx) / 2), 2) AS h1, power(sin(radians(by_ - ty) / 2), 2) + cos(radians(by_)) * cos(radians(ty)) * power(sin(radians(bx - tx) / 2), 2) AS h2 FROM c, d),
k AS (SELECT *, 12742 * atan2(sqrt(h1), sqrt(1 - h1)) AS k1, 12742 * atan2(sqrt(h2), sqrt(1 - h2)) AS k2 FROM p) SELECT c_custkey, f AS ferry, backward, round(k1 + k2, 4) AS km, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY k1 + k2, f, backward) AS INTEGER) AS rank FROM k WHERE k1 <= 300 AND k2 <= 300 QUALIFY rank <= 2""",
    "nearest_airports": f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey AS airport, [0.55, 0.85, 1.0][s_suppkey % 3 + 1] AS f, {place_sql('s_suppkey', 'rlat', 'rlon')} FROM supplier), p AS (SELECT *, sqrt(power((rlat - lat) * 111320.0, 2) + power((rlon - lon) * 111320.0 * cos(radians((lat + rlat) / 2)), 2)) AS m FROM c, s)
SELECT c_custkey, airport, round(m * f, 3)::DOUBLE AS weighted, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY m * f, airport) AS INTEGER) AS rank FROM p WHERE m < 240000 QUALIFY rank <= 4""",
    "box_lattice": f"""WITH n AS (SELECT n_nationkey, {place_sql('n_nationkey')}, 1 + n_nationkey % 4 / 2 AS sy, 2 + n_nationkey % 3 AS sx FROM nation), s AS (SELECT *, power(2, ceil(2 * log2(sy / 6)) / 2) AS py, power(2, ceil(2 * log2(sx / 6)) / 2) AS px FROM n),
b AS (SELECT *, ceil((lat - sy / 2) / py) AS i0, floor((lat + sy / 2) / py) AS i1, ceil((lon - sx / 2) / px) AS j0, floor((lon + sx / 2) / px) AS j1 FROM s) SELECT n_nationkey, ((i1 - i0 + 1) * (j1 - j0 + 1))::BIGINT AS n, round(i0 * py, 6) AS south, round(j1 * px, 6) AS east FROM b WHERE i1 >= i0 AND j1 >= j0""",
    "wind_fields": """WITH v AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS ms FROM part) SELECT k AS p_partkey, round(CASE WHEN k % 9 - 3 >= 0 THEN (k % 9 - 3) * CASE WHEN ms THEN 2.2369362920544 ELSE 1 / 1.609344 END WHEN k % 4 <> 0 THEN k % 30 / 1.609344
 WHEN k % 7 - 1 >= 0 THEN (k % 7 - 1) * CASE WHEN ms THEN 2.2369362920544 ELSE 1 / 1.609344 END END, 6)::DOUBLE AS mph FROM v""",
    "read_names": f"""WITH v AS (SELECT p_partkey AS k, {_LIST}[p_partkey % 14 + 1] AS name FROM part)
SELECT k AS p_partkey, ['tornado_shelter', 'pet_rescue', 'st_marys_high_ground', 'cooling_center_12', 'park_ride', 'park_and_ride_lot', 'main_st_garage', 'know_98_1', 'wtmj_620', 'the_5_oclock_bar', 'warming_hut', 'free_parking_2', 'stormy', '109_9_and_88_and_1000'][k % 14 + 1] AS words,
 CASE k % 14 WHEN 0 THEN 'Storm shelter' WHEN 3 THEN 'Cooling center' WHEN 10 THEN 'Warming center' ELSE 'Flood shelter' END AS shelter, k % 14 = 1 AS noise, CASE WHEN k % 14 IN (4, 5, 11) THEN false WHEN k % 14 = 6 THEN true END AS fee,
 CASE k % 14 WHEN 7 THEN '98.1 FM' WHEN 8 THEN '620 AM' WHEN 13 THEN '1000 AM' END AS dial, CASE WHEN k % 10 IN (0, 2, 7) THEN true WHEN k % 10 IN (1, 3, 4, 5) THEN false END AS reply,
 ['left|through;right|none', '', 'sharp_left|none', 'none|through;slight_right|reverse'][k % 4 + 1] AS lanes, CASE k % 4 WHEN 0 THEN CASE k % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '1,2' END WHEN 1 THEN '' WHEN 2 THEN CASE k % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '1' END ELSE CASE k % 3 WHEN 0 THEN '2' WHEN 1 THEN '1' ELSE '0,1' END END AS use,
 (1 + len(list_filter(CASE k % 3 WHEN 0 THEN [12, 30, 60, 120] WHEN 1 THEN [16, 40, 80, 160] ELSE [90, 250, 600, 1500] END, lambda e: k % 170 > e)))::INTEGER AS tier, CASE k % 7 WHEN 1 THEN 75 WHEN 3 THEN 190 WHEN 4 THEN 320 WHEN 5 THEN 500 ELSE 120 END::DOUBLE AS nightly,
 CASE WHEN k % 6 = 0 THEN 1 WHEN k % 6 <= 3 THEN k % 6 WHEN k % 2 = 0 THEN 5 ELSE 4 END::INTEGER AS signs, 'x|' || trunc(k / 7 * 500)::BIGINT || '|' || trunc(-k / 9 * 500)::BIGINT AS id,
 CASE WHEN k % 7 >= 5 THEN 'we' ELSE 'wd' END || (least(23, greatest(0, k % 26 - 1)) // 4) AS bucket, round(CASE WHEN k % 3 <> 0 AND k % 5 <> 0 THEN (k % 40 + k % 30) / 2 WHEN k % 3 <> 0 THEN k % 40 WHEN k % 5 <> 0 THEN k % 30 END * 9 / 5 + 32, 6)::DOUBLE AS warm FROM v""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "airport_pairs", "folded_marks", "probe_points"]}
