"""Spatial, as-of, set and graph queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazgrid.functions import geo
from hazgrid.operators import graph, nearby, ranking, raptor, sets, spatial
from hazgrid.operators.asof import asof
from hazgrid.plans.points import METERS_SQL, place, place_sql, table


def _customers(spark, sf):
    return place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


def _suppliers(spark, sf):
    return place(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey", "ref_lat", "ref_lon")


def nearest_cell_join(spark, sf):
    near = spatial.nearest(_customers(spark, sf), _suppliers(spark, sf), "c_custkey", "s_suppkey", 300_000.0, 2.0)
    return near.select("c_custkey", "s_suppkey", F.round("meters", 3).alias("meters"))


def nearest_anywhere(spark, sf):
    """Each customer's nearest supplier among those of its nation, from cells of half a degree on."""
    c = place(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey")
    s = place(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation")), "s_suppkey", "ref_lat", "ref_lon")
    return nearby.nearest_anywhere(c, s, "c_custkey", "s_suppkey", 0.5, on=("nation",)).select("c_custkey", "s_suppkey", F.round("meters", 3).alias("meters"))


def range_decay_max(spark, sf):
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.abs("s_acctbal") / 10_000))
    s = spatial.decay_max(_customers(spark, sf), _suppliers(spark, sf), "c_custkey", base, 400_000.0, 2.0)
    return s.select("c_custkey", F.round("score", 6).alias("score"))


def within_radius_counts(spark, sf):
    near = spatial.counts(_customers(spark, sf), _suppliers(spark, sf), "c_custkey", 200_000.0, 2.0)
    return near.select("c_custkey", "n", F.round("nearest", 3).alias("nearest"))


def pip_join(spark, sf):
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", "y", "x")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    square = F.array(corner(-5, -3), corner(5, -3), corner(5, 3), corner(-5, 3))
    triangle = F.array(corner(-5, -3), corner(5, -3), corner(0, 3))
    areas = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, square).otherwise(triangle).alias("ring"))
    return spatial.containing(_customers(spark, sf), areas, 4.0).select("c_custkey", "n_nationkey")


def bbox_clip(spark, sf):
    return spatial.clip(_customers(spark, sf), 35, -100, 38, -95, margin=1.0).select("c_custkey")


def haversine_pairs(spark, sf):
    a = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey")
    b = place(table(spark, sf, "region").select("r_regionkey"), "r_regionkey", "rlat", "rlon")
    c = a.crossJoin(F.broadcast(b))  # five fixed regions
    args = (F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    return c.select("n_nationkey", "r_regionkey", F.round(geo.haversine_km(*args), 6).alias("km"), F.round(geo.bearing_degrees(*args), 6).alias("bearing"), F.round(geo.meters(*args), 3).alias("meters"))


def asof_last_view(spark, sf):
    e = table(spark, sf, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    seen = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    latest = seen.groupBy("user_id", "ts").agg(F.max(F.struct("view_id", "view_value")).alias("v")).select("user_id", "ts", "v.*")
    return asof(bought, latest, "user_id", "ts", ["view_id", "view_value"], width=30 * 86_400).select("event_id", "view_id", F.round("view_value", 6).alias("view_value"))


def semi_closed_routes(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


def anti_unshown(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def dedup_union_priority(spark, sf):
    c = table(spark, sf, "customer").select(F.pmod("c_custkey", F.lit(400)).alias("key"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.pmod("s_suppkey", F.lit(600)).alias("key"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return sets.union_by_priority([s, c], ["key"], ["id"])


def feed_union_offsets(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return sets.union_with_offsets([c, s], "id", [1_000_000, 0])


def intersect_parts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_linestatus = 'O'").select("l_partkey"))


def except_parts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_partkey").exceptAll(li.where("l_returnflag = 'R'").select("l_partkey")).distinct()


def sssp(spark, sf):
    """From supplier 1 over the parts that suppliers deliver; a part with a supplier's key stands for that supplier."""
    li = table(spark, sf, "lineitem").where("l_suppkey <> l_partkey")
    edges = li.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min("l_quantity").alias("w"))
    return graph.shortest_paths(edges, 1)


def components(spark, sf):
    """Customers (even nodes) and their orders (odd nodes)."""
    return graph.components(table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst")))


def _orders_as_trips(spark, sf):
    """Orders as trips: lines are stops in turn, a stop every ten minutes from a start by order key."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(F.min(F.col("l_partkey") % 200).alias("stop"))
    at = F.pmod("trip", F.lit(1440)) * 60 + F.col("seq") * 600
    return li.withColumns({"arrive": at, "depart": at})


def raptor_frontier(spark, sf):
    """Four boardings over every order, without walks."""
    return raptor.arrivals(_orders_as_trips(spark, sf), 7, 0).select("stop", "round", "arrival")


def _walks(spark, sf):
    return spark.range(200).select(F.col("id").alias("from_stop"), (F.col("id") * 7 + 3).alias("to") % 200, (F.col("id") % 5 * 60 + 120).alias("seconds")).toDF("from_stop", "to_stop", "seconds")


def raptor_walks(spark, sf):
    """With a walk from each stop to another one, and a minute between rides."""
    return raptor.arrivals(_orders_as_trips(spark, sf), 7, 36_000, walks=_walks(spark, sf), change=60).select("stop", "round", "arrival")


def raptor_journeys(spark, sf):
    """The rides of each journey of ``raptor_walks`` to every tenth stop."""
    found = raptor.arrivals(_orders_as_trips(spark, sf), 7, 36_000, walks=_walks(spark, sf), change=60)
    return raptor.journeys(found, spark.range(0, 200, 10).withColumnRenamed("id", "target"))


def departure_board(spark, sf):
    return raptor.departures(_orders_as_trips(spark, sf).withColumn("stop", F.col("stop") % 20), 7, 11, F.lit(20_000))


def carried_trips(spark, sf):
    return raptor.carried(_orders_as_trips(spark, sf), 43_200).groupBy("stop").agg(F.count("*").alias("n"), F.min("arrive").alias("first"), F.max("depart").alias("last"))


def covering_boxes(spark, sf):
    """Feeds whose box holds a place, the smallest first."""
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", "y", "x").withColumn("half", 2 + F.col("n_nationkey") % 5)
    ring = F.array(*(F.struct((F.col("x") + sx * F.col("half")).alias("x"), (F.col("y") + sy * F.col("half")).alias("y")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    inside = spatial.containing(_customers(spark, sf), n.select("n_nationkey", "half", ring.alias("ring")), 4.0)
    return ranking.top_k(inside, ["c_custkey"], [F.asc("half"), F.asc("n_nationkey")], 1).select("c_custkey", "n_nationkey", F.col("half").cast("int").alias("half"))


def distance_matrix(spark, sf):
    """Distances from every twentieth vector to all vectors: the query set grows with the table, and so does its product."""
    return spatial.query_distances(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, digits=4)


def big_spenders(spark, sf):
    """Orders above the mean of their customer: a correlated subquery, which Catalyst turns into a join with an aggregate."""
    o = table(spark, sf, "orders")
    means = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return o.join(means, "o_custkey").where(F.col("o_totalprice") > F.col("mean")).select("o_orderkey")


def lateral_latest(spark, sf):
    """Each customer with the latest two orders of its own: a lateral subquery. A customer of several rows is one. The subquery
    selects what it sorts by: else a projection stands between sort and limit, and Spark's limit a customer loses the order."""
    asked = """SELECT c_custkey, o_orderkey FROM (SELECT DISTINCT c_custkey FROM {customers}),
 LATERAL (SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 2)"""
    return spark.sql(asked, customers=table(spark, sf, "customer"), orders=table(spark, sf, "orders"))


_PAIRS = f"""c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, s_acctbal, {place_sql('s_suppkey', 'rlat', 'rlon')} FROM supplier),
p AS (SELECT *, {METERS_SQL} AS m FROM c, s)"""
SQL = {
    "nearest_anywhere": f"""WITH c AS (SELECT c_custkey, c_nationkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, s_nationkey, {place_sql('s_suppkey', 'rlat', 'rlon')} FROM supplier),
p AS (SELECT *, {METERS_SQL} AS m FROM c LEFT JOIN s ON s_nationkey = c_nationkey) SELECT c_custkey, arg_min(s_suppkey, (m, s_suppkey)) AS s_suppkey, round(min(m), 3) AS meters FROM p GROUP BY c_custkey""",
    "nearest_cell_join": f"""WITH {_PAIRS}, b AS (SELECT c_custkey, arg_min(s_suppkey, (m, s_suppkey)) AS s_suppkey, round(min(m), 3) AS meters FROM p WHERE m < 300000 GROUP BY c_custkey)
SELECT c_custkey, s_suppkey, meters FROM customer LEFT JOIN b USING (c_custkey)""",
    "range_decay_max": f"""WITH {_PAIRS}, b AS (SELECT c_custkey, max(least(1.0, greatest(0.1, abs(s_acctbal) / 10000)) * (1 - m / 400000)) AS v FROM p WHERE m < 400000 GROUP BY c_custkey)
SELECT c_custkey, round(coalesce(v, 0.0), 6) AS score FROM customer LEFT JOIN b USING (c_custkey)""",
    "within_radius_counts": f"WITH {_PAIRS} SELECT c_custkey, count(*) AS n, round(min(m), 3) AS nearest FROM p WHERE m < 200000 GROUP BY c_custkey",
    "pip_join": f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), n AS (SELECT n_nationkey, {place_sql('n_nationkey', 'y', 'x')} FROM nation)
SELECT c_custkey, n_nationkey FROM c, n WHERE lat >= y - 3 AND lat < y + 3 AND CASE WHEN n_nationkey % 2 = 0 THEN lon >= x - 5 AND lon < x + 5
 ELSE lon >= x - 5 + (lat - (y - 3)) * 5 / 6 AND lon < x + 5 - (lat - (y - 3)) * 5 / 6 END""",
    "bbox_clip": f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), w AS (SELECT greatest(1.0, 500000 / (111320.0 * greatest(0.05, cos(radians(39.0))))) AS w)
SELECT c_custkey FROM c, w WHERE lat BETWEEN 34 AND 39 AND lon BETWEEN -100 - w AND -95 + w""",
    "haversine_pairs": f"""WITH p AS (SELECT * FROM (SELECT n_nationkey, {place_sql('n_nationkey')} FROM nation), (SELECT r_regionkey, {place_sql('r_regionkey', 'rlat', 'rlon')} FROM region)),
h AS (SELECT *, power(sin(radians(rlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(rlat)) * power(sin(radians(rlon - lon) / 2), 2) AS a FROM p)
SELECT n_nationkey, r_regionkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km,
 round(fmod(degrees(atan2(sin(radians(rlon - lon)) * cos(radians(rlat)), cos(radians(lat)) * sin(radians(rlat)) - sin(radians(lat)) * cos(radians(rlat)) * cos(radians(rlon - lon)))) + 360, 360.0), 6) AS bearing,
 round({METERS_SQL}, 3) AS meters FROM h""",
    "asof_last_view": """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT b.event_id, v.view_id, round(w.value, 6) AS view_value FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts > v.ts LEFT JOIN events w ON w.event_id = v.view_id""",
    "semi_closed_routes": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "anti_unshown": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "dedup_union_priority": """WITH u AS (SELECT s_suppkey % 600 AS key, s_suppkey AS id, s_name AS name, 0 AS priority FROM supplier UNION ALL SELECT c_custkey % 400, c_custkey, c_name, 1 FROM customer)
SELECT key, id, name, priority FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, id) = 1""",
    "feed_union_offsets": "SELECT c_custkey AS id, c_nationkey AS nation, 0 AS feed_no FROM customer UNION ALL SELECT s_suppkey + 1000000, s_nationkey, 1 FROM supplier",
    "intersect_parts": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'",
    "except_parts": "SELECT DISTINCT l_partkey FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')",
    "covering_boxes": f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), n AS (SELECT n_nationkey, CAST(2 + n_nationkey % 5 AS INTEGER) AS half, {place_sql('n_nationkey', 'y', 'x')} FROM nation)
SELECT c_custkey, n_nationkey, half FROM c, n WHERE lat >= y - half AND lat < y + half AND lon >= x - half AND lon < x + half QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY half, n_nationkey) = 1""",
    "raptor_frontier": """WITH RECURSIVE s AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_partkey % 200) AS stop FROM lineitem GROUP BY ALL),
t AS (SELECT trip, seq, stop, trip % 1440 * 60 + seq * 600 AS at FROM s), h AS (SELECT a.stop AS f, a.at AS dep, b.stop AS g, b.at AS arr FROM t a JOIN t b ON a.trip = b.trip AND a.seq < b.seq),
q(stop, round, arrival) AS (SELECT 7::BIGINT, 0, 0::BIGINT UNION ALL SELECT g, round + 1, min(arr)::BIGINT FROM q JOIN h ON q.stop = h.f AND h.dep >= q.arrival WHERE round < 4 GROUP BY g, round)
SELECT stop, round, arrival FROM (SELECT *, min(arrival) OVER (PARTITION BY stop ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM q) WHERE known IS NULL OR arrival < known""",
    "components": """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 2 AS a, o_orderkey * 2 + 1 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node""",
}
SQL |= {
    "sssp": """WITH RECURSIVE e AS (SELECT l_suppkey AS src, l_partkey AS dst, min(l_quantity) AS w FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL),
d(node, dist) USING KEY (node) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION ALL (SELECT e.dst, min(d.dist + e.w)::DOUBLE FROM d JOIN e ON e.src = d.node LEFT JOIN recurring.d r ON r.node = e.dst WHERE r.dist IS NULL OR d.dist + e.w < r.dist GROUP BY e.dst))
SELECT node, dist FROM d""",
    "raptor_walks": """WITH RECURSIVE s AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_partkey % 200) AS stop FROM lineitem GROUP BY ALL),
t AS (SELECT trip, seq, stop, trip % 1440 * 60 + seq * 600 AS at FROM s), h AS (SELECT a.stop AS f, a.at AS dep, b.stop AS g, b.at AS arr FROM t a JOIN t b ON a.trip = b.trip AND a.seq < b.seq),
w AS (SELECT i AS f, (i * 7 + 3) % 200 AS g, i % 5 * 60 + 120 AS secs FROM range(200) r(i)), h2 AS (SELECT f, dep, g, arr FROM h UNION ALL SELECT h.f, h.dep, w.g, h.arr + w.secs FROM h JOIN w ON w.f = h.g),
q(stop, round, arrival) AS (SELECT * FROM (SELECT 7::BIGINT, 0, 36000::BIGINT UNION ALL SELECT g, 0, 36000 + secs FROM w WHERE f = 7)
 UNION ALL SELECT g, round + 1, min(arr)::BIGINT FROM q JOIN h2 ON q.stop = h2.f AND h2.dep >= q.arrival + CASE WHEN round > 0 THEN 60 ELSE 0 END WHERE round < 4 GROUP BY g, round)
SELECT stop, round, arrival FROM (SELECT *, min(arrival) OVER (PARTITION BY stop ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM q) WHERE known IS NULL OR arrival < known""",
    "departure_board": """WITH s AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_partkey % 200) % 20 AS stop FROM lineitem GROUP BY ALL), t AS (SELECT trip, seq, stop, trip % 1440 * 60 + seq * 600 AS tm FROM s),
p AS (SELECT a.trip, a.tm AS depart, b.tm AS arrive FROM t a JOIN t b ON a.trip = b.trip AND a.seq < b.seq WHERE a.stop = 7 AND b.stop = 11 AND a.tm >= 20000), r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY trip ORDER BY depart DESC, arrive) = 1)
SELECT trip, depart, arrive FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.depart > r.depart AND x.arrive <= r.arrive)""",
    "carried_trips": """WITH s AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_partkey % 200) AS stop FROM lineitem GROUP BY ALL), t AS (SELECT trip, seq, stop, trip % 1440 * 60 + seq * 600 AS tm FROM s WHERE trip % 1440 * 60 + seq * 600 >= 43200)
SELECT stop, count(*) AS n, min(tm) - 43200 AS first, max(tm) - 43200 AS last FROM t WHERE trip IN (SELECT trip FROM t GROUP BY trip HAVING count(*) >= 2) GROUP BY stop""",
    "distance_matrix": """SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))), 4) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0""",
    "big_spenders": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey)",
    "lateral_latest": "SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 2",
}
QUERIES = {name: globals()[name] for name in [*SQL, "raptor_journeys"]}
