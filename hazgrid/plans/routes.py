"""Queries on routes and on alerts by cell: an order is a route, its lines are vertices within a few kilometres. Vertices are
numbered by a window of their route, which is one task's by then; blocks of a route (``width``) would only shuffle it again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazgrid.functions.geo import ring_contains
from hazgrid.operators import cells, routes
from hazgrid.plans.drives import _event
from hazgrid.plans.points import place, place_sql, table

NOW = 1000.0


def _at(key):
    k = F.col(key)
    return {"lat": 43 + k * 7919 % 1000 / 100_000, "lon": -90 + k * 104729 % 1000 / 100_000}


def _vertices(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), (F.row_number().over(w) - 1).alias("seq"), F.col("l_partkey").alias("k"), F.col("l_quantity").alias("quantity"))
    return li.withColumns(_at("k"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("route"), F.col("o_custkey").alias("c"))


def _profile(spark, sf):
    """Pieces of a profile in hundredths of a mile, so that their borders are exact."""
    v = _vertices(spark, sf)
    return v.select("route", (F.col("seq") * 30).alias("start_mile"), (F.col("seq") * 30 + 25).alias("end_mile"), (F.col("k") % 25 - 12.0).alias("grade"))


def _start():
    return (F.col("start_mile") / 100).alias("start_mile")


def route_matches(spark, sf):
    o = _orders(spark, sf).withColumns(_at("c")).select(F.col("route").alias("fix"), "route", (F.col("c") % 4).alias("last"), F.col("lat").alias("fix_lat"), F.col("lon").alias("fix_lon"))
    return routes.match_fixes(_vertices(spark, sf), o).select("fix", "seq", F.round("metres", 4).alias("metres"))


def route_progress(spark, sf):
    v = _vertices(spark, sf).select("route", "seq", "lat", "lon")
    steps = v.where("seq % 2 = 1").select("route", F.floor(F.col("seq") / 2).alias("step"), F.col("seq").alias("end_seq"))
    matched = _orders(spark, sf).select(F.col("route").alias("fix"), "route", (F.col("c") % 3).alias("seq"), F.lit(0).cast("long").alias("step"))
    p = routes.progress(v, steps, matched)
    return p.select("fix", "step", *(F.round(c, 4).alias(c) for c in ("along", "remaining", "to_end", "left")))


def vertices_ahead(spark, sf):
    marks = _orders(spark, sf).select(F.col("route").alias("mark"), "route", F.lit(0).alias("from_seq"), (F.col("c") % 20 * 100.0).alias("metres"))
    return routes.vertex_ahead(_vertices(spark, sf), marks, width=None)


def route_check_points(spark, sf):
    return routes.check_points(_vertices(spark, sf), 800.0)


def route_decimated(spark, sf):
    return routes.decimated(_vertices(spark, sf), 400.0, 100)


def route_halves(spark, sf):
    return routes.halves(_vertices(spark, sf)).select("route", "seq", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


def steep_marks(spark, sf):
    miles = _profile(spark, sf).withColumns({c: F.col(c) / 100 for c in ("start_mile", "end_mile")})
    return routes.steep_marks(_vertices(spark, sf), miles, width=None).select("route", "start_mile", "seq", "grade")


def _mile_marks(spark, sf):
    return _orders(spark, sf).select(F.col("route").alias("mark"), "route", (F.col("c") % 15 * 10).alias("mile"))


def next_steep(spark, sf):
    return routes.next_steep(_profile(spark, sf), _mile_marks(spark, sf), 6.0, 100, width=None).select("mark", _start(), "grade")


def grades_at(spark, sf):
    return routes.grades_at(_profile(spark, sf), _mile_marks(spark, sf), width=None)


def steepest(spark, sf):
    """The three steepest pieces of each route, the first of equal ones."""
    w = Window.partitionBy("route").orderBy(F.abs("grade").desc(), "start_mile")
    return _profile(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("route", _start(), "grade", "rank")


def arrival_offsets(spark, sf):
    s = routes.arrivals(_vertices(spark, sf), F.col("route") % 50 * 60.0)
    return s.select("route", "seq", F.round("offset", 6).alias("offset"))


def look_ahead_slices(spark, sf):
    s = routes.look_ahead(_vertices(spark, sf), 500.0, F.col("route") % 30 * 100.0, F.lit(900.0), F.lit(0.05))
    return s.select("route", "seq", F.round("offset", 6).alias("offset"))


def closed_routes(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey").withColumns(_at("s_suppkey"))
    return routes.through_closures(_vertices(spark, sf), p.select(F.col("lat").alias("closure_lat"), F.col("lon").alias("closure_lon")))


def edge_keys(spark, sf):
    return routes.edge_keys(_vertices(spark, sf)).groupBy("key").agg(F.count("*").alias("n"))


def even_picks(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.select("l_orderkey", F.array_join(routes.even_picks(F.col("n"), 4).cast("array<string>"), ",").alias("picks"))


def metres_to_rings(spark, sf):
    """Customers and the box around their nation: 0 inside, else metres to its edge."""
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", "y", "x")
    ring = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((-5, -3), (5, -3), (5, 3), (-5, 3))))
    c = place(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    df = c.join(n.select("n_nationkey", ring.alias("ring")), "n_nationkey")
    inside = ring_contains(F.col("lon"), F.col("lat"), F.col("ring"))
    return df.select("c_custkey", inside.alias("inside"), F.round(routes.metres_to_ring(F.col("lat"), F.col("lon"), F.col("ring")), 2).alias("metres"))


def _alert_cells(spark, sf):
    """Alerts of the cells of suppliers' places, in order of supplier."""
    s = place(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").withColumn("event", _event("s_suppkey"))
    k = F.col("s_suppkey")
    return s.select(cells.alert_cell(F.round("lat"), F.round("lon")).alias("cell"), k.alias("place"), k.alias("alert_id"), "event", (k % 10 / 10).alias("severity"), F.when(k % 4 != 0, k % 60 * 50.0).alias("expires"))


def _samples(spark, sf):
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return c.select("c_custkey", F.round("lat").alias("lat"), F.round("lon").alias("lon"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 100 * 10.0).alias("arrival"))


def provisional_samples(spark, sf):
    return cells.worst_in_cell(_samples(spark, sf), _alert_cells(spark, sf), "c_custkey", F.lit(NOW))


def provisional_warnings_first(spark, sf):
    return cells.worst_in_cell(_samples(spark, sf), _alert_cells(spark, sf), "c_custkey", F.lit(NOW), warnings_first=True)


def corridor_noisy_or(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("alert"), (F.col("l_suppkey") % 5 / 5).alias("severity"), (F.col("l_suppkey") % 5 / 4).alias("coverage"))
    return cells.corridor_noisy_or(li, "l_orderkey", "alert", "severity", "coverage").select("l_orderkey", F.round("risk", 6).alias("risk"))


def _m(a, b, c, d):
    return f"sqrt(power(({c} - {a}) * 111320.0, 2) + power(({d} - {b}) * 111320.0 * cos(radians(({a} + {c}) / 2)), 2))"


_V = f"""n AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS seq, l_partkey AS k FROM lineitem),
v AS (SELECT *, 43 + k * 7919 % 1000 / 100000 AS lat, -90 + k * 104729 % 1000 / 100000 AS lon FROM n),
b AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM v WINDOW w AS (PARTITION BY route ORDER BY seq)),
h AS (SELECT *, CASE WHEN plat IS NULL THEN 0.0 ELSE {_m('plat', 'plon', 'lat', 'lon')} END AS hop FROM b),
a AS (SELECT *, sum(hop) OVER (PARTITION BY route ORDER BY seq) AS along, max(seq) OVER (PARTITION BY route) AS last FROM h)"""
_O = "o AS (SELECT o_orderkey AS route, o_custkey AS c FROM orders)"
_G = f"{_V}, g AS (SELECT route, seq * 30 AS s, seq * 30 + 25 AS e, k % 25 - 12.0 AS grade FROM v)"
_FIRST = "SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY {order}) AS r FROM j"


def _cells_sql(order):
    names = "['storm', 'precip', 'heat', '', 'heat', '', 'winter', 'convective', 'air', 'wind', 'qpf_flood', 'air', 'seismic', '']"
    return f"""WITH s AS (SELECT s_suppkey AS k, {place_sql('s_suppkey')} FROM supplier), al AS (SELECT concat_ws('|', (round(lat) * 4)::BIGINT, (round(lon) * 4)::BIGINT) AS cell, k, k % 14 AS e, k % 10 / 10 AS sev, CASE WHEN k % 4 <> 0 THEN k % 60 * 50 END AS ex, {names}[k % 14 + 1] AS fam FROM s),
t AS (SELECT *, CASE WHEN e = 3 THEN 0 WHEN e IN (0, 5, 10) THEN 3 WHEN fam IN ('storm', 'qpf_flood', 'seismic') THEN 2 WHEN sev > 0.8751 THEN CASE WHEN fam <> '' THEN 1 ELSE 2 END WHEN fam <> '' OR sev >= 0.398 THEN 1 ELSE 0 END AS tier FROM al),
p AS (SELECT c_custkey, {place_sql('c_custkey')}, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 100 * 10 ELSE 0 END AS arr FROM customer), q AS (SELECT c_custkey, arr, concat_ws('|', (round(lat) * 4)::BIGINT, (round(lon) * 4)::BIGINT) AS cell FROM p),
j AS (SELECT q.c_custkey, t.*, ex IS NULL OR ex > 1000 + arr AS active FROM q JOIN t USING (cell)), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY active DESC, {order}) AS n FROM j)
SELECT c_custkey, CASE WHEN active THEN sev ELSE 0.0 END::DOUBLE AS risk, CASE WHEN active THEN ['Tornado Warning', 'Flood Watch', 'Heat Advisory', 'Amber Alert', 'Fire Weather Watch', 'Evacuation Immediate', 'Winter Storm Warning', 'Special Weather Statement', 'Air Quality Alert',
 'Hurricane Watch', 'Flash Flood Emergency', 'Dense Fog Advisory', 'Earthquake Warning', 'Beach Notice'][e + 1] END AS event, CASE WHEN active THEN k END AS alert_id FROM r WHERE n = 1"""


SQL = {
    "route_matches": f"""WITH {_V}, {_O}, f AS (SELECT route, c % 4 AS l, 43 + c * 7919 % 1000 / 100000 AS flat, -90 + c * 104729 % 1000 / 100000 AS flon FROM o),
d AS (SELECT f.route AS fix, seq, {_m('lat', 'lon', 'flat', 'flon')} AS d, seq >= l - 12 AND seq < l + 80 AS near FROM f JOIN v USING (route)),
m AS (SELECT fix, min((d, seq)) FILTER (near) AS x, min((d, seq)) AS y FROM d GROUP BY fix) SELECT fix, CASE WHEN x[1] <= 250 THEN x[2] ELSE y[2] END AS seq, round(CASE WHEN x[1] <= 250 THEN x[1] ELSE y[1] END, 4) AS metres FROM m""",
    "route_progress": f"""WITH {_V}, {_O}, s AS (SELECT route, seq // 2 AS step, seq AS eseq, along AS ealong FROM a WHERE seq % 2 = 1), p AS (SELECT o.route, a.seq, along, (SELECT max(along) FROM a z WHERE z.route = o.route) AS total FROM o JOIN a ON a.route = o.route AND a.seq = o.c % 3),
j AS (SELECT p.*, s.step, s.ealong, row_number() OVER (PARTITION BY p.route ORDER BY s.eseq > p.seq DESC, CASE WHEN s.eseq > p.seq THEN s.step ELSE -s.step END) AS r FROM p JOIN s USING (route))
SELECT route AS fix, step, round(along, 4) AS along, round(greatest(total - along, 0), 4) AS remaining, round(greatest(ealong - along, 0), 4) AS to_end, round(CASE WHEN total > 0 THEN greatest(total - along, 0) / total ELSE 0 END, 4) AS "left" FROM j WHERE r = 1""",
    "vertices_ahead": f"WITH {_V}, {_O} SELECT route AS mark, coalesce(min(seq) FILTER (along >= c % 20 * 100), max(seq)) AS seq FROM o JOIN a USING (route) GROUP BY route",
    "route_check_points": f"""WITH RECURSIVE {_V}, f AS (SELECT route, seq, 0.0::DOUBLE AS since, false AS cut FROM h WHERE seq = 0 UNION ALL SELECT h.route, h.seq, CASE WHEN f.since + h.hop >= 800 THEN 0.0 ELSE f.since + h.hop END, f.since + h.hop >= 800 FROM f JOIN h ON h.route = f.route AND h.seq = f.seq + 1)
SELECT route, seq FROM f WHERE cut""",
    "route_decimated": f"""WITH RECURSIVE {_V}, f AS (SELECT route, seq, lat AS klat, lon AS klon, true AS kept, last FROM a WHERE seq = 0 UNION ALL
 SELECT a.route, a.seq, CASE WHEN {_m('klat', 'klon', 'a.lat', 'a.lon')} >= 400 THEN a.lat ELSE klat END, CASE WHEN {_m('klat', 'klon', 'a.lat', 'a.lon')} >= 400 THEN a.lon ELSE klon END, {_m('klat', 'klon', 'a.lat', 'a.lon')} >= 400, a.last FROM f JOIN a ON a.route = f.route AND a.seq = f.seq + 1),
e AS (SELECT f.*, {_m('klat', 'klon', 'a.lat', 'a.lon')} > 1 AS tail FROM f JOIN a USING (route, seq)), u AS (SELECT route, seq FROM e WHERE kept OR (seq = last AND tail))
SELECT route, (row_number() OVER (PARTITION BY route ORDER BY seq) - 1)::INTEGER AS place, seq FROM u""",
    "route_halves": f"""WITH {_V}, t AS (SELECT *, max(along) OVER (PARTITION BY route) / 2 AS half FROM a), m AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY seq) AS r FROM t WHERE seq > 0 AND along >= half),
x AS (SELECT *, CASE WHEN hop > 0 THEN (half - (along - hop)) / hop ELSE 0 END AS q FROM m WHERE r = 1) SELECT route, seq, round(plat + (lat - plat) * q, 7) AS lat, round(plon + (lon - plon) * q, 7) AS lon FROM x""",
    "steep_marks": f"""WITH {_G}, z AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY s, e, grade) AS n FROM g WHERE abs(grade) >= 6), j AS (SELECT z.route, z.n, z.s, z.grade, coalesce(min(a.seq) FILTER (along >= (s / 100 + e / 100) / 2 * 1609.344), max(a.seq)) AS seq, max(a.seq) AS last FROM z JOIN a USING (route) WHERE n <= 12 GROUP BY ALL)
SELECT route, (s / 100)::DOUBLE AS start_mile, greatest(seq, 1) AS seq, grade::DOUBLE AS grade FROM j WHERE last > 0""",
    "next_steep": f"""WITH {_G}, {_O} SELECT o.route AS mark, (s / 100)::DOUBLE AS start_mile, grade::DOUBLE AS grade FROM o JOIN g USING (route) WHERE e > c % 15 * 10 AND s < c % 15 * 10 + 100 AND abs(grade) >= 6
QUALIFY row_number() OVER (PARTITION BY o.route ORDER BY s, abs(grade) DESC) = 1""",
    "grades_at": f"""WITH {_G}, {_O}, i AS (SELECT o.route, min((s, grade))[2] AS grade FROM o JOIN g ON g.route = o.route AND c % 15 * 10 BETWEEN s AND e GROUP BY o.route) SELECT route AS mark, coalesce(grade, 0)::DOUBLE AS grade FROM o LEFT JOIN i USING (route)""",
    "steepest": f"WITH {_G} SELECT route, (s / 100)::DOUBLE AS start_mile, grade::DOUBLE AS grade, row_number() OVER (PARTITION BY route ORDER BY abs(grade) DESC, s)::INTEGER AS rank FROM g QUALIFY rank <= 3",
    "arrival_offsets": f"WITH {_V} SELECT route, seq, round(CASE WHEN last > 0 THEN route % 50 * 60.0 * seq / last ELSE 0 END, 6)::DOUBLE AS offset FROM a",
    "look_ahead_slices": f"""WITH {_V} SELECT route, seq, round(greatest(0, (seq * 500 - route % 30 * 100) * 0.05), 6)::DOUBLE AS offset FROM a
WHERE seq >= floor(least(last, route % 30 * 100 / 500)) AND seq <= floor(least(last, (route % 30 * 100 + 900) / 500 + 1))""",
    "closed_routes": f"""WITH {_V}, s AS (SELECT route, plat, plon, lat, lon FROM a WHERE seq > 0 UNION ALL SELECT route, lat, lon, lat, lon FROM a WHERE last = 0), c AS (SELECT 43 + s_suppkey * 7919 % 1000 / 100000 AS y, -90 + s_suppkey * 104729 % 1000 / 100000 AS x FROM supplier),
p AS (SELECT route, (plon - x) * 111320 * cos(radians(y)) AS ax, (plat - y) * 111320 AS ay, (lon - x) * 111320 * cos(radians(y)) AS bx, (lat - y) * 111320 AS by_ FROM s, c),
q AS (SELECT *, power(bx - ax, 2) + power(by_ - ay, 2) AS l2 FROM p), r AS (SELECT *, CASE WHEN l2 > 0 THEN least(1, greatest(0, (-ax * (bx - ax) - ay * (by_ - ay)) / l2)) ELSE 0 END AS t FROM q)
SELECT DISTINCT route FROM r WHERE sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (by_ - ay), 2)) <= 40""",
    "edge_keys": f"""WITH {_V}, e AS (SELECT round(plat * 100)::BIGINT AS ay, round(plon * 100)::BIGINT AS ax, round(lat * 100)::BIGINT AS by_, round(lon * 100)::BIGINT AS bx FROM a WHERE seq > 0)
SELECT CASE WHEN (ay, ax) <= (by_, bx) THEN concat_ws(',', ay, ax, by_, bx) ELSE concat_ws(',', by_, bx, ay, ax) END AS key, count(*) AS n FROM e GROUP BY ALL""",
    "even_picks": """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, CASE WHEN n <= 4 THEN array_to_string(range(n), ',') ELSE array_to_string(list_transform(range(4), lambda k: (k * (n - 1) + 1) // 3), ',') END AS picks FROM n""",
    "metres_to_rings": f"""WITH c AS (SELECT c_custkey, c_nationkey, {place_sql('c_custkey')} FROM customer), n AS (SELECT n_nationkey, {place_sql('n_nationkey', 'y', 'x')} FROM nation), j AS (SELECT *, 111320 * cos(radians(lat)) AS k FROM c JOIN n ON n_nationkey = c_nationkey)
SELECT c_custkey, lon >= x - 5 AND lon < x + 5 AND lat >= y - 3 AND lat < y + 3 AS inside, round(CASE WHEN abs(lon - x) <= 5 AND abs(lat - y) <= 3 THEN least((5 - abs(lon - x)) * k, (3 - abs(lat - y)) * 111320)
 ELSE sqrt(power(greatest(abs(lon - x) - 5, 0) * k, 2) + power(greatest(abs(lat - y) - 3, 0) * 111320, 2)) END, 2) AS metres FROM j""",
    "provisional_samples": _cells_sql("sev DESC, k"),
    "provisional_warnings_first": _cells_sql("tier DESC, sev DESC, k"),
    "corridor_noisy_or": """WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey % 5 AS a FROM lineitem) SELECT l_orderkey, round(1 - product(1 - least(1, a / 5 * a / 4)), 6) AS risk FROM d GROUP BY l_orderkey""",
}
QUERIES = {name: globals()[name] for name in SQL}
