"""Queries of warned areas, their insides, needs along trips, zones' clocks, and what alerts say, with SQL that states its constants itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazgrid.functions import clock, geo, phrases
from hazgrid.operators import areas, hazards, head, needs
from hazgrid.plans.points import place, place_sql, table

ZONES = ("America/Chicago", "America/New_York", "America/Phoenix", "Europe/London")


def _squares(df, key, shift=0.0):
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy + shift).alias("y"))
    return place(df, key, "y", "x").withColumn("ring", F.array(corner(-1, -0.5), corner(1, -0.5), corner(1, 0.5), corner(-1, 0.5)))


def merged_areas(spark, sf):
    """Suppliers' warnings at 1000, every other one of them live again a few metres off, some with a new end, and some others."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select("s_suppkey")
    shown = _squares(s, "s_suppkey").select(k.alias("id"), (k % 3).alias("event"), "ring", F.when(k % 4 != 0, k % 40 * 50.0).alias("expires"))
    again = _squares(s.where(k % 2 == 0), "s_suppkey", 1e-4).select((k + 1_000_000).alias("id"), (k % 3).alias("event"), "ring", F.when(k % 4 != 0, k % 40 * 50.0 + F.when(k % 3 == 0, 75).otherwise(0)).alias("expires"))
    other = _squares(s.where(k % 5 == 0), "s_suppkey").select((k + 2_000_000).alias("id"), F.lit(9).cast("long").alias("event"), "ring", F.when(k % 7 != 0, k % 30 * 70.0).alias("expires"))
    looked = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    m = areas.merged(shown, again.unionByName(other), looked, F.lit(1000.0), 0.5)
    return m.select("id", "event", "expires", "source", F.round(F.get("ring", F.lit(0))["y"], 4).alias("south"))


def _fires(spark, sf):
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", "y", "x")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return n.select(F.col("n_nationkey").alias("ring_id"), F.array(corner(-1.5, -0.8), corner(1.5, -0.8), corner(1.5, 0.8), corner(-1.5, 0.8)).alias("ring"))


def perimeter_scores(spark, sf):
    """Customers near fires around the places of nations."""
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    s = hazards.perimeters(c, _fires(spark, sf), "c_custkey")
    return s.select("c_custkey", F.round("score", 6).alias("score"))


def zone_scores(spark, sf):
    """The greatest rating of the zones over a customer."""
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    zones = _fires(spark, sf).select("ring", (F.col("ring_id") % 5).alias("rating"))
    return hazards.rated_zones(c, zones, "c_custkey", F.col("rating") / 5)


def _shapes(spark, sf):
    """A bay open to the north whose centre lies in the water, a triangle and a line, around the places of nations."""
    n = place(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey", "y", "x")
    k = F.col("n_nationkey")
    ring = lambda *at: F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in at))
    bay = ring((0, 0), (7, 0), (7, 4), (6, 4), (6, 1), (2, 1), (2, 4), (0, 4))
    return n.select("n_nationkey", F.when(k % 3 == 0, bay).when(k % 3 == 1, ring((0, 0), (3, 0), (0, 3))).otherwise(ring((0, 0), (1, 1))).alias("ring"))


def icon_anchors(spark, sf):
    a = _shapes(spark, sf).select("n_nationkey", geo.icon_anchor(F.col("ring")).alias("a"))
    return a.select("n_nationkey", F.round("a.x", 6).alias("x"), F.round("a.y", 6).alias("y"))


def interior_points(spark, sf):
    p = _shapes(spark, sf).select("n_nationkey", F.posexplode(geo.interior_samples(F.col("ring"), 6)).alias("place", "p"))
    return p.select("n_nationkey", "place", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def circle_rings(spark, sf):
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    p = c.select("c_custkey", F.posexplode(geo.circle_ring(F.col("lat"), F.col("lon"), F.col("c_custkey") % 50 * 1000.0, 8)).alias("k", "p"))
    return p.select("c_custkey", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def _trips(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("trip"), (k % 500 * 1.0).alias("miles"), k.alias("seed"), F.when(k % 3 == 0, k % 40 + 60.0).alias("gas"), F.when(k % 3 == 1, k % 25 + 80.0).alias("diesel"),
        F.when(k % 3 == 2, 50.0).alias("electric"), F.lit(75.0).alias("food"), F.when(k % 4 != 0, 100.0).otherwise(float("nan")).alias("rest"),
    )


def trip_needs(spark, sf):
    return needs.schedule(_trips(spark, sf))


def next_needs(spark, sf):
    """The next stop of each trip beyond a mile of it."""
    marks = table(spark, sf, "customer").select(F.col("c_custkey").alias("trip"), (F.col("c_custkey") % 300 * 1.0).alias("mile"))
    return needs.next_needs(needs.schedule(_trips(spark, sf)), marks).select("trip", "mile", "place", "next_mile", "need")


def service_days(spark, sf):
    """Days of orders in four zones: their starts, the starts before them, what to add for Denver's clock, and half past three the next morning."""
    o = table(spark, sf, "orders")
    date, zone = F.date_format("o_orderdate", "yyyyMMdd").cast("int"), F.get(F.array(*map(F.lit, ZONES)), (F.col("o_orderkey") % 4).cast("int"))
    return o.select(
        "o_orderkey", clock.day_start(date, zone).alias("start"), F.array_join(clock.day_starts(date, zone, 3).cast("array<string>"), ",").alias("before"),
        clock.zone_shift(date, zone, F.lit("America/Denver")).alias("shift"), clock.service_instant(date, zone, F.lit(99_000)).alias("night"),
    )


_TEXTS = (
    ("Alerta por huracán", "Severe", "", "Driving a grey Chevy pickup truck, last seen"), ("Aviso de lluvias", "Moderate", "Lluvia de 60 a 75 mm", "A boy wearing a red hoodie and blue jeans"),
    ("Avís de pluja", "Severe", "", "no entity here"), ("Inundación", "Moderate", "", "The suspect left in a black Toyota sedan"), ("Rain notice", "Minor", "rain of 20 mm", "white van, no plates"),
    ("Ola de frío", "Extreme", "", "woman in a green dress"), ("VIENTO fuerte", "Minor", "", "Silver alert: missing adult, hair brown"), ("Oleaje", "Severe", "", "a yellow school bus"),
    ("Flood Warning", "Severe", "", "car"), ("Tormenta eléctrica", "Severe", "", "motorcycle, maybe orange"), ("Niebla", "Minor", "", "SUV Kia gold"),
    ("Lluvias", "Minor", "precipitaciones por la tarde muy fuertes", "child"), ("Lluvias", "Minor", "lluvias sin viento muy fuerte", "a man"),
)
_TURNS = ("Turn left onto Right Fork", "Keep right", "Make a U-turn", "Take the exit", "Arrive at home", "Merge onto I-94", "At the roundabout, go on", "Bear left", "Go straight", "Sharp left", "Turn right toward Left Bank", "Stay on the road", "Take the ramp on the left")


def read_alert_words(spark, sf):
    k = F.col("p_partkey")
    text = F.get(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("event", "severity", "detail", "entity"), row, strict=True))) for row in _TEXTS)), (k % len(_TEXTS)).cast("int"))
    p = table(spark, sf, "part").select("p_partkey", text.alias("t"), F.get(F.array(*map(F.lit, _TURNS)), (k % len(_TURNS)).cast("int")).alias("turn"))
    v, who = phrases.vehicle(F.col("t.entity")), phrases.person(F.col("t.entity"))
    return p.select("p_partkey", phrases.risk_words(F.col("t.event"), F.col("t.severity"), F.col("t.detail")).alias("event"), F.concat_ws("/", v["kind"], v["color"], v["brand"]).alias("vehicle"), who["child"].alias("child"), who["color"].alias("clothes"), phrases.maneuver(F.col("turn")).alias("sign"))


def tuned_heads(spark, sf):
    """Heads by nation, trained on some customers' balances and tuned on others: accepted ones, and errors before and after."""
    c = place(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    k = F.col("c_custkey")
    x = F.array(F.col("lat") / 50, F.col("lon") / 120, k % 2 / 1, k % 3 / 2, k % 5 / 4, k % 7 / 6, F.sin(k.cast("double")), F.lit(1.0))
    rows = c.select((F.col("c_nationkey") % 4).cast("long").alias("head"), x.alias("x"), ((F.col("c_acctbal") + 1000) / 11_000).alias("y"), F.lit(1.0).alias("weight"), (k % 3 == 0).alias("own"))
    base = head.train_heads(rows.where(~F.col("own")), "head", epochs=60)
    base = base.select("head", "theta", F.when(F.col("head") == 3, 5).otherwise(40).alias("trips"), F.lit(None).cast("double").alias("since_last"), F.lit(0).alias("tuned_at"))
    t = head.tune_heads(base, rows.where("own"), "head")
    return t.select("head", "accepted", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "n")


def _rows(names):
    return "[" + ", ".join("NULL" if n is None else "'" + n + "'" if isinstance(n, str) else str(n).lower() for n in names) + "]"


_NEEDS = """t AS (SELECT c_custkey AS trip, (c_custkey % 500)::DOUBLE AS miles, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 40 + 60 WHEN 1 THEN c_custkey % 25 + 80 ELSE 50 END::DOUBLE AS fuel, ['Gas', 'Diesel', 'Electric'][c_custkey % 3 + 1] AS kind FROM customer),
f AS (SELECT ['Fast food', 'Pizza', 'American', 'Mexican', 'Italian', 'Chinese', 'Greek', 'Coffee', 'Breakfast'] AS food),
s AS (SELECT trip, fuel * k AS mile, kind AS need FROM t, range(1, 11) r(k) WHERE fuel * k < miles UNION ALL SELECT trip, 75.0 * k, 'Food · ' || food[(trip + k * 7919) * 104729 % 1000003 % 9 + 1] FROM t, f, range(1, 11) r(k) WHERE 75.0 * k < miles
 UNION ALL SELECT trip, 100.0 * k, 'Rest' FROM t, range(1, 11) r(k) WHERE trip % 4 <> 0 AND 100.0 * k < miles), n AS (SELECT trip, row_number() OVER (PARTITION BY trip ORDER BY mile, need)::INTEGER AS place, mile::DOUBLE AS mile, need FROM s)"""
_SHAPES = f"n AS (SELECT n_nationkey AS k, {place_sql('n_nationkey', 'y', 'x')} FROM nation)"
_START = "epoch((d + INTERVAL 12 HOUR) AT TIME ZONE {z}) - 43200"

_FIRES = f"c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), f AS (SELECT n_nationkey, {place_sql('n_nationkey', 'y', 'x')} FROM nation)"

SQL = {
    "perimeter_scores": f"""WITH {_FIRES}, d AS (SELECT c_custkey, lat >= y - 0.8 AND lat < y + 0.8 AND lon >= x - 1.5 AND lon < x + 1.5 AS inside,
 sqrt(power(greatest(abs(lon - x) - 1.5, 0) * cos(radians(lat)), 2) + power(greatest(abs(lat - y) - 0.8, 0), 2)) * 111320.0 AS m FROM c, f)
SELECT c_custkey, round(max(CASE WHEN inside THEN 1.0 WHEN m < 12000 THEN 0.7 * (1 - m / 12000) ELSE 0 END), 6)::DOUBLE AS score FROM d GROUP BY c_custkey""",
    "zone_scores": f"WITH {_FIRES} SELECT c_custkey, max(CASE WHEN lat >= y - 0.8 AND lat < y + 0.8 AND lon >= x - 1.5 AND lon < x + 1.5 THEN n_nationkey % 5 / 5 ELSE 0.0 END)::DOUBLE AS score FROM c, f GROUP BY c_custkey",
    "merged_areas": f"""WITH s AS (SELECT s_suppkey AS k, {place_sql('s_suppkey', 'y', 'x')} FROM supplier), c AS (SELECT {place_sql('c_custkey')} FROM customer),
o AS (SELECT k AS id, k % 3 AS event, CASE WHEN k % 4 <> 0 THEN k % 40 * 50.0 END AS expires, x, y, y AS base FROM s WHERE k % 4 = 0 OR k % 40 * 50.0 > 1000),
l AS (SELECT k + 1000000 AS id, k % 3 AS event, CASE WHEN k % 4 <> 0 THEN k % 40 * 50.0 + CASE WHEN k % 3 = 0 THEN 75 ELSE 0 END END AS expires, x, y + 1e-4 AS y FROM s WHERE k % 2 = 0
 UNION ALL SELECT k + 2000000, 9, CASE WHEN k % 7 <> 0 THEN k % 30 * 70.0 END, x, y FROM s WHERE k % 5 = 0),
p AS (SELECT o.id, l.id AS lid, l.expires AS lexpires, l.y AS ly, l.expires IS NULL OR l.expires > 1000 AS alive FROM o JOIN l ON l.event = o.event AND sqrt(power((l.y - o.y) * 111320.0, 2) + power((l.x - o.x) * 111320.0 * cos(radians((l.y + o.y) / 2 - 0.5)), 2)) < 50),
m AS (SELECT id, min((lid, lexpires, ly)) FILTER (alive) AS n FROM p GROUP BY id), h AS (SELECT DISTINCT o.id FROM o, c WHERE lat >= y - 0.5 AND lat < y + 0.5 AND lon >= x - 1 AND lon < x + 1),
k AS (SELECT o.*, m.n, m.n IS NOT NULL AND m.n[2] IS DISTINCT FROM o.expires AS moved FROM o LEFT JOIN m USING (id) WHERE m.id IS NOT NULL OR o.id NOT IN (SELECT id FROM h))
SELECT CASE WHEN moved THEN n[1] ELSE id END AS id, event, CASE WHEN moved THEN n[2] ELSE expires END::DOUBLE AS expires, CASE WHEN moved THEN 'renewed' ELSE 'shown' END AS source, round(CASE WHEN moved THEN n[3] ELSE y END - 0.5, 4) AS south FROM k
UNION ALL SELECT id, event, expires::DOUBLE, 'new', round(y - 0.5, 4) FROM l WHERE (expires IS NULL OR expires > 1000) AND id NOT IN (SELECT lid FROM p)""",
    "icon_anchors": f"WITH {_SHAPES} SELECT k AS n_nationkey, round(x + CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0.5 END, 6)::DOUBLE AS x, round(y + CASE k % 3 WHEN 0 THEN 1.625 WHEN 1 THEN 1 ELSE 0.5 END, 6)::DOUBLE AS y FROM n",
    "interior_points": f"""WITH {_SHAPES}, b AS (SELECT *, CASE WHEN k % 3 = 0 THEN 7 ELSE 3 END AS w, CASE WHEN k % 3 = 0 THEN 4 ELSE 3 END AS h FROM n WHERE k % 3 < 2),
g AS (SELECT k, x, y, 0 AS i, 1 AS px, CASE WHEN k % 3 = 0 THEN 1.625 ELSE 1 END AS py FROM b UNION ALL SELECT k, x, y, i * 4 + j + 1, w * (j + 0.5) / 4, h * (i + 0.5) / 4 FROM b, range(4) r(i), range(4) q(j)
 WHERE CASE WHEN k % 3 = 0 THEN h * (i + 0.5) / 4 < 1 OR w * (j + 0.5) / 4 < 2 OR w * (j + 0.5) / 4 > 6 ELSE w * (j + 0.5) / 4 + h * (i + 0.5) / 4 < 3 END),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS at_, count(*) OVER (PARTITION BY k) AS m FROM g), t AS (SELECT k, place, CASE WHEN m <= 6 THEN place ELSE round(place * (m - 1) / 5) END AS at_ FROM (SELECT DISTINCT k, m FROM o), range(6) r(place) WHERE place < m)
SELECT k AS n_nationkey, place::INTEGER AS place, round(x + px, 6)::DOUBLE AS x, round(y + py, 6)::DOUBLE AS y FROM t JOIN o USING (k, at_)""",
    "circle_rings": f"""WITH c AS (SELECT c_custkey, {place_sql('c_custkey')}, c_custkey % 50 * 1000.0 AS m FROM customer) SELECT c_custkey, k::INTEGER AS k, round(lon + m / (111320.0 * greatest(cos(radians(lat)), 0.01)) * cos(2 * pi() * k / 8), 6) AS x, round(lat + m / 111320.0 * sin(2 * pi() * k / 8), 6) AS y FROM c, range(8) r(k)""",
    "trip_needs": f"WITH {_NEEDS} SELECT trip, place, mile, need FROM n",
    "next_needs": f"WITH {_NEEDS}, m AS (SELECT c_custkey AS trip, (c_custkey % 300)::DOUBLE AS at_ FROM customer) SELECT m.trip, at_ AS mile, min(place) AS place, min(n.mile) AS next_mile, arg_min(need, place) AS need FROM m LEFT JOIN n ON n.trip = m.trip AND n.mile > at_ GROUP BY m.trip, at_",
    "service_days": f"""WITH o AS (SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d, {_rows(ZONES)}[o_orderkey % 4 + 1] AS z FROM orders), s AS (SELECT *, {_START.format(z='z')} AS a, {_START.format(z="'America/Denver'")} AS r FROM o)
SELECT o_orderkey, a::BIGINT AS start, concat_ws(',', (a - (epoch((d - INTERVAL 12 HOUR) AT TIME ZONE z) - 43200))::BIGINT, (a - (epoch((d - INTERVAL 36 HOUR) AT TIME ZONE z) - 43200))::BIGINT, (a - (epoch((d - INTERVAL 60 HOUR) AT TIME ZONE z) - 43200))::BIGINT) AS before,
 (a - r)::BIGINT AS shift, (a + 99000)::BIGINT AS night FROM s""",
    "read_alert_words": f"""SELECT p_partkey, {_rows(('Tropical Storm Warning', 'Flood Advisory', 'Avís de pluja', 'Flood Advisory', 'Rain Advisory', 'Cold Weather Advisory', 'Wind Advisory', 'Oleaje', 'Flood Warning', 'Severe Thunderstorm Warning', 'Dense Fog Advisory', 'Flood Advisory', 'Rain Advisory'))}[p_partkey % 13 + 1] AS event,
 {_rows(('truck/grey/Chevrolet', '', '', 'sedan/black/Toyota', 'van/white', '', '', 'bus/yellow', 'sedan', 'motorcycle/orange', 'suv/gold/Kia', '', ''))}[p_partkey % 13 + 1] AS vehicle,
 {_rows((None, True, None, False, None, False, False, None, None, None, None, True, False))}[p_partkey % 13 + 1] AS child, {_rows((None, 'red', None, None, None, 'green', 'silver', None, None, None, None, None, None))}[p_partkey % 13 + 1] AS clothes,
 {_rows(('turn left', 'up right', 'u-turn', 'turn right', 'arrive', 'merge', 'roundabout', 'up left', 'up', 'turn left', 'turn right', 'up', 'turn left'))}[p_partkey % 13 + 1] AS sign FROM part""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "tuned_heads"]}
