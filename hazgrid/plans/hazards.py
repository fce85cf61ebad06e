"""Hazard feeds, corridor and climate queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazgrid.functions import climate, levels, scoring
from hazgrid.operators import clusters, corridor, hazards
from hazgrid.plans.points import METERS_SQL, place, place_sql, table
from hazgrid.plans.risk import PIECEWISE_SQL


def _points(spark, sf):
    return place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


def _feed(spark, sf):
    s = place(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "ref_lat", "ref_lon")
    k = F.col("s_suppkey")
    pick = lambda *words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    return s.withColumns({
        "frp": (k % 130).cast("double"), "magnitude": 2.5 + (k % 60) / 10, "age_hours": (k % 30).cast("double"), "knots": (30 + k * 7 % 120).cast("double"),
        "level": pick("warning", "watch", "advisory", "normal"), "category": pick("action", "minor", "moderate", "major", "none"),
    })


def _scored(score, spark, sf):
    return score(_points(spark, sf), _feed(spark, sf), "c_custkey").select("c_custkey", F.round("score", 6).alias("score"))


def hazard_fire(spark, sf):
    return _scored(hazards.fire, spark, sf)


def hazard_seismic(spark, sf):
    return _scored(hazards.seismic, spark, sf)


def hazard_volcanic(spark, sf):
    return _scored(hazards.volcanic, spark, sf)


def hazard_tropical(spark, sf):
    return _scored(hazards.tropical, spark, sf)


def hazard_tsunami(spark, sf):
    return _scored(hazards.tsunami, spark, sf)


def hazard_gauges(spark, sf):
    return _scored(hazards.gauges, spark, sf)


def level_scores(spark, sf):
    li = table(spark, sf, "part")
    k = F.col("p_partkey")
    return li.select("p_partkey", levels.outlook(k % 10).alias("outlook"), levels.scale(k % 9 - 1, levels.AVALANCHE).alias("avalanche"), levels.scale(k % 9 - 1, levels.SPACE_WEATHER).alias("space"), levels.tropical(F.col("p_size") * 3.0).alias("tropical"))


def climate_types(spark, sf):
    p = _points(spark, sf)
    e = (F.col("c_custkey") * 31 % 2500).cast("double")
    return p.select("c_custkey", climate.climate_type(F.col("lat"), F.col("lon"), F.when(F.col("c_custkey") % 3 != 0, e)).alias("climate"))


def _samples(spark, sf):
    li = table(spark, sf, "lineitem")
    k, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    li = li.withColumn("sample_ix", F.row_number().over(w))
    forecast = F.when(k % 2 == 0, F.struct(
        scoring.wind_risk(q).alias("wind"), scoring.precipitation_risk(F.col("l_discount") * 1000).alias("precip"), (k % 10 / 20).alias("heat"), F.lit(0.0).alias("cold"), F.lit(0.0).alias("winter"),
        (k % 4 / 10).alias("convective"), (k % 100 / 10).alias("elevation_m"), (F.col("l_tax") * 50).alias("qpf_inches"),
    ))
    field = F.when(s % 3 != 0, F.struct(*((s % (5 + i) / 10).alias(name) for i, name in enumerate(corridor.FIELD))))
    return li.select(
        "l_orderkey", "sample_ix", forecast.alias("forecast"), field.alias("field"), (s % 5 / 10).alias("gauge"), (s % 4 / 10).alias("water"),
        F.when(k % 7 == 0, F.create_map(F.lit("fire"), k % 20 / 20)).alias("live"), F.when(k % 11 == 0, F.lit("Flood Warning")).alias("event"), F.when(k % 11 == 0, F.lit(0.88)).alias("severity"),
        F.when(k % 50 == 0, 1.0).otherwise(0.0).alias("closure"),
    )


def corridor_blend(spark, sf):
    """An order is a route and its lines are samples in turn."""
    blended = corridor.blend(corridor.with_forecasts(_samples(spark, sf), ["l_orderkey"], "sample_ix"))
    s = corridor.summary(blended, ["l_orderkey"])
    return s.select("l_orderkey", *(F.round(c, 6).alias(c) for c in ("mean", "peak", "coverage", "exposure")), "unchecked")


def _marks(spark, sf):
    """Customers as marks of one map, in whole cents so that ties are exact."""
    c = place(table(spark, sf, "customer"), "c_custkey")
    return c.select(F.lit(1).cast("long").alias("view"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("kind"), "lat", "lon", F.round(F.col("c_acctbal") * 100).alias("score"))


def badge_clusters(spark, sf):
    """All customers as marks of one map, clustered within 1.1 degrees by account balance."""
    return clusters.greedy_clusters(_marks(spark, sf), "view", 1.1).select("view", "seed", "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n")


def decluttered(spark, sf):
    """The marks of all kinds that a map shows when none may be nearer than two degrees to a better one."""
    return clusters.declutter(_marks(spark, sf), "view", 2.0).select("id", "kind")


def nation_hulls(spark, sf):
    c = place(table(spark, sf, "customer"), "c_custkey", "y", "x")
    return clusters.hulls(c.select(F.col("c_nationkey").cast("long").alias("nation"), "x", "y"), "nation")


def _greedy_sql(least, same):
    """Marks in order of score, each against the list of those that stayed before it."""
    return f"""WITH RECURSIVE m AS (SELECT c_custkey AS id, c_custkey % 3 AS kind, round(c_acctbal * 100) AS score, {place_sql('c_custkey')} FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM m),
f AS (SELECT 0::BIGINT AS r, []::STRUCT(id BIGINT, kind BIGINT, lat DOUBLE, lon DOUBLE, score DOUBLE)[] AS s UNION ALL SELECT o.r, CASE WHEN len(list_filter(s, lambda x: {same} sqrt(power(x.lat - o.lat, 2) + power(x.lon - o.lon, 2)) < {least})) > 0 THEN s
 ELSE list_append(s, {{'id': o.id, 'kind': o.kind, 'lat': o.lat::DOUBLE, 'lon': o.lon::DOUBLE, 'score': o.score}}) END FROM f JOIN o ON o.r = f.r + 1),
z AS (SELECT unnest(s, recursive := true) FROM f WHERE r = (SELECT count(*) FROM o))"""


_FEED = f"""c AS (SELECT c_custkey, {place_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, {place_sql('s_suppkey', 'rlat', 'rlon')}, (s_suppkey % 130)::DOUBLE AS frp, 2.5 + (s_suppkey % 60) / 10 AS magnitude,
 (s_suppkey % 30)::DOUBLE AS age, (30 + s_suppkey * 7 % 120)::DOUBLE AS knots, s_suppkey % 4 AS lv, s_suppkey % 5 AS cat FROM supplier), p AS (SELECT *, {METERS_SQL} AS m FROM c, s)"""


def _best_sql(score, where):
    return f"WITH {_FEED}, b AS (SELECT c_custkey, max({score}) AS v FROM p WHERE {where} GROUP BY c_custkey) SELECT c_custkey, round(greatest(0.0, coalesce(v, 0.0)), 6) AS score FROM customer LEFT JOIN b USING (c_custkey)"


KNOTS = [(34, 0.30), (64, 0.52), (83, 0.72), (96, 0.82), (113, 0.90), (137, 0.96)]
_KT = "CASE " + " ".join(f"WHEN knots < {a} THEN {b}" for a, b in KNOTS) + " ELSE 1.0 END"
_REACH = "(150000 + 250000 * least(greatest((knots - 34) / 103, 0), 1))"
_U = "least(1.0, greatest(0.0, {}))"
_MULT = """CASE WHEN qpf IS NULL OR qpf <= 0 THEN 1.0 WHEN el IS NULL OR low IS NULL THEN 1 + 0.5 * ev * least(qpf / 2, 1.0)
 WHEN greatest(el - low, 0.0) <= qpf * 0.0254 THEN 1.6 + 0.4 * least((qpf * 0.0254 - greatest(el - low, 0.0)) / greatest(qpf * 0.0254, 0.01), 1.0)
 ELSE 1 + 0.5 * ev * greatest(0.0, 1 - (greatest(el - low, 0.0) - qpf * 0.0254) / greatest(qpf * 0.0254, 0.01)) END"""
SQL = {
    "hazard_fire": _best_sql("least(1.0, 0.3 + 0.7 * least(greatest(frp, 1.0) / 100, 1.0)) * (1 - m / 30000)", "m < 30000"),
    "hazard_seismic": _best_sql("least(greatest(magnitude - 3, 0.0) / 4, 1.0) * (1 - m / 150000) * (0.5 + 0.5 * (1 - age / 24))", "m < 150000 AND age < 24"),
    "hazard_volcanic": _best_sql("CASE lv WHEN 0 THEN 1.0 WHEN 1 THEN 0.72 ELSE 0.42 END * (1 - 0.5 * m / 80000)", "m < 80000 AND lv < 3"),
    "hazard_tropical": _best_sql(f"{_KT} * (1 - 0.6 * m / {_REACH})", f"m < {_REACH}"),
    "hazard_tsunami": _best_sql("CASE lv WHEN 0 THEN 1.0 WHEN 1 THEN 0.72 ELSE 0.82 END * (1 - 0.5 * m / 500000)", "m < 500000 AND lv < 3"),
    "hazard_gauges": _best_sql("[0.25, 0.45, 0.70, 1.0, 0.0][cat + 1] * (1 - m / 20000)", "m < 20000"),
    "level_scores": """SELECT p_partkey, CASE p_partkey % 10 WHEN 2 THEN 0.35 WHEN 3 THEN 0.45 WHEN 4 THEN 0.60 WHEN 5 THEN 0.72 WHEN 6 THEN 0.88 WHEN 8 THEN 1.0 ELSE 0.0 END::DOUBLE AS outlook,
[0.0, 0.25, 0.45, 0.72, 0.90, 1.0][1 + least(5, greatest(0, p_partkey % 9 - 1))]::DOUBLE AS avalanche, [0.0, 0.15, 0.30, 0.55, 0.78, 1.0][1 + least(5, greatest(0, p_partkey % 9 - 1))]::DOUBLE AS space,
(CASE """ + " ".join(f"WHEN p_size * 3.0 < {a} THEN {b}" for a, b in KNOTS) + " ELSE 1.0 END)::DOUBLE AS tropical FROM part",
    "climate_types": f"""WITH p AS (SELECT c_custkey, {place_sql('c_custkey')}, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 31 % 2500 ELSE 0 END AS e FROM customer)
SELECT c_custkey, CASE WHEN lat >= 66 THEN 'tundra' WHEN e >= 2000 THEN 'highland' WHEN lat < 25 OR (lat < 27 AND lon > -83) THEN 'tropical' WHEN lon <= -117 AND lat >= 42 THEN 'marineWestCoast' WHEN lon <= -117 THEN 'mediterranean'
 WHEN lon <= -102 AND e < 1000 AND lat < 37 THEN 'hotDesert' WHEN lon <= -102 THEN 'coldSteppe' WHEN lat < 37 THEN 'humidSubtropical' WHEN lat < 43 THEN 'humidContinentalWarm' WHEN lat < 50 THEN 'humidContinentalCool' ELSE 'subarctic' END AS climate FROM p""",
    "corridor_blend": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS ix, CASE WHEN l_partkey % 2 = 0 THEN struct_pack(
  wind := {PIECEWISE_SQL.format(v="l_quantity", a=15.0, b=28.0, c=45.0)}, precip := {PIECEWISE_SQL.format(v="(l_discount * 1000)", a=25.0, b=50.0, c=75.0)}, heat := l_partkey % 10 / 20, conv := l_partkey % 4 / 10, el := l_partkey % 100 / 10, qpf := l_tax * 50) END AS fc FROM lineitem),
w AS (SELECT *, coalesce(fc, lag(fc, 1) OVER o, lead(fc, 1) OVER o, lag(fc, 2) OVER o, lead(fc, 2) OVER o) AS near, min(fc.el) OVER (PARTITION BY l_orderkey ORDER BY ix ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS low FROM n WINDOW o AS (PARTITION BY l_orderkey ORDER BY ix)),
v AS (SELECT l_orderkey, l_partkey AS k, l_suppkey % 3 <> 0 AS has, l_suppkey AS s, near.wind AS dw, near.precip AS dp, near.heat AS dh, near.conv AS dc, near.el AS el, near.qpf AS qpf, low, 1 - (1 - l_suppkey % 5 / 10) * (1 - l_suppkey % 4 / 10) AS ev FROM w),
f AS (SELECT l_orderkey, k, greatest(CASE WHEN has THEN s % 5 / 10 ELSE 0 END, coalesce(dw, 0)) AS wind, greatest(CASE WHEN has THEN s % 6 / 10 ELSE 0 END, coalesce(dh, 0)) AS heat, CASE WHEN has THEN s % 7 / 10 ELSE 0 END AS cold,
 CASE WHEN has THEN s % 8 / 10 ELSE 0 END AS air, CASE WHEN has THEN s % 9 / 10 ELSE 0 END AS radiation, CASE WHEN has THEN s % 10 / 10 ELSE 0 END AS winter, greatest(CASE WHEN has THEN s % 11 / 10 ELSE 0 END, coalesce(dc, 0)) AS convective,
 least(1.0, greatest(CASE WHEN has THEN s % 12 / 10 ELSE 0 END, coalesce(dp, 0)) * {_MULT}) AS precip, CASE WHEN has THEN s % 13 / 10 ELSE 0 END AS environmental,
 CASE WHEN k % 7 = 0 THEN k % 20 / 20 ELSE 0 END AS fire, CASE WHEN k % 11 = 0 THEN 0.88 ELSE 0 END AS flood, CASE WHEN k % 50 = 0 THEN 1.0 ELSE 0.0 END AS closure FROM v),
t AS (SELECT *, 1 - (1 - fire) * (1 - flood) * (1 - closure) AS p, 1 - (1 - 0.64 * {_U.format("wind")}) * (1 - 0.70 * {_U.format("heat")}) * (1 - 0.66 * {_U.format("cold")}) * (1 - 0.60 * {_U.format("air")})
 * (1 - 0.52 * {_U.format("radiation")}) * (1 - 0.88 * {_U.format("winter")}) * (1 - 0.92 * {_U.format("convective")}) * (1 - 0.55 * {_U.format("precip")}) AS q FROM f),
r AS (SELECT *, greatest(p * (1 + (1 - p) * q), least(0.8, q)) AS risk FROM t)
SELECT l_orderkey, round(avg(risk), 6) AS mean, round(max(risk), 6) AS peak, round(avg(CASE WHEN risk > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(sum(environmental), 6) AS exposure, bool_or(k % 7 <> 0) AS unchecked FROM r GROUP BY l_orderkey""",
}
SQL |= {
    "badge_clusters": f"""{_greedy_sql(1.1, 'x.kind = o.kind AND')}, j AS (SELECT m.*, z.id AS seed, z.score AS zs FROM m JOIN z ON z.kind = m.kind AND sqrt(power(z.lat - m.lat, 2) + power(z.lon - m.lon, 2)) < 1.1 QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY z.score DESC, z.id) = 1)
SELECT 1::BIGINT AS view, seed, kind, round(sum(lat * greatest(score, 1e-4)) / sum(greatest(score, 1e-4)), 6) AS lat, round(sum(lon * greatest(score, 1e-4)) / sum(greatest(score, 1e-4)), 6) AS lon, count(*) AS n FROM j GROUP BY seed, kind""",
    "decluttered": f"{_greedy_sql(2.0, '')} SELECT id, kind FROM z",
}
QUERIES = {name: globals()[name] for name in [*SQL, "nation_hulls"]}
