"""Risk, score and climatology queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazgrid.functions import clock, families, scoring
from hazgrid.operators import climatology, learning
from hazgrid.plans.points import FAMILY_SQL, family_of, table

PIECEWISE_SQL = """CASE WHEN {v} IS NULL OR {v} <= 0 OR {v} <= {a} THEN 0.0
 WHEN {v} <= {b} THEN 0.398 + (0.699 - 0.398) * (({v} - {a}) / ({b} - {a}))
 WHEN {v} <= {c} THEN 0.699 + (0.8751 - 0.699) * (({v} - {b}) / ({c} - {b}))
 ELSE least(1.0, 0.8751 + (1 - 0.8751) * (({v} - {c}) / {c})) END"""
BAND_SQL = "CASE WHEN {s} > 0.8751 THEN 'Red' WHEN {s} >= 0.699 THEN 'Yellow' WHEN {s} >= 0.398 THEN 'Green' ELSE 'Transparent' END"
WEIGHT_SQL = """CASE family WHEN 'air' THEN 0.60 WHEN 'avalanche' THEN 0.86 WHEN 'cold' THEN 0.66 WHEN 'convective' THEN 0.92 WHEN 'fire' THEN 0.74 WHEN 'flood' THEN 0.96 WHEN 'heat' THEN 0.70 WHEN 'precip' THEN 0.55
 WHEN 'qpf_flood' THEN 0.96 WHEN 'radiation' THEN 0.52 WHEN 'seismic' THEN 0.78 WHEN 'tropical' THEN 0.94 WHEN 'tsunami' THEN 0.97 WHEN 'volcanic' THEN 0.90 WHEN 'wind' THEN 0.64 WHEN 'winter' THEN 0.88 ELSE 1.0 END"""
PRIMARY_SQL = "('closure', 'fire', 'flood', 'qpf_flood', 'seismic', 'storm', 'tropical', 'tsunami', 'volcanic')"
SECONDARY_SQL = "('air', 'avalanche', 'cold', 'convective', 'heat', 'precip', 'radiation', 'wind', 'winter')"
TIERS_SQL = (
    f"coalesce(1 - product(CASE WHEN family IN {PRIMARY_SQL} THEN 1 - score END), 0.0) AS p, "
    f"coalesce(1 - product(CASE WHEN family IN {SECONDARY_SQL} THEN 1 - {WEIGHT_SQL} * score END), 0.0) AS q"
)
USER_FAMILIES_SQL = f"SELECT user_id, {FAMILY_SQL} AS family, max(least(value / 1000.0, 1.0)) AS score FROM events GROUP BY ALL"


def _user_families(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", family_of().alias("family")).agg(F.max(F.least(F.col("value") / 1000.0, F.lit(1.0))).alias("score"))


def risk_realized_by_user(spark, sf):
    risk = _user_families(spark, sf).groupBy("user_id").agg(families.realized_risk(F.col("family"), F.col("score")).alias("risk"))
    return risk.select("user_id", F.round("risk", 6).alias("risk"), scoring.risk_band(F.col("risk")).alias("band"))


def risk_noisy_or_by_type_week(spark, sf):
    e = table(spark, sf, "events").withColumns({"family": family_of(), "week": clock.week_of_year(F.col("ts")), "score": F.least(F.col("value") / 100_000.0, F.lit(1.0))})
    return e.groupBy("event_type", "week").agg(F.round(families.noisy_or(F.col("score"), families.weight(F.col("family"))), 6).alias("risk"))


def risk_dominant_family(spark, sf):
    best = families.dominant_family(F.col("family"), F.round("score", 3), F.col("family").isin("closure", "storm"), 0.1)
    return _user_families(spark, sf).groupBy("user_id").agg(best.alias("dominant"))


def displayed_band(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("risk", scoring.piecewise_score(F.col("l_extendedprice") / 1000, 25, 75, 95))
    shown = learning.displayed_risk(li, ["l_orderkey"], "risk", "l_quantity")
    return shown.select("l_orderkey", F.round("displayed", 6).alias("displayed"), F.round("peak", 6).alias("peak"), scoring.risk_band(F.round("displayed", 6)).alias("band"))


def piecewise_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(scoring.wind_risk(F.col("l_quantity")), 9).alias("wind"), F.round(scoring.precipitation_risk(F.col("l_discount") * 1000), 9).alias("precip"))


def temperature_scores(spark, sf):
    t = F.col("l_quantity") * 3 - 20
    args = (t, 50, 80, 0, 110)
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(scoring.temperature_risk(*args), 9).alias("risk"), scoring.temperature_anomalous(*args).alias("anomalous"))


def forecast_composites(spark, sf):
    li = table(spark, sf, "lineitem")
    t, w, p = scoring.temperature_risk(F.col("l_quantity") * 3 - 20, 50, 80, 0, 110), scoring.wind_risk(F.col("l_quantity")), scoring.precipitation_risk(F.col("l_discount") * 1000)
    return li.select("l_orderkey", "l_linenumber", F.round(scoring.forecast_composite(t, w, p), 9).alias("composite"))


def index_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(scoring.air_score(F.col("l_quantity") * 12), 9).alias("air"), F.round(scoring.uv_score(F.col("l_quantity") / 3), 9).alias("uv"))


def flood_multiplier(spark, sf):
    li = table(spark, sf, "lineitem")
    m = scoring.flood_multiplier(F.col("l_quantity") / 100, F.lit(0.1), F.col("l_discount") * 100, F.col("l_tax") * 10)
    return li.select("l_orderkey", "l_linenumber", F.round(m, 9).alias("multiplier"))


def ranking_risk(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(scoring.ranking_risk(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5)), 9).alias("risk"))


def _counts(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    weight = F.when(F.col("o_totalprice") >= 300_000, 1.5).otherwise(1.0)
    return o.groupBy(F.col("c_nationkey").alias("nation"), clock.week_of_year(F.col("o_orderdate")).alias("week"), F.col("o_orderpriority").alias("priority")).agg(F.sum(weight).alias("n"))


def history_log_score(spark, sf):
    s = climatology.history_scores(_counts(spark, sf), ["priority"], "n")
    return s.select("nation", "week", "priority", "n", "p95", F.round("score", 9).alias("score"))


def history_harmonic(spark, sf):
    scores = climatology.history_scores(_counts(spark, sf), ["priority"], "n").groupBy("nation", "week").agg(F.max("score").alias("score"))
    h = climatology.harmonics(scores, ["nation"], "week", "score")
    return h.select("nation", *(F.round(c, 6).alias(c) for c in ("mean", "a1", "b1", "a2", "b2")), F.round(climatology.harmonic_value(F.lit(26)), 6).alias("week_26"))


def history_upsert(spark, sf):
    history = _counts(spark, sf).groupBy("nation").agg((F.max("n") / 30).alias("score"))
    existing = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), (F.pmod("n_nationkey", F.lit(5)) / 10).alias("score"))
    return climatology.upsert(existing, history, "nation").select("nation", F.round("score", 3).alias("score"))


def spread_weight_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    bridge = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return climatology.spread_weight(o, bridge, "o_orderkey", "o_totalprice").groupBy("l_suppkey").agg(F.round(F.sum("share"), 2).alias("total"))


_COUNTS_SQL = """counts AS (SELECT c_nationkey AS nation, CAST(least((dayofyear(o_orderdate) - 1) // 7, 51) AS INTEGER) AS week, o_orderpriority AS priority,
 sum(CASE WHEN o_totalprice >= 300000 THEN 1.5 ELSE 1.0 END)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
p AS (SELECT priority, quantile_disc(n, 0.95) AS p95 FROM counts WHERE n > 0 GROUP BY priority),
s AS (SELECT nation, week, counts.priority, n, p95, least(0.6, 0.6 * ln(1 + n) / ln(1 + p95)) AS raw FROM counts LEFT JOIN p USING (priority))"""
_T = "2 * pi() / 52"
_TEMP = "(l_quantity * 3 - 20)"
_TEMP_SQL = f"CASE WHEN {_TEMP} < 50 THEN least(1.0, (50 - {_TEMP}) / 50.0) WHEN {_TEMP} > 80 THEN least(1.0, ({_TEMP} - 80) / 30.0) ELSE 0.0 END"
_WIND_SQL = PIECEWISE_SQL.format(v="l_quantity", a=15.0, b=28.0, c=45.0)
_POP_SQL = PIECEWISE_SQL.format(v="(l_discount * 1000)", a=25.0, b=50.0, c=75.0)


def _steps_sql(v, points):
    cases = "".join(f" WHEN {v} < {x1} THEN {y0} + ({v} - {x0}) / {x1 - x0} * ({y1 - y0})" for (x0, y0), (x1, y1) in zip(points[:-1], points[1:-1], strict=False))
    (x0, y0), (x1, y1) = points[-2:]
    return f"CASE{cases} ELSE least({y0} + ({v} - {x0}) / {x1 - x0} * ({y1 - y0}), 1.0) END"


SQL = {
    "risk_realized_by_user": f"""WITH f AS ({USER_FAMILIES_SQL}), t AS (SELECT user_id, {TIERS_SQL} FROM f GROUP BY user_id),
r AS (SELECT user_id, greatest(p * (1 + (1 - p) * q), least(0.8, q)) AS risk FROM t)
SELECT user_id, round(risk, 6) AS risk, {BAND_SQL.format(s="risk")} AS band FROM r""",
    "risk_noisy_or_by_type_week": f"""WITH e AS (SELECT event_type, {FAMILY_SQL} AS family, CAST(least((dayofyear(ts) - 1) // 7, 51) AS INTEGER) AS week, least(value / 100000.0, 1.0) AS score FROM events)
SELECT event_type, week, round(1 - product(1 - {WEIGHT_SQL} * score), 6) AS risk FROM e GROUP BY ALL""",
    "risk_dominant_family": f"""WITH f AS ({USER_FAMILIES_SQL}), g AS (SELECT user_id, family, round(score, 3) AS s FROM f)
SELECT user_id, first(family ORDER BY -(s + CASE WHEN family IN ('closure', 'storm') THEN 0.05 ELSE 0 END), family) FILTER (WHERE s >= 0.1) AS dominant FROM g GROUP BY user_id""",
    "displayed_band": f"""WITH r AS (SELECT l_orderkey, l_quantity, {PIECEWISE_SQL.format(v="(l_extendedprice / 1000)", a=25.0, b=75.0, c=95.0)} AS risk FROM lineitem),
g AS (SELECT l_orderkey, sum(risk * l_quantity) / sum(l_quantity) AS m, max(risk) AS peak FROM r GROUP BY l_orderkey),
d AS (SELECT l_orderkey, round(CASE WHEN peak > 0.8751 THEN greatest(m, peak) ELSE m END, 6) AS displayed, round(peak, 6) AS peak FROM g)
SELECT *, {BAND_SQL.format(s="displayed")} AS band FROM d""",
    "piecewise_scores": f"SELECT l_orderkey, l_linenumber, round({_WIND_SQL}, 9) AS wind, round({_POP_SQL}, 9) AS precip FROM lineitem",
    "temperature_scores": f"""SELECT l_orderkey, l_linenumber, round({_TEMP_SQL}, 9) AS risk,
({_TEMP} > 80 AND {_TEMP} - 80 > 10.0) OR ({_TEMP} < 50 AND 50 - {_TEMP} > 50.0 / 3) AS anomalous FROM lineitem""",
    "forecast_composites": f"SELECT l_orderkey, l_linenumber, round(least(1.0, 0.45 * ({_TEMP_SQL}) + 0.30 * ({_WIND_SQL}) + 0.25 * ({_POP_SQL})), 9) AS composite FROM lineitem",
    "index_scores": f"SELECT l_orderkey, l_linenumber, round({_steps_sql('(l_quantity * 12)', [(0, 0), (50, 0.2), (100, 0.45), (150, 0.7), (200, 0.9), (500, 1)])}, 9) AS air, round({_steps_sql('(l_quantity / 3)', [(0, 0), (3, 0.2), (6, 0.4), (8, 0.6), (11, 0.85), (16, 1)])}, 9) AS uv FROM lineitem",
    "flood_multiplier": """WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS qpf, l_discount * 100 * 0.0254 AS rain, greatest(l_quantity / 100 - 0.1, 0.0) AS room, least(greatest(l_tax * 10, 0.0), 1.0) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN qpf <= 0 THEN 1.0 WHEN room <= rain THEN 1.6 + 0.4 * least((rain - room) / greatest(rain, 0.01), 1.0)
 ELSE 1 + 0.5 * e * greatest(0.0, 1 - (room - rain) / greatest(rain, 0.01)) END, 9) AS multiplier FROM v""",
    "ranking_risk": """WITH v AS (SELECT l_orderkey, l_linenumber, least(l_quantity / 50, 1.0) AS b, least(l_discount * 10, 1.0) AS z, least(l_tax * 10, 1.0) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 - (1 - b) * (1 - 0.6 * (z * 0.5 + p * 0.5)), 9) AS risk FROM v""",
    "history_log_score": f"WITH {_COUNTS_SQL} SELECT nation, week, priority, n, p95, round(CASE WHEN raw < 0.05 THEN 0.0 ELSE raw END, 9) AS score FROM s",
    "history_harmonic": f"""WITH {_COUNTS_SQL}, w AS (SELECT nation, week, max(CASE WHEN raw < 0.05 THEN 0.0 ELSE raw END) AS v FROM s GROUP BY ALL),
h AS (SELECT nation, sum(v) / 52 AS mean, sum(v * cos({_T} * week)) * (2 / 52.0) AS a1, sum(v * sin({_T} * week)) * (2 / 52.0) AS b1, sum(v * cos(2 * {_T} * week)) * (2 / 52.0) AS a2, sum(v * sin(2 * {_T} * week)) * (2 / 52.0) AS b2 FROM w GROUP BY nation)
SELECT nation, round(mean, 6) AS mean, round(a1, 6) AS a1, round(b1, 6) AS b1, round(a2, 6) AS a2, round(b2, 6) AS b2,
 round(least(0.6, greatest(0.0, mean + a1 * cos({_T} * 26) + b1 * sin({_T} * 26) + a2 * cos(2 * {_T} * 26) + b2 * sin(2 * {_T} * 26))), 6) AS week_26 FROM h""",
    "history_upsert": f"""WITH {_COUNTS_SQL}, h AS (SELECT nation, round(max(n) / 30, 3) AS h FROM counts GROUP BY nation), e AS (SELECT n_nationkey AS nation, (n_nationkey % 5) / 10.0 AS s FROM nation)
SELECT nation, round(CASE WHEN h > 0 AND h >= coalesce(s, 0.0) THEN h ELSE coalesce(s, 0.0) END, 3)::DOUBLE AS score FROM e FULL JOIN h USING (nation)""",
    "spread_weight_join": """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_suppkey, round(sum(o_totalprice / n), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN n USING (l_orderkey) GROUP BY l_suppkey""",
}
QUERIES = {name: globals()[name] for name in SQL}
