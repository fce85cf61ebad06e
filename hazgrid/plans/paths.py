"""Path, learning and ranking queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hazgrid.functions import clock
from hazgrid.operators import learning, ordered, ranking, routes
from hazgrid.plans.points import table

NOW = "2024-12-31"


def _age_days(column="ts"):
    return F.datediff(F.lit(NOW).cast("date"), F.col(column).cast("date")).cast("double")


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def path_cumulative(spark, sf):
    df = ordered.cumulative(_lines(spark, sf), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], F.col("l_quantity"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "along")


def path_prefix(spark, sf):
    df = ordered.prefix(_lines(spark, sf), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", 60.0)
    return df.groupBy("l_orderkey").agg(F.sum("kept").alias("kept"), F.count("*").alias("n"))


def grade_segments(spark, sf):
    df = ordered.grade_segments(_lines(spark, sf).withColumn("elevation", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 500)), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "elevation", "l_quantity")
    return df.groupBy("l_orderkey").agg(F.round(F.max(F.abs("grade")), 6).alias("max_grade"), F.count("*").alias("n"))


def off_line_spans(spark, sf):
    e = table(spark, sf, "events")
    return ordered.spans(e, ["user_id"], ["ts", "event_id"], F.col("value") > 50)


def local_low_frame(spark, sf):
    df = ordered.local_low(_lines(spark, sf), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", 2)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "local_low")


def nearest_forecast_coalesce(spark, sf):
    df = _lines(spark, sf).withColumn("reading", F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")))
    df = ordered.nearest_known(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], "reading")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.col("known").alias("reading"))


def check_points(spark, sf):
    """Where the quantity since the last cut reaches 50 along an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    df = _lines(spark, sf).select(F.col("l_orderkey").alias("route"), F.row_number().over(w).alias("seq"), F.col("l_quantity").alias("hop"))
    return routes.cut_every(df, 50.0).select(F.col("route").alias("l_orderkey"), "seq")


def decayed_mean(spark, sf):
    d = learning.decayed(table(spark, sf, "events"), ["user_id"], _age_days(), 364.0, observed=F.col("value"))
    return d.select("user_id", "n", F.round("weight", 6).alias("weight"), F.round(F.col("observed") / F.col("weight"), 6).alias("mean"))


def rmse_decayed(spark, sf):
    error = F.pow(F.col("value") - 50, 2)
    d = learning.decayed(table(spark, sf, "events"), ["event_type"], _age_days(), 364.0, squares=error)
    return d.select("event_type", F.round(F.sqrt(F.col("squares") / F.col("weight")), 6).alias("rmse"))


def seasonal_prior(spark, sf):
    e = table(spark, sf, "events").withColumn("week", clock.week_of_year(F.col("ts")))
    cells = learning.decayed(e, ["user_id", "week"], _age_days(), 364.0, observed=F.col("value") / 1000)
    prior = learning.seasonal_prior(cells, ["user_id"], F.lit(1), trips=F.col("n"), far=F.col("user_id") % 7 == 0)
    return prior.select("user_id", F.round("prior", 6).alias("prior"), F.round("confidence", 6).alias("confidence"))


def traffic_ladder(spark, sf):
    ratio = F.least(F.lit(3.0), F.greatest(F.lit(0.5), F.col("value") / 50))
    e = table(spark, sf, "events").withColumn("ratio", ratio)
    local = e.groupBy("user_id", "event_type").agg(F.avg("ratio").alias("mean"), F.count("*").alias("n"))
    pooled = e.groupBy("event_type").agg(F.avg("ratio").alias("mean"), F.count("*").alias("n"))
    out = learning.ladder(local, pooled, ["user_id", "event_type"], ["event_type"], 8, 0.7, 2.5)
    return out.select("user_id", "event_type", F.round("factor", 9).alias("factor"))


def quantile_radius(spark, sf):
    return learning.everyday_radius(table(spark, sf, "events"), "user_id", "value").select("user_id", F.round("radius", 6).alias("radius"))


def stddev_trip(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


def topk_recency(spark, sf):
    kinds = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("context_hits"), F.count_if(F.col("event_type") == "click").alias("time_hits"), F.count("*").alias("total_hits"), F.max("ts").alias("ts")
    )
    scored = learning.destination_scores(kinds, _age_days()).withColumn("score", F.round("score", 6))
    w = Window.orderBy(F.desc("score"), "user_id")
    return scored.orderBy(F.desc("score"), "user_id").limit(20).withColumn("rank", F.row_number().over(w)).select("user_id", "score", "rank")


def _candidates(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", "p_brand", ((F.col("p_partkey") * 37) % 90_000 - 1000).cast("double").alias("ahead_meters"), ((F.col("p_partkey") * 53) % 9000).cast("double").alias("detour_meters"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice") / 400).alias("price"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 6).cast("double").alias("rating"),
    )


def rank_stops_fuel(spark, sf):
    c = ranking.admissible(_candidates(spark, sf), 5000.0).withColumn("cost", F.round(ranking.fuel_cost(12.0, 3.5), 6))
    return ranking.top_k(c, ["p_brand"], [F.asc("cost"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "cost", "rank")


def rank_hotels(spark, sf):
    c = ranking.admissible(_candidates(spark, sf), 5000.0).withColumn("worth", F.round(ranking.hotel_value(3.5), 6))
    return ranking.top_k(c, ["p_brand"], [F.desc("worth"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "worth", "rank")


def rank_food(spark, sf):
    c = ranking.admissible(_candidates(spark, sf), 5000.0).withColumn("soonest", ranking.soonest())
    return ranking.top_k(c, ["p_brand"], [F.asc("soonest"), F.asc("p_partkey")], 3).select("p_brand", "p_partkey", "soonest", "rank")


def spread_along(spark, sf):
    c = ranking.admissible(_candidates(spark, sf), 5000.0).where("ahead_meters >= 0").withColumn("total", F.lit(90_000.0))
    return ranking.spread_along(c, ["p_brand"], "ahead_meters", "total", [F.asc("detour_meters"), F.asc("p_partkey")], 5).select("p_brand", "part", "p_partkey")


def route_designations(spark, sf):
    o = table(spark, sf, "orders").withColumns({"risk": F.col("o_orderkey") * 7 % 101, "seconds": F.col("o_orderkey") * 13 % 997})
    return ranking.designations(o, "o_custkey", "o_orderkey", "risk", "o_totalprice", "seconds")


_W = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice"
_AGE = f"date_diff('day', CAST(ts AS DATE), DATE '{NOW}')"
_DECAY = f"power(2.0, -greatest({_AGE}, 0) / 364.0)"
_CAND = """c AS (SELECT p_partkey, p_brand, (p_partkey * 37 % 90000 - 1000)::DOUBLE AS a, (p_partkey * 53 % 9000)::DOUBLE AS d,
 CASE WHEN p_size % 4 <> 0 THEN p_retailprice / 400 END AS price, CASE WHEN p_size % 3 <> 0 THEN p_size % 6 END AS rating FROM part),
k AS (SELECT * FROM c WHERE a > -500 AND d <= 5000)"""
_HOURS = "d / (60 * 1609.344)"


def _top3(value, alias, desc=""):
    return f"""WITH {_CAND}, v AS (SELECT p_brand, p_partkey, {value} AS {alias} FROM k)
SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY {alias} {desc}, p_partkey) AS INTEGER) AS rank FROM v QUALIFY rank <= 3"""


SQL = {
    "path_cumulative": f"SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS along FROM lineitem",
    "path_prefix": f"""WITH a AS (SELECT l_orderkey, l_quantity AS q, sum(l_quantity) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS along FROM lineitem)
SELECT l_orderkey, sum(least(q, 60 - (along - q))) AS kept, count(*) AS n FROM a WHERE along - q < 60 GROUP BY l_orderkey""",
    "grade_segments": f"""WITH k AS (SELECT *, l_partkey % 500 AS e FROM lineitem WHERE l_partkey % 7 <> 0), g AS (SELECT l_orderkey, 100 * (lead(e) OVER ({_W}) - e) / l_quantity AS grade FROM k)
SELECT l_orderkey, round(max(abs(grade)), 6) AS max_grade, count(*) AS n FROM g WHERE grade IS NOT NULL GROUP BY l_orderkey""",
    "off_line_spans": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM n WHERE value > 50)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n_rows FROM r GROUP BY user_id, run""",
    "local_low_frame": f"SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS local_low FROM lineitem",
    "nearest_forecast_coalesce": f"""WITH r AS (SELECT *, CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(v, lag(v, 1) OVER w, lead(v, 1) OVER w, lag(v, 2) OVER w, lead(v, 2) OVER w) AS reading FROM r WINDOW w AS ({_W})""",
    "check_points": """WITH RECURSIVE n AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS seq FROM lineitem),
f AS (SELECT l_orderkey, seq, CASE WHEN q >= 50 THEN 0.0 ELSE q END::DOUBLE AS since, q >= 50 AS cut FROM n WHERE seq = 1
 UNION ALL SELECT n.l_orderkey, n.seq, CASE WHEN f.since + n.q >= 50 THEN 0.0 ELSE f.since + n.q END, f.since + n.q >= 50 FROM f JOIN n ON n.l_orderkey = f.l_orderkey AND n.seq = f.seq + 1) SELECT l_orderkey, seq FROM f WHERE cut""",
    "decayed_mean": f"SELECT user_id, count(*) AS n, round(sum({_DECAY}), 6) AS weight, round(sum({_DECAY} * value) / sum({_DECAY}), 6) AS mean FROM events GROUP BY user_id",
    "rmse_decayed": f"SELECT event_type, round(sqrt(sum({_DECAY} * power(value - 50, 2)) / sum({_DECAY})), 6) AS rmse FROM events GROUP BY event_type",
    "seasonal_prior": f"""WITH c AS (SELECT user_id, CAST(least((dayofyear(ts) - 1) // 7, 51) AS INTEGER) AS week, sum({_DECAY}) AS w, sum({_DECAY} * value / 1000) AS o, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT *, CASE WHEN week = 1 THEN 1.0 WHEN week IN (0, 2) THEN 0.5 END AS k FROM c)
SELECT user_id, round(sum(k * o) / sum(k * w), 6) AS prior, round(least(1.0, coalesce(sum(w) FILTER (week = 1), 0) / 5), 6) AS confidence FROM k GROUP BY user_id HAVING sum(n) >= CASE WHEN user_id % 7 = 0 THEN 2 ELSE 6 END AND sum(k * w) > 0""",
    "traffic_ladder": """WITH r AS (SELECT user_id, event_type, least(3.0, greatest(0.5, value / 50)) AS r FROM events), l AS (SELECT user_id, event_type, avg(r) AS m, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT event_type, avg(r) AS pm, count(*) AS pn FROM r GROUP BY ALL)
SELECT user_id, event_type, round(CASE WHEN n >= 8 THEN least(2.5, greatest(0.7, m)) WHEN pn >= 8 THEN least(2.5, greatest(0.7, pm)) ELSE 1.0 END, 9) AS factor FROM l JOIN p USING (event_type)""",
    "quantile_radius": "SELECT user_id, round(CASE WHEN count(*) < 30 THEN 20.0 ELSE least(150.0, greatest(3.0, quantile_cont(value, 0.85))) END, 6) AS radius FROM events WHERE value >= 0 GROUP BY user_id",
    "stddev_trip": "SELECT user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY user_id",
    "topk_recency": f"""WITH k AS (SELECT user_id, 3 * count(*) FILTER (WHERE event_type = 'purchase') + 1.5 * count(*) FILTER (WHERE event_type = 'click') + count(*) AS c, max(ts) AS ts FROM events GROUP BY user_id),
s AS (SELECT user_id, round(c * power(2.0, -greatest({_AGE}, 0) / 21.0), 6) AS score FROM k) SELECT user_id, score, CAST(row_number() OVER (ORDER BY score DESC, user_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""",
    "rank_stops_fuel": _top3(f"round(coalesce(price, 3.5) * 12 + {_HOURS} * 30, 6)", "cost"),
    "rank_hotels": _top3(f"round(coalesce(rating, 3.5) / 5.0 * 2 - coalesce(price, 3.5) / 3.5 - {_HOURS} * 1.5, 6)", "worth", "DESC"),
    "rank_food": _top3("a + 3 * d", "soonest"),
    "spread_along": f"""WITH {_CAND} SELECT p_brand, CAST(least(4, floor(a * 5 / 90000)) AS INTEGER) AS part, p_partkey FROM k WHERE a >= 0
QUALIFY row_number() OVER (PARTITION BY p_brand, part ORDER BY d, p_partkey) = 1""",
    "route_designations": """WITH o AS (SELECT *, o_orderkey * 7 % 101 AS risk, o_orderkey * 13 % 997 AS seconds FROM orders)
SELECT o_custkey, arg_min(o_orderkey, (risk, o_orderkey)) AS safest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_min(o_orderkey, (seconds, o_orderkey)) AS fastest FROM o GROUP BY o_custkey HAVING count(*) > 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
