"""Vehicle, travel, alert and climate queries, each with SQL that states its constants itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazgrid.functions import alerting, climate, travel, vehicle
from hazgrid.plans.points import place, place_sql, table

# Names of alerts that the queries deal out by key.
EVENTS = (
    "Tornado Warning", "Flood Watch", "Heat Advisory", "Amber Alert", "Fire Weather Watch", "Evacuation Immediate", "Winter Storm Warning", "Special Weather Statement", "Air Quality Alert", "Hurricane Watch",
    "Flash Flood Emergency", "Dense Fog Advisory", "Earthquake Warning", "Beach Notice",
)


def _rounded(df, key, **columns):
    return df.select(key, *(F.round(c, 6).alias(n) for n, c in columns.items()))


def _event(key):
    return F.get(F.array(*map(F.lit, EVENTS)), (F.col(key) % len(EVENTS)).cast("int"))


def vehicle_standing(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    speed, limit = F.col("p_size") * 2.0, F.when(k % 5 != 0, 25 + k % 8 * 5.0)
    return p.select(
        "p_partkey", vehicle.standing(speed, limit).alias("standing"), vehicle.judgment(speed, limit).alias("judgment"), vehicle.estimated_limit(speed).alias("estimate"),
        vehicle.state_threshold(limit).alias("state"), vehicle.federal_threshold(limit).alias("federal"),
    )


def towing_checks(spark, sf):
    k = F.col("p_partkey")
    rated = vehicle.ratings(4.0 + k % 7, k % 4 == 0)
    found = vehicle.towing_violations(3000.0 + k % 60 * 200, k % 90 * 150.0, rated)
    return table(spark, sf, "part").select("p_partkey", found.alias("v")).select("p_partkey", F.array_join(F.transform("v", lambda x: x["kind"]), ",").alias("kinds"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x["pounds"]).alias("pounds"))


def drive_ranges(spark, sf):
    k = F.col("p_partkey")
    city, highway, mph, driven = F.when(k % 3 != 0, F.lit(20.0)), F.when(k % 3 != 0, F.lit(32.0)), F.col("p_size") * 2.0, (k % 400).cast("double")
    full = vehicle.range_miles(F.lit(12.0), F.lit(25.0), city, highway, mph, k % 10 / 10)
    economy = vehicle.economy_at(mph, F.lit(25.0), city, highway)
    fuel = F.get(F.array(*map(F.lit, ("gas", "diesel", "electric", "hay"))), (k % 4).cast("int"))
    return _rounded(
        table(spark, sf, "part"), "p_partkey", economy=economy, full=full, left=vehicle.fuel_left(full, driven), cost=vehicle.fuel_cost(driven, economy, F.col("p_retailprice") / 400 - 2.6),
        co2=vehicle.co2_per_mile(fuel, economy), transit=vehicle.transit_co2_per_mile(k % 2 == 0, k % 3 == 0), combined=vehicle.combined_economy(city, highway), refuel=vehicle.should_refuel(full - driven, k % 90 * 1.0).cast("int"),
    )


def drive_scores(spark, sf):
    k = F.col("p_partkey")
    speed, push = F.col("p_size") * 2.0 - 1, (k % 9 - 3) / 2
    wind = vehicle.headwind(k % 30 - 5.0, F.when(k % 5 != 0, k % 360 * 1.0), k * 7 % 360 * 1.0)
    load = vehicle.load_factor(F.when(k % 3 != 0, 3000 + k % 50 * 100.0), F.lit(3000.0), F.when(k % 2 == 0, k % 11 / 10), k % 6 == 0)
    score = vehicle.drive_score(speed, push, k % 13 - 6.0, F.lit(55.0), wind, load, vehicle.drag_sensitivity(F.lit(20.0), F.when(k % 4 != 0, 10 + k % 30 * 1.0)))
    df = table(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score"), speed.alias("speed"), push.alias("push"))
    return df.select("p_partkey", "score", vehicle.drive_verdict(F.col("speed"), F.col("push"), F.col("score")).alias("verdict"))


def route_limits(spark, sf):
    k = F.col("p_partkey")
    heights, weights = F.when(k % 4 != 0, F.array(k % 6 + 2.0, k % 7 + 2.5)), F.when(k % 5 != 0, F.array(k % 9 * 3000.0, k % 8 * 5000.0))
    return table(spark, sf, "part").select(
        "p_partkey", vehicle.passes_clearances(F.lit(3.2), F.lit(0.3), heights).alias("height"), vehicle.passes_grade(F.lit(6.0), F.when(k % 3 != 0, k % 11 * 1.0)).alias("grade"),
        vehicle.passes_weights(F.when(k % 7 != 0, F.lit(12_000.0)), weights).alias("weight"),
    )


def pursuit_radii(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    return e.select("event_id", F.round(vehicle.pursuit_radius(v * 60 - 100, v), 4).alias("radius"), vehicle.service_hours(v * 200).alias("hours"))


def travel_models(spark, sf):
    k = F.col("p_partkey")
    miles = (k % 700).cast("double")
    mode = F.get(F.array(*map(F.lit, ("Amtrak", "Greyhound", "Rail", "Bus"))), (k % 4).cast("int"))
    return _rounded(
        table(spark, sf, "part"), "p_partkey", flight=travel.flight_seconds(miles), door=travel.door_seconds(miles), fare=travel.flight_fare(miles), typical=travel.typical_fare(miles), rail=travel.rail_fare(miles),
        coach=travel.coach_fare(miles), seconds=travel.mode_seconds(mode, F.when(k % 3 != 0, k % 500 * 60.0), miles), worth=travel.worth_flying(miles).cast("int"),
    )


def ride_offers(spark, sf):
    k = F.col("p_partkey")
    offer = travel.ride_offer(k % 120 * 90.0, k % 40 * 60.0, k % 50 / 1.0)
    return table(spark, sf, "part").select("p_partkey", offer.alias("o")).where("o is not null").select("p_partkey", *(F.round(f"o.{c}", 6).alias(c) for c in ("miles", "seconds", "walk", "cost")))


def trip_shapes(spark, sf):
    k = F.col("p_partkey")
    bit = lambda n: F.floor(k / n) % 2 == 1
    s = travel.trip_shape(bit(1), bit(2), bit(4), bit(8), bit(16), bit(32), k % 500 * 1.0)
    return table(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.main", "s.access", "s.egress", "s.fallback", travel.packed_shape(F.col("s")).alias("packed"))


def switch_verdicts(spark, sf):
    k = F.col("p_partkey")
    risk = F.when(k % 17 == 0, float("nan")).otherwise(k % 21 / 20)
    known, other = F.when(k % 6 != 0, k % 50 * 60.0), k % 40 * 60.0 - 60
    return table(spark, sf, "part").select(
        "p_partkey", travel.switch_verdict(k % 5 != 0, risk, k % 7 != 0, k % 19 / 18, k % 23 == 0).alias("verdict"), travel.saves_enough(known, other, 300.0).alias("enough"), travel.saves_enough(known, other, 900.0).alias("wins"),
        travel.keeps_road_choice(F.when(k % 3 == 0, "toll free").when(k % 3 == 1, "avoid highways").otherwise("standard"), k % 2 == 0, F.when(k % 4 == 0, "avoid highways").otherwise("standard"), k % 5 == 0, k % 7 < 3, k % 11 == 0, k % 13 == 0).alias("keeps"),
        F.round(travel.tie_tolerance(k % 300 * 60.0), 6).alias("tie"), travel.dedupe_key(k * 37.0, k * 11.0).alias("key"),
    )


def readouts(spark, sf):
    k = F.col("p_partkey")
    m = k * 13.7
    return table(spark, sf, "part").select(
        "p_partkey", travel.turn_feet(m).alias("feet"), F.round(travel.spoken_miles(m), 6).alias("miles"), travel.clock_text(k * 97.0).alias("clock"), travel.exposure_percent(k % 83 / 82).alias("percent"),
        F.round(travel.look_ahead(k % 60 * 1.0)["metres"], 6).alias("ahead"), travel.look_ahead(k % 60 * 1.0)["cadence"].alias("cadence"),
    )


def link_tiers(spark, sf):
    k = F.col("p_partkey")
    radio = F.get(F.array(*map(F.lit, ("NR", "LTE-A", "EDGE", "CDMA1x", "HSDPA"))), (k % 6).cast("int"))
    return table(spark, sf, "part").select("p_partkey", travel.signal_tier(radio, k % 9 == 0, k % 13 == 0).alias("signal"), travel.device_tier(k % 10, k % 8 * 1.0).alias("device"), travel.in_season(k % 12 * 100 + k % 28 + 1, k % 11 * 100 + 101, k % 13 * 90 + 101).alias("season"))


def itineraries(spark, sf):
    """Orders are itineraries, their lines legs; every seventh fare is missing."""
    li = table(spark, sf, "lineitem")
    cents = F.when(F.col("l_partkey") % 7 != 0, (F.col("l_quantity") * 100).cast("long"))
    currency = F.when(F.col("l_partkey") % 7 != 0, F.when(F.col("l_suppkey") % 9 == 0, "CAD").otherwise("USD"))
    g = li.groupBy("l_orderkey").agg(travel.fare_total(cents, currency, F.col("l_linenumber") == 2).alias("f"), F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    n = F.col("l_orderkey")
    return g.select(
        "l_orderkey", F.col("f.cents").alias("cents"), F.col("f.currency").alias("currency"), F.col("f.at_least").alias("at_least"), travel.itinerary_cost(n % 5000, F.col("n") - 1).alias("cost"),
        travel.door_to_door(F.when(n % 3 != 0, F.lit(60.0)), F.col("q"), n % 60 * 1.0, F.when(n % 4 != 0, F.lit(30.0))).alias("door"),
    )


def alert_actions(spark, sf):
    e = table(spark, sf, "events").withColumns({"name": _event("event_id"), "severity": F.when(F.col("event_id") % 29 == 0, float("nan")).otherwise(F.col("value") / 100)})
    n, s = F.col("name"), F.col("severity")
    return e.select(
        "event_id", alerting.action(n, s, F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 240 * 60.0 - 60)).alias("action"), alerting.threat_rank(n, s).alias("rank"), alerting.sample_tier(n, s).alias("tier"),
        alerting.same_hazard(n, F.when(F.col("event_id") % 2 == 0, n)).alias("same"),
        alerting.escalation(F.col("event_id") % 5 != 0, s, s + 0.1, F.col("event_id") % 7 == 0, F.col("event_id") % 4 / 4 - 0.25, F.col("event_id") % 6 / 6).alias("escalation"),
    )


def alert_hours(spark, sf):
    e = table(spark, sf, "events").withColumn("name", _event("event_id"))
    i = F.col("event_id")
    sure = F.get(F.array(*map(F.lit, ("Observed", "Likely", "Possible", "Unlikely"))), (i % 4).cast("int"))
    severity = F.when(i % 6 != 0, F.col("value") / 100)
    return e.select(
        "event_id", alerting.usual_kind(F.col("name")).alias("kind"), F.round(alerting.learned_hours(alerting.usual_hours(F.col("name")), i % 250, i % 9 - 2.0), 9).alias("learned"),
        F.round(alerting.unknown_end_hours(F.col("name"), severity, i % 20, sure, i % 250, i % 9 - 2.0), 9).alias("hours"),
    )


def _climates(spark, sf):
    c = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return c.withColumn("kind", climate.climate_type(F.col("lat"), F.col("lon"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") * 31 % 2500).cast("double"))))


def climate_norms(spark, sf):
    k = F.col("c_custkey")
    df = _climates(spark, sf).withColumn("norms", climate.seasonal_norms(F.col("kind"), k % 60 - 5))
    n = F.col("norms")
    return df.select(
        "c_custkey", F.round("norms.low", 6).alias("low"), F.round("norms.high", 6).alias("high"), climate.temperature_beyond_normal(k % 130 - 20.0, n).alias("odd_temperature"), climate.wind_beyond_normal(k % 40 * 1.0, n).alias("odd_wind")
    )


def forecast_scores(spark, sf):
    k = F.col("c_custkey")
    df = _climates(spark, sf).withColumn("c", climate.comfort(F.col("kind")))
    temp, wind, rain = F.when(k % 7 != 0, k % 140 - 20.0), F.when(k % 5 != 0, k % 70 * 1.0), F.when(k % 6 != 0, k % 101 * 1.0)
    df = df.select("c_custkey", climate.forecast_score(temp, wind, rain, F.col("c")).alias("score"), climate.predictor_families(temp, wind, rain, F.col("c")).alias("p"))
    return _rounded(df, "c_custkey", score=F.col("score"), **{n: F.col(f"p.{n}") for n in climate.PREDICTORS})


def family_priors(spark, sf):
    df = place(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    week = F.col("c_custkey") % 52
    df = df.where(climate.in_conus(F.col("lat"), F.col("lon"))).select("c_custkey", F.explode(climate.family_priors(F.col("lat"), F.col("lon"), week)).alias("family", "prior"))
    return df.where("prior > 0").select("c_custkey", "family", F.round("prior", 6).alias("prior"))


def band_comforts(spark, sf):
    k = F.col("c_custkey")
    b = climate.band_comfort(10 + k % 650 / 10, F.when(k % 3 != 0, (k * 31 % 700).cast("double")))
    return table(spark, sf, "customer").select("c_custkey", b.alias("b")).select("c_custkey", "b.band", *(F.round(f"b.{c}", 6).alias(c) for c in ("low", "high", "record_low", "record_high")))


_P = "p_partkey"
_MPU = "CASE WHEN p_partkey % 3 = 0 THEN 25.0 WHEN p_size * 2 < 30 THEN 20.0 WHEN p_size * 2 < 55 THEN 20 + 12 * (p_size * 2 - 30) / 25 WHEN p_size * 2 < 65 THEN 32.0 ELSE greatest(32 * (1 - (p_size * 2 - 65) * 0.012), 19.2) END"
_NAMES = "[" + ", ".join(f"'{e}'" for e in EVENTS) + "]"
_LOOKOUT = "(n LIKE '%amber alert%')"
_LIFE = "(n LIKE '%tornado warning%' OR n LIKE '%evacuation%' OR n LIKE '%amber alert%' OR n LIKE '%flash flood emergency%')"
_FAMILY = """CASE n WHEN 'tornado warning' THEN 'storm' WHEN 'flood watch' THEN 'precip' WHEN 'heat advisory' THEN 'heat' WHEN 'fire weather watch' THEN 'heat' WHEN 'winter storm warning' THEN 'winter' WHEN 'special weather statement' THEN 'convective'
 WHEN 'air quality alert' THEN 'air' WHEN 'hurricane watch' THEN 'wind' WHEN 'flash flood emergency' THEN 'qpf_flood' WHEN 'dense fog advisory' THEN 'air' WHEN 'earthquake warning' THEN 'seismic' END"""
_KIND = """CASE n WHEN 'tornado warning' THEN 'tornado' WHEN 'flood watch' THEN 'flood watch' WHEN 'heat advisory' THEN 'heat' WHEN 'fire weather watch' THEN 'red flag' WHEN 'evacuation immediate' THEN 'fire' WHEN 'winter storm warning' THEN 'winter storm'
 WHEN 'special weather statement' THEN 'special weather statement' WHEN 'air quality alert' THEN 'air quality' WHEN 'hurricane watch' THEN 'hurricane watch' WHEN 'flash flood emergency' THEN 'flash flood' WHEN 'dense fog advisory' THEN 'fog' ELSE 'other' END"""
_HOURS = """CASE n WHEN 'tornado warning' THEN 0.5 WHEN 'flood watch' THEN 17 WHEN 'heat advisory' THEN 9 WHEN 'fire weather watch' THEN 8 WHEN 'evacuation immediate' THEN 72 WHEN 'winter storm warning' THEN 27
 WHEN 'special weather statement' THEN 1 WHEN 'air quality alert' THEN 24 WHEN 'hurricane watch' THEN 30 WHEN 'flash flood emergency' THEN 3 WHEN 'dense fog advisory' THEN 7 ELSE 12 END"""
_CLIMATE = f"""p AS (SELECT c_custkey AS k, {place_sql('c_custkey')}, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 31 % 2500 ELSE 0 END AS e FROM customer),
c AS (SELECT k, CASE WHEN e >= 2000 THEN 'high' WHEN lat < 25 OR (lat < 27 AND lon > -83) THEN 'trop' WHEN lon <= -117 AND lat >= 42 THEN 'marine' WHEN lon <= -117 THEN 'med'
 WHEN lon <= -102 AND e < 1000 AND lat < 37 THEN 'desert' WHEN lon <= -102 THEN 'steppe' WHEN lat < 37 THEN 'subtrop' WHEN lat < 43 THEN 'warm' WHEN lat < 50 THEN 'cool' ELSE 'sub' END AS kind FROM p),
t(kind, cl, ch, rl, rh, wl, wh, sl, sh, wm, ws) AS (VALUES ('marine', 45.0, 72.0, 12.0, 106.0, 38.0, 50.0, 58.0, 72.0, 8.0, 3.0), ('med', 48.0, 82.0, 25.0, 116.0, 45.0, 58.0, 65.0, 82.0, 7.0, 2.5), ('desert', 55.0, 98.0, 25.0, 125.0, 38.0, 62.0, 72.0, 98.0, 9.0, 4.0),
 ('steppe', 35.0, 85.0, -25.0, 110.0, 15.0, 35.0, 55.0, 85.0, 11.0, 5.0), ('subtrop', 45.0, 90.0, 5.0, 112.0, 38.0, 58.0, 68.0, 90.0, 8.0, 3.5), ('warm', 35.0, 82.0, -20.0, 108.0, 22.0, 38.0, 62.0, 82.0, 9.0, 4.0),
 ('cool', 28.0, 78.0, -35.0, 104.0, 12.0, 28.0, 58.0, 78.0, 10.0, 4.5), ('sub', 20.0, 72.0, -55.0, 98.0, 0.0, 20.0, 50.0, 72.0, 12.0, 5.5), ('trop', 68.0, 90.0, 40.0, 106.0, 68.0, 84.0, 76.0, 90.0, 11.0, 4.0), ('high', 28.0, 74.0, -40.0, 100.0, 18.0, 35.0, 50.0, 74.0, 11.0, 5.0))"""


def _line(v, a, b, c):
    return f"""CASE WHEN {v} IS NULL OR {v} <= {a} THEN 0.0 WHEN {v} <= {b} THEN 0.398 + 0.301 * ({v} - {a}) / ({b} - {a}) WHEN {v} <= {c} THEN 0.699 + 0.1761 * ({v} - {b}) / ({c} - {b}) ELSE least(1.0, 0.8751 + 0.1249 * ({v} - {c}) / {c}) END"""


def _ramp(x, a, b):
    return f"least(1.0, greatest(0.0, ({x} - ({a})) / (({b}) - ({a}))))"


def _box(x, a, b, s):
    return f"({_ramp(x, a, f'{a} + {s}')} * (1 - {_ramp(x, f'{b} - {s}', b)}))"


SQL = {
    "vehicle_standing": """WITH v AS (SELECT p_partkey, p_size * 2.0 AS s, CASE WHEN p_partkey % 5 <> 0 THEN 25 + p_partkey % 8 * 5.0 END AS l FROM part)
SELECT p_partkey, CASE WHEN l IS NOT NULL AND s >= least(l + 20, 85) THEN 'federal' WHEN s >= l + 5 THEN 'state' ELSE 'legal' END AS standing, CASE WHEN s - l >= 10 THEN 'over' WHEN s - l >= 5 THEN 'slightly over' ELSE 'under' END AS judgment,
 CASE WHEN s < 30 THEN 25.0 WHEN s < 42 THEN 35.0 WHEN s < 52 THEN 45.0 WHEN s < 62 THEN 55.0 ELSE 65.0 END::DOUBLE AS estimate, (l + 5)::DOUBLE AS state, CASE WHEN l IS NOT NULL THEN least(l + 20, 85)::DOUBLE END AS federal FROM v""",
    "towing_checks": """WITH v AS (SELECT p_partkey, 3000.0 + p_partkey % 60 * 200 AS w, p_partkey % 90 * 150.0 AS t, 4 + p_partkey % 7 AS h, CASE WHEN p_partkey % 4 = 0 THEN 1200 ELSE 0 END AS ev FROM part),
r AS (SELECT *, CASE WHEN h < 5 THEN 4300 WHEN h < 6 THEN 6000 WHEN h < 7 THEN 7100 WHEN h < 10 THEN 9500 ELSE 26000 END + ev AS g, CASE WHEN h < 5 THEN 1000 WHEN h < 6 THEN 3500 WHEN h < 7 THEN 9000 WHEN h < 10 THEN 5000 ELSE 10000 END AS c,
 CASE WHEN h < 5 THEN NULL WHEN h < 6 THEN 11000 WHEN h < 7 THEN 15500 WHEN h < 10 THEN 15000 ELSE 36000 END AS b FROM v),
o AS (SELECT p_partkey, w - g AS og, t - c AS ot, w + t - coalesce(b, g + c) AS oc FROM r)
SELECT p_partkey, concat_ws(',', CASE WHEN og > 0 THEN 'gross' END, CASE WHEN ot > 0 THEN 'tow' END, CASE WHEN oc > 0 THEN 'combined' END) AS kinds, (greatest(og, 0) + greatest(ot, 0) + greatest(oc, 0))::DOUBLE AS pounds FROM o""",
    "drive_ranges": f"""WITH v AS (SELECT *, {_MPU} AS mpu, p_size * 2.0 AS mph, p_partkey % 10 / 10 AS idle, p_partkey % 400 AS driven, p_retailprice / 400 - 2.6 AS price FROM part),
r AS (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN 12 * mpu * (1 - idle * 0.5) ELSE 300 * least(1.0, greatest(0.5, 1 - greatest(mph - 55, 0) * 0.012 - idle * 0.5)) END AS rng FROM v)
SELECT p_partkey, round(mpu, 6) AS economy, round(rng, 6) AS "full", round(least(1.0, greatest(0.0, 1 - driven / rng)), 6) AS "left", CASE WHEN price > 0 THEN round(driven / mpu * price, 6) END AS cost,
 round(CASE p_partkey % 4 WHEN 0 THEN 8887.0 WHEN 1 THEN 10180.0 WHEN 2 THEN 390.0 END / mpu, 6) AS co2, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 113.0 ELSE 56.0 END ELSE CASE WHEN p_partkey % 2 = 0 THEN 65.0 ELSE 105.0 END END::DOUBLE AS transit,
 CASE WHEN p_partkey % 3 <> 0 THEN round(1 / (0.55 / 20 + 0.45 / 32), 6) END AS combined, CASE WHEN rng - driven - 40 <= p_partkey % 90 THEN 1 ELSE 0 END::INTEGER AS refuel FROM r""",
    "drive_scores": """WITH v AS (SELECT p_partkey AS k, p_size * 2.0 - 1 AS s, (p_partkey % 9 - 3) / 2 AS a, p_partkey % 13 - 6 AS g, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 30 > 5 THEN (p_partkey % 30 - 5) * cos(radians(p_partkey % 360 - p_partkey * 7 % 360)) ELSE 0 END AS w,
 CASE WHEN p_partkey % 3 <> 0 THEN least(2.5, (3000 + p_partkey % 50 * 100) / 3000) ELSE 1 END + CASE WHEN p_partkey % 2 = 0 THEN 0.04 * least(1.0, p_partkey % 11 / 10) ELSE 0 END + CASE WHEN p_partkey % 6 = 0 THEN 0.35 ELSE 0 END AS l,
 CASE WHEN p_partkey % 4 <> 0 THEN least(1.8, greatest(0.7, 1.35 / greatest(0.6, (10 + p_partkey % 30) / 20))) ELSE 1 END AS d FROM part),
r AS (SELECT k, s, a, round((CASE WHEN a > 0 THEN a / 2.5 ELSE greatest(a / 8, -0.3) END + CASE WHEN g >= 0 THEN g / 6 ELSE greatest(g / 12, -0.4) END) * l + CASE WHEN greatest(s + w, 0) > 55 THEN 2 * power((s + w - 55) / 55, 2) ELSE 0 END * d, 6) AS score FROM v)
SELECT k AS p_partkey, score, CASE WHEN s < 2 AND a <= 0.1 THEN 'wasteful' WHEN score <= 0.25 THEN 'efficient' WHEN score <= 0.75 THEN 'fair' ELSE 'wasteful' END AS verdict FROM r""",
    "route_limits": """SELECT p_partkey, p_partkey % 4 = 0 OR (p_partkey % 6 + 2.0 > 3.5 + 1e-9 AND p_partkey % 7 + 2.5 > 3.5 + 1e-9) AS height, p_partkey % 3 = 0 OR p_partkey % 11 < 6 AS grade,
 p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR (p_partkey % 9 * 3000 >= 12000 AND p_partkey % 8 * 5000 >= 12000) AS weight FROM part""",
    "pursuit_radii": """SELECT event_id, round(greatest(greatest(value, 5) * 0.44704 * least(greatest(value * 60 - 100, 0), 10800), 800), 4) AS radius,
 CASE WHEN value * 200 >= 39600 THEN 'limit' WHEN value * 200 >= 28800 THEN 'break' WHEN 28800 - value * 200 <= 1800 THEN 'soon' ELSE 'ok' END AS hours FROM events""",
    "travel_models": """WITH v AS (SELECT p_partkey AS k, p_partkey % 700 AS m, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 500 * 60 ELSE 0 END AS d FROM part), f AS (SELECT *, CASE WHEN m > 0 THEN 2700 + m / 460 * 3600 ELSE 0 END AS fly FROM v)
SELECT k AS p_partkey, round(fly, 6)::DOUBLE AS flight, round(fly + 7200, 6)::DOUBLE AS door, round(greatest(59, 39 + m * 0.11), 6)::DOUBLE AS fare, round(159.85 + m * 0.0876, 6)::DOUBLE AS typical, round(greatest(15, m * 0.15), 6)::DOUBLE AS rail, round(greatest(12, m * 0.12), 6)::DOUBLE AS coach,
 round(CASE WHEN d > 0 THEN d * CASE k % 4 WHEN 0 THEN 1.45 WHEN 1 THEN 1.35 WHEN 2 THEN 1.3 ELSE 2.0 END WHEN m > 0 THEN m / CASE k % 4 WHEN 0 THEN 40 WHEN 1 THEN 44 WHEN 2 THEN 22 ELSE 12 END * 3600 ELSE 0 END, 6)::DOUBLE AS seconds, CASE WHEN m >= 100 THEN 1 ELSE 0 END::INTEGER AS worth FROM f""",
    "ride_offers": """WITH v AS (SELECT p_partkey, p_partkey % 120 * 90.0 AS w, p_partkey % 40 * 60.0 AS d, p_partkey % 50 AS m FROM part), s AS (SELECT *, CASE WHEN m = 0 THEN 1 ELSE least(1.0, 20.0 / m) END AS sh FROM v),
o AS (SELECT *, w - sh * d - w * (1 - sh) AS saved FROM s)
SELECT p_partkey, round(sh * m, 6)::DOUBLE AS miles, round(sh * d, 6)::DOUBLE AS seconds, round(w * (1 - sh), 6)::DOUBLE AS walk, round(least(25.0, 3 + 1.1 * m), 6)::DOUBLE AS cost FROM o WHERE w >= 1800 AND d > 0 AND m > 0 AND saved >= 900 AND saved / w >= 0.4""",
    "trip_shapes": """WITH v AS (SELECT p_partkey AS k, p_partkey // 1 % 2 = 1 AS foot, p_partkey // 2 % 2 = 1 AS train, p_partkey // 4 % 2 = 1 AS bus, p_partkey // 8 % 2 = 1 AS plane, p_partkey // 16 % 2 = 1 AS rental, p_partkey // 32 % 2 = 1 AS ship, p_partkey % 500 AS m FROM part),
a AS (SELECT *, CASE WHEN plane AND m >= 100 THEN 'plane' WHEN ship THEN 'ship' WHEN m > 60 AND train THEN 'train' WHEN m > 60 AND bus THEN 'coach' ELSE 'none' END AS main FROM v),
b AS (SELECT *, train OR bus OR (ship AND main <> 'ship') AS loc, CASE WHEN main IN ('plane', 'ship') THEN 'rent or ride' ELSE 'walk' END AS fallback FROM a),
c AS (SELECT *, CASE WHEN NOT foot THEN 'own car' WHEN main <> 'none' AND loc THEN 'local' ELSE 'on foot' END AS access, CASE WHEN main = 'none' THEN fallback WHEN rental THEN 'rental' WHEN loc THEN 'local' ELSE fallback END AS egress FROM b)
SELECT k AS p_partkey, main, access, egress, fallback, (CASE main WHEN 'plane' THEN 1 WHEN 'train' THEN 2 WHEN 'coach' THEN 3 WHEN 'ship' THEN 4 ELSE 0 END + 256 * CASE access WHEN 'own car' THEN 0 WHEN 'on foot' THEN 1 ELSE 2 END
 + 65536 * CASE egress WHEN 'walk' THEN 0 WHEN 'local' THEN 1 WHEN 'rental' THEN 2 ELSE 3 END + 16777216 * CASE fallback WHEN 'walk' THEN 0 ELSE 3 END
 + 1099511627776 * (CASE WHEN main <> 'none' THEN 1 ELSE CASE WHEN loc THEN 2 ELSE 0 END + CASE WHEN rental THEN 4 ELSE 0 END END + CASE WHEN plane AND main <> 'plane' THEN 8 ELSE 0 END))::BIGINT AS packed FROM c""",
    "switch_verdicts": """WITH v AS (SELECT p_partkey AS k, p_partkey % 21 / 20 AS r, p_partkey % 19 / 18 AS a, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 50 * 60 END AS c, p_partkey % 40 * 60 - 60 AS o FROM part),
l AS (SELECT *, CASE WHEN r > 0.8751 THEN 2 WHEN r >= 0.699 THEN 1 ELSE 0 END AS lr, CASE WHEN a > 0.8751 THEN 2 WHEN a >= 0.699 THEN 1 ELSE 0 END AS la FROM v)
SELECT k AS p_partkey, CASE WHEN k % 23 = 0 OR k % 5 = 0 OR k % 7 = 0 OR k % 17 = 0 THEN 'unknown' WHEN lr = 2 OR lr > la THEN 'riskier' ELSE 'switch' END AS verdict, o >= 0 AND (c IS NULL OR o + 300 <= c) AS enough, o >= 0 AND (c IS NULL OR o + 900 <= c) AS wins,
 NOT (((k % 11 = 0 OR k % 3 = 0 OR k % 2 <> 0) AND k % 5 = 0) OR ((k % 13 = 0 OR (k % 3 = 1 AND k % 4 <> 0)) AND k % 7 < 3)) AS keeps, round(least(900, greatest(120, k % 300 * 60 * 0.08)), 6)::DOUBLE AS tie,
 concat_ws('|', floor(k * 37.0 / 400)::BIGINT, floor(k * 11.0 / 45)::BIGINT) AS key FROM l""",
    "readouts": """WITH v AS (SELECT p_partkey AS k, p_partkey * 13.7::DOUBLE AS m, p_partkey * 13.7::DOUBLE / 1609.344 AS mi, round(p_partkey * 97.0::DOUBLE / 60)::BIGINT AS mins FROM part)
SELECT k AS p_partkey, CASE WHEN mi < 0.19 THEN greatest(50, round(m / 0.3048 / 50) * 50)::BIGINT END AS feet, round(CASE WHEN mi < 10 THEN round(mi * 10) / 10 ELSE round(mi) END, 6)::DOUBLE AS miles,
 CASE WHEN mins >= 2880 THEN printf('%.1f d', k * 97.0::DOUBLE / 86400) WHEN mins >= 90 THEN printf('%d h %d min', mins // 60, mins % 60) ELSE printf('%d min', mins) END AS clock, round(k % 83 / 82 * 100)::BIGINT AS percent,
 least(150000, greatest(5000, k % 60 * 1800))::DOUBLE AS ahead, CASE WHEN k % 60 > 20 THEN 120 WHEN k % 60 > 3 THEN 180 ELSE 300 END::DOUBLE AS cadence FROM v""",
    "link_tiers": """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'offline' WHEN p_partkey % 9 = 0 THEN 'strong' WHEN p_partkey % 6 IN (0, 1) THEN 'strong' WHEN p_partkey % 6 IN (2, 3) THEN 'weak' ELSE 'fair' END AS signal,
 CASE WHEN p_partkey % 10 <= 2 OR p_partkey % 8 < 3 THEN 'low' WHEN p_partkey % 10 <= 4 OR p_partkey % 8 < 4.5 THEN 'standard' ELSE 'high' END AS device,
 CASE WHEN p_partkey % 12 = 0 THEN true WHEN p_partkey % 12 * 100 + p_partkey % 28 + 1 <= p_partkey % 11 * 100 + 101 THEN p_partkey % 13 * 90 + 101 BETWEEN p_partkey % 12 * 100 + p_partkey % 28 + 1 AND p_partkey % 11 * 100 + 101
 ELSE p_partkey % 13 * 90 + 101 >= p_partkey % 12 * 100 + p_partkey % 28 + 1 OR p_partkey % 13 * 90 + 101 <= p_partkey % 11 * 100 + 101 END AS season FROM part""",
    "itineraries": """WITH g AS (SELECT l_orderkey AS k, count(*) AS n, max(l_quantity) AS q, bool_and(l_partkey % 7 <> 0) AS whole, min(CASE WHEN l_suppkey % 9 = 0 THEN 'CAD' ELSE 'USD' END) AS c1, max(CASE WHEN l_suppkey % 9 = 0 THEN 'CAD' ELSE 'USD' END) AS c2,
 sum((l_quantity * 100)::BIGINT) AS cents, bool_or(l_linenumber = 2) AS two FROM lineitem GROUP BY l_orderkey)
SELECT k AS l_orderkey, CASE WHEN whole AND c1 = c2 THEN cents::BIGINT END AS cents, CASE WHEN whole AND c1 = c2 THEN c1 END AS currency, CASE WHEN whole AND c1 = c2 THEN two END AS at_least, k % 5000 + 300 * (n - 1) AS cost,
 CASE WHEN k % 60 >= q THEN (CASE WHEN k % 3 <> 0 THEN 60 ELSE 0 END + k % 60 - q + CASE WHEN k % 4 <> 0 THEN 30 ELSE 0 END)::DOUBLE END AS door FROM g""",
    "alert_actions": f"""WITH v AS (SELECT event_id AS i, {_NAMES}[event_id % 14 + 1] AS name, lower({_NAMES}[event_id % 14 + 1]) AS n, CASE WHEN event_id % 29 <> 0 THEN value / 100 END AS s, CASE WHEN event_id % 3 <> 0 THEN event_id % 240 * 60 - 60 END AS t FROM events),
r AS (SELECT *, {_FAMILY} AS fam FROM v), q AS (SELECT *, CASE WHEN {_LOOKOUT} THEN 0 WHEN {_LIFE} THEN 3 WHEN fam IN ('storm', 'qpf_flood', 'seismic') OR coalesce(s, 0) > 0.8751 THEN 2 WHEN fam IS NOT NULL OR coalesce(s, 0) >= 0.398 THEN 1 ELSE 0 END AS rank FROM r)
SELECT i AS event_id, CASE WHEN {_LOOKOUT} THEN 'lookout' WHEN {_LIFE} OR coalesce(s, 0) > 0.8751 THEN 'shelter' WHEN s >= 0.6 AND t > 0 AND t <= 7200 THEN 'rest area' ELSE 'monitor' END AS action, rank::INTEGER AS rank,
 CASE WHEN rank = 2 AND fam IN ('precip', 'heat', 'winter', 'convective', 'air', 'wind') THEN 1 ELSE rank END::INTEGER AS tier, NOT (n LIKE '%warning%' OR n LIKE '%emergency%') OR i % 2 = 0 AS same,
 CASE WHEN i % 4 / 4 - 0.25 >= 0 AND i % 5 <> 0 AND s IS NOT NULL THEN CASE WHEN s + 0.1 > 0.8751 AND (s + 0.1 > i % 6 / 6 + 0.05 OR i % 7 = 0) THEN 'acute' WHEN s >= 0.699 AND s > i % 4 / 4 - 0.25 + 0.12 AND s > i % 6 / 6 + 0.05 THEN 'sustained' END END AS escalation FROM q""",
    "alert_hours": f"""WITH v AS (SELECT event_id AS i, lower({_NAMES}[event_id % 14 + 1]) AS n, CASE WHEN event_id % 6 <> 0 THEN value / 100 END AS s FROM events), u AS (SELECT *, {_HOURS}::DOUBLE AS h FROM v),
l AS (SELECT *, CASE WHEN i % 250 = 0 THEN h ELSE least(h * 3, greatest(h * 0.5, exp((20 * ln(h) + least(i % 250, 180) * (i % 9 - 2.0)) / (20 + least(i % 250, 180))))) END AS learned FROM u)
SELECT i AS event_id, {_KIND} AS kind, round(learned, 9) AS learned, round(least(168.0, greatest(0.5, learned * CASE WHEN s IS NULL THEN 1 ELSE 0.5 + least(1, greatest(0, s)) END * (1 + 0.15 * floor(log2(least(16, greatest(1, i % 20)))))
 * [1.25, 1.0, 0.75, 0.5][i % 4 + 1])), 9)::DOUBLE AS hours FROM l""",
    "climate_norms": f"""WITH {_CLIMATE}, n AS (SELECT *, (1 - cos(2 * pi() * ((k % 60 - 5 + 52) % 52) / 52)) / 2 AS ph FROM c JOIN t USING (kind)), m AS (SELECT *, wl + (sl - wl) * ph AS low, wh + (sh - wh) * ph AS high FROM n)
SELECT k AS c_custkey, round(low, 6)::DOUBLE AS low, round(high, 6)::DOUBLE AS high, k % 130 - 20 > high + 12 OR k % 130 - 20 < low - 12 AS odd_temperature, k % 40 > wm + 2 * ws AS odd_wind FROM m""",
    "forecast_scores": f"""WITH {_CLIMATE}, r AS (SELECT *, CASE WHEN k % 7 <> 0 THEN k % 140 - 20 END AS x, CASE WHEN k % 5 <> 0 THEN k % 70 END AS wi, CASE WHEN k % 6 <> 0 THEN k % 101 END AS po FROM c JOIN t USING (kind)),
s AS (SELECT *, CASE WHEN x < cl THEN least(1, (cl - x) / (cl - rl)) WHEN x > ch THEN least(1, (x - ch) / (rh - ch)) ELSE 0 END AS te, {_line('wi', 15.0, 28.0, 45.0)} AS w, {_line('po', 25.0, 50.0, 75.0)} AS p, coalesce(x, 70) AS f FROM r)
SELECT k AS c_custkey, round(least(1, 0.45 * te + 0.3 * w + 0.25 * p), 6)::DOUBLE AS score, round(w, 6)::DOUBLE AS wind, round(p, 6)::DOUBLE AS precip, round(CASE WHEN f > ch THEN te ELSE 0 END, 6)::DOUBLE AS heat, round(CASE WHEN f < cl THEN te ELSE 0 END, 6)::DOUBLE AS cold,
 round(CASE WHEN f <= 34 THEN least(1, 0.2 * w + 0.8 * p) ELSE 0 END, 6)::DOUBLE AS winter, round(CASE WHEN f > 60 THEN least(1, 0.6 * p + 0.4 * w) ELSE 0.3 * p END, 6)::DOUBLE AS convective FROM s""",
    "family_priors": f"""WITH p AS (SELECT c_custkey AS k, {place_sql('c_custkey')}, c_custkey % 52 AS w, cos(2 * pi() * (c_custkey % 52) / 52) AS y FROM customer),
a AS (SELECT *, greatest(y, 0) AS wi, greatest(-y, 0) AS su, CASE WHEN w BETWEEN 32 AND 44 THEN sin(pi() * (w - 32) / 12) * greatest({_box('lat', 24.0, 32.0, 2.0)} * {_box('lon', -98.5, -80.0, 2.0)}, {_box('lat', 24.0, 36.5, 2.5)} * {_ramp('lon', -83.5, -80.5)}) ELSE 0 END AS tr
 FROM p WHERE lat BETWEEN 24 AND 50 AND lon BETWEEN -125 AND -66),
b AS (SELECT k, unnest(['winter', 'cold', 'convective', 'heat', 'wind', 'qpf_flood']) AS family, unnest([0.55 * wi * {_ramp('lat', 30.0, 47.0)}, 0.5 * wi * {_ramp('lat', 35.0, 48.0)},
 0.45 * CASE WHEN w BETWEEN 10 AND 38 THEN sin(pi() * (w - 10) / 28) ELSE 0 END * {_box('lon', -105.0, -78.0, 5.0)} * {_box('lat', 26.0, 47.0, 5.0)}, 0.55 * su * least(1, {_box('lon', -120.0, -103.0, 3.0)} * {_box('lat', 29.0, 38.5, 2.5)} + 0.45 * (1 - {_ramp('lat', 30.0, 38.0)})),
 0.3 * {_box('lon', -105.5, -94.0, 3.0)} * {_box('lat', 27.0, 49.5, 3.0)} + 0.35 * tr, 0.15 * (1 - {_ramp('lat', 30.0, 36.0)}) * {_ramp('lon', -100.0, -92.0)} + 0.45 * tr]) AS raw FROM a)
SELECT k AS c_custkey, family, round(least(0.6, raw), 6)::DOUBLE AS prior FROM b WHERE raw >= 0.05""",
    "band_comforts": """WITH p AS (SELECT c_custkey AS k, least(70.0, greatest(14.0, 10 + c_custkey % 650 / 10)) AS lat, CASE WHEN c_custkey % 3 <> 0 THEN least(1, greatest(-1, round((c_custkey * 31 % 700 - 300) / 85.47))) ELSE 0 END AS sh FROM customer),
x AS (SELECT k, sh, (lat - 42.312985) / ((47.080621 - 42.312985) / 10) AS x FROM p), b AS (SELECT k, least(59, greatest(-59, CASE WHEN x <= 0 THEN floor(x) + 1 ELSE ceil(x - 1e-9) END + sh))::BIGINT AS band FROM x),
l AS (SELECT *, least(72.0, greatest(-10.0, 61 - band)) AS low, band - 1 AS s FROM b), h AS (SELECT *, least(92.0, greatest(low + 10, 76 - s)) AS high FROM l)
SELECT k AS c_custkey, band, low::DOUBLE AS low, high::DOUBLE AS high, least(45.0, greatest(-80.0, -28 - s))::DOUBLE AS record_low, least(125.0, greatest(high + 10, 108 - s))::DOUBLE AS record_high FROM h""",
}
QUERIES = {name: globals()[name] for name in SQL}
