import pytest
from pyspark.sql import functions as F

from hazgrid.functions import clock, families, geo, scoring, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize("score, band", [(0.397, "Transparent"), (0.398, "Green"), (0.698, "Green"), (0.699, "Yellow"), (0.8751, "Yellow"), (0.8752, "Red"), (float("nan"), "Transparent"), (float("inf"), "Transparent"), (None, "Transparent")])
def test_bands(spark, score, band):
    assert one(spark, scoring.risk_band(lit(score))) == band


@pytest.mark.parametrize("value, score", [(float("nan"), 0), (float("inf"), 0), (-5.0, 0), (25.0, 0), (75.0, 0.699), (150.0, 0.8751), (1e9, 1)])
def test_piecewise(spark, value, score):
    assert one(spark, scoring.piecewise_score(lit(value), 25, 75, 150)) == pytest.approx(score)


@pytest.mark.parametrize("t, risk", [(70.0, 0), (float("nan"), 0), (60.0, 0), (30.0, 0.5), (95.0, 0.5), (-50.0, 1), (200.0, 1)])
def test_temperature(spark, t, risk):
    assert one(spark, scoring.temperature_risk(lit(t), 60, 80, 0, 110)) == pytest.approx(risk)


def test_two_tiers(spark):
    rows = spark.createDataFrame([("storm", 0.5), ("wind", 0.5), ("other", 1.0), ("air", None)], "family string, score double")
    p, q = 0.5, 0.64 * 0.5
    assert rows.agg(families.realized_risk(F.col("family"), F.col("score")).alias("r")).first()["r"] == pytest.approx(p * (1 + (1 - p) * q))
    only = rows.where("family = 'wind'").agg(families.realized_risk(F.col("family"), F.lit(1.0)).alias("r")).first()["r"]
    assert only == pytest.approx(0.64)
    assert rows.limit(0).agg(families.realized_risk(F.col("family"), F.col("score")).alias("r")).first()["r"] == 0


def test_dominant_family_ties_by_name(spark):
    rows = spark.createDataFrame([("wind", 0.5), ("air", 0.5), ("storm", 0.45)], "family string, score double")
    assert rows.agg(families.dominant_family(F.col("family"), F.col("score"), F.lit(False)).alias("d")).first()["d"] == "air"


@pytest.mark.parametrize("event, family", [("Fire Weather Watch", "heat"), ("Volcano Advisory", "air"), ("TORNADO WARNING", "storm"), ("Tornado Watch", "convective"), ("", None), (None, None)])
def test_alert_family(spark, event, family):
    assert one(spark, families.alert_family(F.lit(event).cast("string"))) == family


def test_distances(spark):
    assert one(spark, geo.meters(lit(0), lit(0), lit(1), lit(0))) == pytest.approx(111_320)
    assert one(spark, geo.haversine_km(lit(43.07), lit(-89.4), lit(41.88), lit(-87.63))) == pytest.approx(196.8, abs=0.5)
    assert one(spark, geo.heading_delta(lit(350), lit(10))) == pytest.approx(20)
    assert one(spark, geo.segment_distance(lit(0), lit(1), lit(-1), lit(0), lit(1), lit(0))) == pytest.approx(1)
    assert one(spark, geo.segment_distance(lit(3), lit(4), lit(0), lit(0), lit(0), lit(0))) == pytest.approx(5)


@pytest.mark.parametrize("t, s", [("25:10:05", 90605), (" 8:00:00", 28800), ("08:60:00", None), ("", None), (None, None), ("169:00:00", None)])
def test_service_seconds(spark, t, s):
    assert one(spark, clock.service_seconds(F.lit(t).cast("string"))) == s


@pytest.mark.parametrize("day, week", [("2024-01-01", 0), ("2024-01-08", 1), ("2024-12-31", 51), ("2023-12-31", 51)])
def test_weeks(spark, day, week):
    assert one(spark, clock.week_of_year(F.lit(day).cast("date"))) == week


@pytest.mark.parametrize("tag, metres", [("13'6\"", 4.1148), ("12 ft", 3.6576), ("3.8 m", 3.8), ("3.8", 3.8), ("none", None), (None, None)])
def test_clearance(spark, tag, metres):
    assert one(spark, text.clearance_meters(F.lit(tag).cast("string"))) == (None if metres is None else pytest.approx(metres))


def test_coordinates(spark):
    assert one(spark, text.coordinate(F.lit("43.07, -89.4"))) == (43.07, -89.4)
    assert one(spark, text.coordinate(F.lit("143.07, -89.4"))) is None


def test_polyline(spark):
    points = one(spark, text.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))
    assert [(p["lat"], p["lon"]) for p in points] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert one(spark, text.decode_polyline(F.lit(""))) == []


def test_no_number_scores_nothing(spark):
    from hazgrid.functions import scoring
    from hazgrid.operators import hazards

    nan = float("nan")
    row = spark.range(1).select(scoring.air_score(F.lit(nan)).alias("air"), scoring.uv_score(F.lit(nan)).alias("uv"), scoring.log_score(F.lit(nan), F.lit(2.0)).alias("log"), scoring.air_score(F.lit(75.0)).alias("some")).first()
    assert (row.air, row.uv, row.log) == (0.0, 0.0, 0.0) and abs(row.some - 0.325) < 1e-12
    points = spark.createDataFrame([(1, 40.0, -100.0)], "id long, lat double, lon double")
    feed = spark.createDataFrame([(40.0, -100.0, nan, nan, 1.0, nan), (40.01, -100.0, 50.0, 5.0, nan, 70.0)], "ref_lat double, ref_lon double, frp double, magnitude double, age_hours double, knots double")
    assert 0 < hazards.fire(points, feed, "id").first().score < 1
    assert hazards.fire(points, feed.where("isnan(frp)"), "id").first().score == hazards.seismic(points, feed, "id").first().score == 0
    assert 0 < hazards.tropical(points, feed, "id").first().score < 1
