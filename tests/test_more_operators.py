import math

import pytest
from pyspark.sql import functions as F

from hazgrid.functions import climate, events, levels
from hazgrid.operators import clusters, corridor, hazards, merge, transit, trips


def test_eta_fold_against_a_loop(spark):
    actual = [550.0, 480.0, 30.0, 900.0, 610.0, 520.0, 2000.0, 530.0, 560.0]
    rows = spark.createDataFrame([(1, i, a, 500.0) for i, a in enumerate(actual)], "k long, t int, actual double, predicted double")
    h = trips.history(rows, "k", ["t"], 200, "actual", "predicted")
    got = h.select(trips.eta_state(F.col("history"), "predicted", "actual").alias("s")).select("s.*", trips.eta_multiplier(F.col("s")).alias("m")).first()
    log_ratio, n = 0.0, 0
    for a in actual:
        if a > 60 and 0.6 <= a / 500 <= 1.8:
            n += 1
            alpha = max(1 / n, 0.08)
            log_ratio = log_ratio * (1 - alpha) + math.log(a / 500) * alpha
    assert got.samples == n and got.log_ratio == pytest.approx(log_ratio) and got.m == pytest.approx(min(1.4, max(0.75, math.exp(log_ratio))))


def test_wait_needs_three_samples(spark):
    rows = spark.createDataFrame([(1, 0, 10.0), (1, 1, 20.0), (1, 2, 500.0), (2, 0, 10.0), (2, 1, 20.0), (2, 2, 30.0)], "k long, t int, w double")
    h = trips.history(rows, "k", ["t"], 50, "w")
    got = {r.k: r.m for r in h.select("k", trips.wait_mean(F.col("history"), "w", 7.0).alias("m")).collect()}
    assert got[1] == 7.0 and got[2] == pytest.approx(10 + 0.35 * 10 + 0.35 * (30 - 13.5))


def test_registered_averages_fold_every_event(spark, tmp_path):
    import datetime
    import random

    from hazgrid.plans import trips as plans

    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 1, None, 2]), rng.uniform(5, 100)) for i in range(600)]
    rows += [(600 + i, 3, 55.0 + i) for i in range(12)] + [(620 + i, 3, 500.0) for i in range(300)] + [(1000, 4, 900.0)]  # 3: old usable rows only; 4: none
    start = datetime.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(i, u, start + datetime.timedelta(minutes=i // 3 * 17), v) for i, u, v in rows], "event_id long, user_id long, ts timestamp, value double")
    frame.orderBy(F.rand(5)).write.parquet(str(tmp_path / "events.parquet"))
    eta, wait = {}, {}
    for _, u, v in rows:
        log_ratio, n = eta.setdefault(u, (0.0, 0))
        if v * 10 > 60 and 0.6 <= v / 50 <= 1.8:
            alpha = max(1 / (n + 1), 0.08)
            eta[u] = (log_ratio * (1 - alpha) + math.log(v / 50) * alpha, n + 1)
        mean, n = wait.setdefault(u, (None, 0))
        if 1 <= v <= 180:
            wait[u] = (v if n == 0 else mean + 0.35 * (v - mean), n + 1)
    got = {r.user_id: r for r in plans.eta_multipliers(spark, str(tmp_path)).collect()}
    assert {u: (r.samples, r.log_ratio) for u, r in got.items()} == {u: (n, pytest.approx(x, abs=2e-6)) for u, (x, n) in eta.items()}
    assert eta[1][1] > 200 and got[3].multiplier != 1.0 and got[4].multiplier == 1.0
    assert {r.user_id: r.wait for r in plans.wait_means(spark, str(tmp_path)).collect()} == {u: pytest.approx(m if n >= 3 else 12.0, abs=2e-6) for u, (m, n) in wait.items()}


def test_clusters_declutter_and_hull(spark):
    marks = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 0.9), (1, 2, 0, 0.5, 0.0, 0.1), (1, 3, 1, 0.2, 0.0, 0.5), (1, 4, 0, 3.0, 0.0, 0.4)], "view long, id long, kind long, lat double, lon double, score double")
    got = sorted((r.seed, r.n) for r in clusters.greedy_clusters(marks, "view", 1.0).collect())
    assert got == [(1, 2), (3, 1), (4, 1)]
    assert {r.id for r in clusters.declutter(marks, "view", 1.0).collect()} == {1, 4}
    square = spark.createDataFrame([(1, float(x), float(y)) for x in (0, 1, 2) for y in (0, 1, 2)], "k long, x double, y double")
    assert {(r.x, r.y) for r in clusters.hulls(square, "k").collect()} == {(0, 0), (2, 0), (2, 2), (0, 2)}
    assert clusters.hulls(square.limit(0), "k").count() == 0


def test_only_corners_of_slices_meet_in_a_hull(spark):
    import random

    rng = random.Random(6)
    rows = [(k, float(rng.randint(0, 60)), float(rng.randint(0, 60))) for k in (1, 1, 1, 2) for _ in range(500)]
    points = spark.createDataFrame(rows, "k long, x double, y double")
    whole = sorted(map(tuple, clusters.hulls(points, "k", 1).collect()))
    assert len({r[0] for r in whole}) == 2 and sorted(map(tuple, clusters.hulls(points, "k", 16).collect())) == whole
    plan = clusters.hulls(points, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2


def test_footpaths_and_published_pairs(spark):
    stops = spark.createDataFrame([(1, 0, 43.0, -89.0), (2, 0, 43.003, -89.0), (3, 0, 43.006, -89.0), (4, 1, 43.006, -89.0)], "stop_id long, feed_no int, lat double, lon double")
    got = {(r.from_stop, r.to_stop) for r in transit.footpaths(stops).collect()}
    assert got == {(1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3), (1, 4), (4, 1), (2, 4), (4, 2)}
    published = spark.createDataFrame([(1, 2)], "from_stop long, to_stop long")
    assert (1, 2) not in {(r.from_stop, r.to_stop) for r in transit.footpaths(stops, published).collect()}


def test_fares(spark):
    routes = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "b")], "route_id string, agency_id string")
    fares = spark.createDataFrame([("adult1", 2.0, "USD", "a"), ("adult2", 3.0, "USD", "a"), ("senior", 1.0, "USD", "a"), ("x", 5.0, "USD", "b"), ("y", 6.0, "CAD", "b")], "fare_id string, price double, currency string, agency_id string")
    rules = spark.createDataFrame([("adult2", "r1")], "fare_id string, route_id string")
    got = {r.route_id: (r.price, r.is_from) for r in transit.route_fares(routes, rules, fares).collect()}
    assert got == {"r1": (3.0, False), "r2": (2.0, False), "r3": (None, True)}


def test_registered_fares_see_every_part(spark, tmp_path):
    from hazgrid.plans import trips as plans

    # Part 64 is the only adult fare of agency 4; a rule of part 60 sets the fare of route 0.
    spark.createDataFrame([(0, 0), (4, 4)], "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(59,), (60,), (64,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.route_id: r.price for r in plans.route_fares(spark, str(tmp_path)).collect()}
    assert got == {"0": 60 % 17 + 1.5, "4": 64 % 17 + 1.5}


def test_frequencies_are_half_open(spark):
    stops = spark.createDataFrame([("t", 1, "a", 0, 0), ("t", 2, "b", 60, 60), ("u", 1, "a", 5, 5)], "trip_id string, stop_sequence int, stop_id string, arrive int, depart int")
    f = spark.createDataFrame([("t", 100, 300, 100)], "trip_id string, start int, end int, headway int")
    got = sorted((r.stop_id, r.arrive) for r in transit.expand_frequencies(stops, f).collect())
    assert got == [("a", 5), ("a", 100), ("a", 200), ("b", 160), ("b", 260)]


def test_merges(spark):
    known = spark.createDataFrame([(1, "fire", 43.0, -89.0), (2, "fire", 44.0, -89.0)], "id long, kind string, lat double, lon double")
    new = spark.createDataFrame([(3, "fire", 43.0005, -89.0)], known.schema)
    assert {r.id for r in merge.drop_near_duplicates(known, new, 200.0, 0.01).collect()} == {2, 3}
    assert {r.id for r in merge.unshown(known, new, 200.0, 0.01).collect()} == {2}


def test_perimeter_and_alerts(spark):
    points = spark.createDataFrame([(1, 43.0, -89.0, 10), (2, 43.15, -89.0, 10), (3, 45.0, -89.0, 10)], "id long, lat double, lon double, at int")
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-89.1, 42.9), (-88.9, 42.9), (-88.9, 43.1), (-89.1, 43.1))))
    rings = spark.range(1).select(F.col("id").alias("ring_id"), ring.alias("ring"))
    got = {r.id: r.score for r in hazards.perimeters(points, rings, "id").collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(0.7 * (1 - 0.05 * 111_320 / 12_000), abs=1e-6) and got[3] == 0.0
    listed = spark.createDataFrame([(7, "Severe", 20), (8, "Extreme", 5)], "alert_id int, severity string, expires int")
    alerts = rings.select("ring").crossJoin(listed).withColumn("event", F.lit("Tornado Warning"))
    (row,) = hazards.worst_alert(points, alerts, "id", "at").collect()
    assert (row.id, row.alert_id, row.severity_score) == (1, 7, 0.88)


def test_blend_without_any_input(spark):
    samples = spark.sql("""SELECT 1 AS route, 1 AS ix, CAST(NULL AS STRUCT<wind: DOUBLE, precip: DOUBLE, heat: DOUBLE, cold: DOUBLE, winter: DOUBLE, convective: DOUBLE, elevation_m: DOUBLE, qpf_inches: DOUBLE>) AS forecast,
        CAST(NULL AS STRUCT<wind: DOUBLE, heat: DOUBLE, cold: DOUBLE, air: DOUBLE, radiation: DOUBLE, winter: DOUBLE, convective: DOUBLE, qpf_flood: DOUBLE, environmental: DOUBLE>) AS field,
        0D AS gauge, 0D AS water, CAST(NULL AS MAP<STRING, DOUBLE>) AS live, CAST(NULL AS STRING) AS event, CAST(NULL AS DOUBLE) AS severity, 0D AS closure""")
    row = corridor.summary(corridor.blend(corridor.with_forecasts(samples, ["route"], "ix")), ["route"]).first()
    assert (row["mean"], row.peak, row.coverage, row.unchecked) == (0.0, 0.0, 0.0, True)


def test_small_functions(spark):
    r = spark.range(1).select(
        levels.severity(F.lit("SEVERE")).alias("a"), levels.scale(F.lit(9), levels.AVALANCHE).alias("b"), events.fuel_level(F.lit("41 2f 80")).alias("c"), events.fuel_level(F.lit("NO DATA")).alias("d"),
        events.is_peak(F.lit(480)).alias("e"), climate.solar_elevation(F.lit(1718971200.0), F.lit(0.0), F.lit(0.0)).alias("noon"), trips.is_impact(F.array(F.lit(5.0), F.lit(1.0))).alias("one"),
    ).first()
    assert (r.a, r.b, r.d, r.e, r.one) == (0.88, 1.0, None, True, False)
    assert r.c == pytest.approx(128 / 255) and r.noon == pytest.approx(66.5, abs=0.7)
