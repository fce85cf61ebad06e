import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazgrid.operators import graph, habits, nearby, ordered, routes, spatial
from hazgrid.operators.asof import asof
from hazgrid.sources import readers
from hazgrid.streaming import live


def test_nearest_against_all_pairs(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(30, 60), rng.uniform(-100, -80)) for i in range(80)]
    refs = [(i, rng.uniform(30, 60), rng.uniform(-100, -80)) for i in range(60)]
    p, r = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(refs, "ref long, ref_lat double, ref_lon double")
    got = {x.id: x.ref for x in spatial.nearest(p, r, "id", "ref", 250_000.0, 1.0).collect()}

    def metres(a, b):
        return math.hypot((b[1] - a[1]) * 111_320, (b[2] - a[2]) * 111_320 * math.cos(math.radians((a[1] + b[1]) / 2)))

    for a in points:
        best = min(((metres(a, b), b[0]) for b in refs), default=None)
        assert got[a[0]] == (best[1] if best[0] < 250_000 else None)


def test_asof_empty_and_ties(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 2, "b"), (2, 9, "c")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 2, 20.0), (1, 4, 40.0), (2, 9, 90.0)], "k int, t int, v double")
    assert {r["name"]: r.v for r in asof(left, right, "k", "t", ["v"]).collect()} == {"a": 40.0, "b": None, "c": None}
    assert {r["name"]: r.v for r in asof(left, right, "k", "t", ["v"], strict=False).collect()} == {"a": 40.0, "b": 20.0, "c": 90.0}
    assert asof(left.limit(0), right, "k", "t", ["v"]).count() == 0


@pytest.mark.parametrize("width", [None, 7.0, 1000.0])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("forward", [True, False])
def test_asof_blocks(spark, width, strict, forward):
    """Blocks of time change nothing, whatever their width, also for a key with all rows."""
    rng = random.Random(5)
    left = [(i, rng.choice([None, 1, 1, 1, 2]), rng.uniform(-50, 50) if i % 3 else float(rng.randint(-50, 50)), rng.randint(0, 3)) for i in range(150)]
    right = {(rng.choice([None, 1, 1, 3]), float(rng.randint(-60, 60)), rng.randint(0, 3)) for _ in range(60)}
    a = spark.createDataFrame(left, "id long, k long, t double, u long")
    b = spark.createDataFrame([(*r, f"{r}") for r in right], "k long, t double, u long, v string")

    def near(k, at):
        some = [r for r in right if r[0] == k and ((r[1:] > at if forward else r[1:] < at) or not strict and r[1:] == at)]
        return str((min if forward else max)(some, key=lambda r: r[1:])) if some else None

    got = {r.id: r.v for r in asof(a, b, "k", ["t", "u"], ["v"], strict=strict, width=width, forward=forward).collect()}
    assert got == {i: near(k, (t, u)) for i, k, t, u in left}


@pytest.mark.parametrize("kind", ["scattered", "clustered", "one", "none"])
def test_nearest_anywhere(spark, kind):
    rng = random.Random(9)
    points = [(i, rng.uniform(-85, 85), rng.uniform(-179, 179), i % 3) for i in range(250)] + [(900, None, 1.0, 0), (901, 0.0, 0.0, None)]
    if kind == "clustered":  # all refs in a few dense spots, far from most points
        refs = [(j, 40 + rng.gauss(0, 0.05), -100 + 60 * (j % 3) + rng.gauss(0, 0.05), j % 2) for j in range(400)]
    else:
        refs = [(j, rng.uniform(-60, 70), rng.uniform(-179, 179), j % 2) for j in range({"scattered": 300, "one": 1, "none": 0}[kind])]
    refs += [(j + 1000, y, x, g) for j, y, x, g in refs[:20]] + [(999, None, None, 0)]
    p, r = spark.createDataFrame(points, "id long, lat double, lon double, g long"), spark.createDataFrame(refs, "ref long, ref_lat double, ref_lon double, g long")

    def metres(a, b):
        dy, dx = (b[1] - a[1]) * 111_320.0, (b[2] - a[2]) * 111_320.0 * math.cos(math.radians((a[1] + b[1]) / 2))
        return math.sqrt(dx * dx + dy * dy)

    for on in ((), ("g",)):
        got = {x.id: (x.ref, x.meters) for x in nearby.nearest_anywhere(p, r, "id", "ref", 0.5, on=on).collect()}
        assert got.keys() == {a[0] for a in points}
        for a in points:
            some = [(metres(a, b), b[0]) for b in refs if a[1] is not None and b[1] is not None and (not on or a[3] is not None and a[3] == b[3])]
            if not some:
                assert got[a[0]] == (None, None)
            else:
                d, ref = min(some)
                assert got[a[0]][1] == pytest.approx(d, rel=1e-12) and (got[a[0]][0] == ref or metres(a, next(b for b in refs if b[0] == got[a[0]][0])) == pytest.approx(d, rel=1e-12))


def test_many_fixes_of_one_route(spark):
    """100,000 fixes and vertices of one route: no plan joins on the route alone, and no result needs all pairs."""
    n = 100_000
    i = F.col("id")
    vertices = spark.range(n).select(F.lit(1).alias("route"), i.alias("seq"), (40 + i * 1e-4).alias("lat"), F.lit(-90.0).alias("lon"))
    fixes = spark.range(n).select(i.alias("fix"), F.lit(1).alias("route"), F.when(i % 2 == 0, i).otherwise(0).alias("last"), (40 + i * 1e-4 + 3e-5).alias("fix_lat"), F.lit(-90.0).alias("fix_lon"))
    matched = routes.match_fixes(vertices, fixes)
    assert matched.where("fix > 150 and (seq <> fix or metres > 4)").count() == 0 and matched.count() == n
    marks = spark.range(n).select(i.alias("mark"), F.lit(1).alias("route"), i.alias("from_seq"), (i % 1000 * 11.132).alias("metres"))
    ahead = routes.vertex_ahead(vertices, marks, width=50_000.0)
    assert ahead.where(F.abs(F.col("seq") - F.least(F.lit(n - 1), F.col("mark") + F.col("mark") % 1000)) > 1).count() == 0
    profile = spark.range(n).select(F.lit(1).alias("route"), (i * 2).alias("start_mile"), (i * 2 + 2).alias("end_mile"), F.when(i % 10 == 0, 8.0).otherwise(1.0).alias("grade"))
    at = spark.range(n).select(i.alias("mark"), F.lit(1).alias("route"), (i * 2 + 1).alias("mile"))
    steep = {r.mark: r.start_mile for r in routes.next_steep(profile, at, 6.0, 1000, width=5000.0).collect()}
    assert steep == {k: (-(-k // 10) * 10) * 2 for k in range(n) if -(-k // 10) * 10 < n}
    assert routes.grades_at(profile, at, width=5000.0).where("grade <> if(mark % 10 = 0, 8.0, 1.0)").count() == 0
    steps = spark.range(n // 100).select(F.lit(1).alias("route"), i.alias("step"), (i * 100 + 99).alias("end_seq"))
    here = spark.range(n).select(i.alias("fix"), F.lit(1).alias("route"), i.alias("seq"), F.lit(0).cast("long").alias("step"))
    found = routes.progress(vertices, steps, here, width=7000.0)
    assert found.where(F.col("step") != F.least(F.floor((F.col("fix") + 1) / 100), F.lit(n // 100 - 1))).count() == 0 and found.count() == n


def test_folds_of_one_key(spark):
    n = 60_000
    i = F.col("id")
    times = spark.range(n).select(F.lit(7).alias("k"), (i % 50_000).alias("t"))
    assert [r.t for r in habits.throttled(times, "k", "t", 13.0).orderBy("t").collect()] == [float(t) for t in range(0, 50_000, 13)]
    trail = spark.range(n).select((i % 2).alias("k"), i.alias("o"), (40 + F.floor(i / 2) * 1e-4).alias("y"), F.lit(-90.0).alias("x"))
    got = [r.o for r in habits.spaced(trail, "k", "o", "y", "x", 100.0).where("k = 0").orderBy("o").collect()]
    assert got == list(range(0, n, 18))
    stations = spark.range(n).select(F.lit(1).alias("k"), i.alias("s"), (i * 1.0).alias("miles"), F.when(i > 10, 3 + (i * 7919 % 1000) / 1000).alias("price"))
    assert tuple(habits.reachable(stations, "k", "s", F.lit(20.0)).first())[:3] == (1, 21, "none")
    assert habits.reachable(stations, "k", "s", F.lit(5.0)).first().cheapest == 0


def test_spans(spark):
    df = spark.createDataFrame([(1, i, i in (2, 3, 6)) for i in range(8)], "p int, i int, off boolean")
    assert sorted((r["first"], r["last"], r.n_rows) for r in ordered.spans(df, ["p"], ["i"], F.col("off")).collect()) == [(2, 3, 2), (6, 6, 1)]


def test_shortest_paths_and_components(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (7, 8, 1.0)], "src long, dst long, w double")
    assert {r.node: r.dist for r in graph.shortest_paths(edges, 1).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_long_chains_are_whole(spark):
    import pytest

    n = 70
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, w double")
    assert {r.node: r.dist for r in graph.shortest_paths(chain, 0).collect()} == {i: float(i) for i in range(n + 1)}
    with pytest.raises(RuntimeError):
        graph.shortest_paths(chain, 0, rounds=5)
    with pytest.raises(ValueError):
        graph.shortest_paths(chain.withColumn("w", -F.col("w")), 0)
    odd = spark.createDataFrame([(500, 500), (None, 501)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(chain.select("src", "dst").unionByName(odd)).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500, 501: 501, None: None}


def test_query_distances_against_all_pairs(spark):

    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(70)] + [(70, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.a, r.b): r.distance for r in spatial.query_distances(df, "id", "v", F.col("id") % 7 == 0, 4).collect()}
    assert got.keys() == {(a, b) for a in range(0, 71, 7) for b in range(71) if a != b}
    assert all(d is None if 70 in (a, b) else math.isclose(d, math.dist(rows[a][1], rows[b][1]), abs_tol=1e-5) for (a, b), d in got.items())
    assert spatial.query_distances(df.limit(0), "id", "v", F.col("id") % 7 == 0).count() == 0


def test_query_distances_rounded(spark, monkeypatch):
    """Products of matrices give the digits that terms give, also next to a border, for copies, nulls and what is not finite; and
    few pairs are summed term by term."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype("float32")
    x[40:50] = x[:10]
    x[50:, 1:] = x[:10, 1:]
    x[50:, 0] = x[:10, 0] + np.arange(10) / 8 + 0.5  # the distance is a border at no digits
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x)] + [(60, None), (61, [math.inf] * 8), (62, [None] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    for digits in (0, 4):
        got = {(r.a, r.b): r.distance for r in spatial.query_distances(df, "id", "v", F.col("id") % 7 == 0, 16, digits=digits).collect()}
        exact = {(r.a, r.b): r.distance for r in spatial.query_distances(df, "id", "v", F.col("id") % 7 == 0, 16).collect()}
        half = lambda v: v if v is None or math.isinf(v) else math.floor(v * 10**digits + 0.5) / 10**digits
        assert len(got) == 9 * 62 and got == {k: half(v) for k, v in exact.items()}
    nulls = spatial.query_distances(spark.createDataFrame([(0, None), (1, None), (2, [])], df.schema), "id", "v", F.col("id") == 0, digits=4)
    assert sorted(map(tuple, nulls.collect())) == [(0, 1, None), (0, 2, None)]
    summed, terms = [], spatial._terms
    monkeypatch.setattr(spatial, "_terms", lambda a, b: summed.append(len(a)) or terms(a, b))
    spatial._rounded(rng.normal(size=(64, 64)), rng.normal(size=(1024, 64)), 4)
    assert sum(summed) < 100


def test_journeys_are_read_back_with_walks(spark):
    from hazgrid.operators import raptor

    events = spark.createDataFrame([(1, 0, 1, 10, 10), (1, 1, 2, 20, 20), (2, 0, 5, 40, 40), (2, 1, 3, 50, 50), (3, 0, 1, 0, 0), (3, 1, 3, 90, 90)], "trip long, seq long, stop long, arrive long, depart long")
    walks = spark.createDataFrame([(2, 5, 12), (1, 9, 4)], "from_stop long, to_stop long, seconds long")
    found = raptor.arrivals(events, 1, 0, walks=walks, change=5).cache()
    assert sorted((r.stop, r.round, r.arrival) for r in found.collect()) == [(1, 0, 0), (2, 1, 20), (3, 1, 90), (3, 2, 50), (5, 1, 32), (9, 0, 4)]
    legs = sorted((r.round, r.leg, r.trip, r.board_stop, r.off_stop, r.stop) for r in raptor.journeys(found, spark.createDataFrame([(3,)], "target long")).collect())
    assert legs == [(1, 1, 3, 1, 3, 3), (2, 1, 1, 1, 2, 5), (2, 2, 2, 5, 3, 3)]
    assert raptor.arrivals(events, 1, 0, walks=walks, change=9).where("stop = 3 and round = 2").isEmpty()


def test_whole_timetable_has_each_order_and_four_boardings(spark, tmp_path):
    from hazgrid.plans import joins

    # Four orders lead from stop 7 over 10, 20 and 30 to 40; none is a multiple of ten.
    lines = [(trip, stop, seq) for trip, calls in ((61, (7, 10)), (81, (10, 20)), (101, (20, 30)), (1301, (30, 40))) for seq, stop in enumerate(calls, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.stop: (r.round, r.arrival) for r in joins.raptor_frontier(spark, str(tmp_path)).collect()}
    assert {s: n for s, (n, _) in got.items()} == {7: 0, 10: 1, 20: 2, 30: 3, 40: 4} and got[40] == (4, 1301 * 60 + 1200)


def test_whole_sssp_against_dijkstra(spark, tmp_path):
    import heapq

    from hazgrid.plans import joins

    rng = random.Random(3)
    # Parts stand for suppliers of the same key: a chain of 65 hops, and side ways that never shorten it much.
    lines = [(i, i + 1, 1.0) for i in range(1, 66)] + [(rng.randint(1, 66), rng.randint(1, 90), float(rng.randint(20, 50))) for _ in range(60)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    best, queue = {}, [(0.0, 1)]
    while queue:
        d, node = heapq.heappop(queue)
        if node not in best:
            best[node] = d
            for src, dst, w in lines:
                if src == node and src != dst:
                    heapq.heappush(queue, (d + w, dst))
    assert len(best) >= 66
    assert {r.node: r.dist for r in joins.sssp(spark, str(tmp_path)).collect()} == best


def test_transit_files(spark, tmp_path):
    (tmp_path / "stop_times.txt").write_text("﻿trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,08:00:00,08:00:00,a,1\nt,,,b,2\nt,08:10:00,08:10:00,c,3\n")
    (tmp_path / "calendar.txt").write_text("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20240101,20241231\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date,exception_type\nwk,20240704,2\nsat,20240704,1\n")
    times = {r.stop_id: r.arrive for r in readers.stop_events(readers.gtfs(spark, str(tmp_path), "stop_times")).collect()}
    assert times == {"a": 28800, "b": 29100, "c": 29400}
    assert readers.gtfs(spark, str(tmp_path), "frequencies").count() == 0
    active = lambda day: {r.service_id for r in readers.active_services(readers.gtfs(spark, str(tmp_path), "calendar"), readers.gtfs(spark, str(tmp_path), "calendar_dates"), day).collect()}
    assert active("20240703") == {"wk"} and active("20240704") == {"sat"} and active("20240706") == set()


def test_storm_events_and_gazetteer(spark, tmp_path):
    (tmp_path / "storms.csv").write_text('BEGIN_YEARMONTH,BEGIN_DAY,EVENT_TYPE,CZ_NAME,MAGNITUDE\n202405,3,Hail,"DANE\nCOUNTY",2.0\n202413,1,Wind,X,\n')
    rows = readers.storm_events(spark, str(tmp_path / "storms.csv")).collect()
    assert [(r.EVENT_TYPE, r.MAGNITUDE) for r in rows] == [("Hail", 2.0)]
    (tmp_path / "gaz.tsv").write_text("GEOID\tINTPTLAT\tINTPTLONG   \n53703\t43.07\t-89.38  \n53703\t43.08\t-89.38\nbad\t1\t2\n")
    assert [(r.zip, r.lat) for r in readers.gazetteer(spark, str(tmp_path / "gaz.tsv")).collect()] == [("53703", 43.07)]


def test_streamed_sessions_and_state(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 2.0, "x"), (1, "2024-01-01 00:10:00", 4.0, "x"), (1, "2024-01-05 00:00:00", 1.0, "x")], "user_id long, ts string, value double, event_type string")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.sessions(stream).writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.user_id, r.n, r.value) for r in spark.table("closed").collect()] == [(1, 2, 6.0)]
    q = live.decayed_state(stream, half_life=1e12).writeStream.format("memory").queryName("state").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    (row,) = spark.table("state").collect()
    assert abs(row.weight - 3) < 1e-5 and abs(row["mean"] - 7 / 3) < 1e-5
