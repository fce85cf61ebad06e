"""Lines, areas, timetables over a span, drives, tuning and words, against plain loops."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazgrid.functions import clock, geo, phrases, roads
from hazgrid.operators import areas, clusters, covers, head, lines, needs, raptor, routes
from hazgrid.sources import dispatch, ferries, readers
from hazgrid.streaming import drives


def metres(a, b):
    dy, dx = (b[0] - a[0]) * 111_320.0, (b[1] - a[1]) * 111_320.0 * math.cos(math.radians((a[0] + b[0]) / 2))
    return math.hypot(dx, dy)


# -- lines


def along_if_near(line, p, reach):
    """Metres along ``line`` of its place nearest to ``p``, if within reach."""
    k, best, total = 111_320.0 * math.cos(math.radians(p[0])), None, 0.0
    for a, b in zip(line, line[1:], strict=False):
        bx, by, px, py = (b[1] - a[1]) * k, (b[0] - a[0]) * 111_320.0, (p[1] - a[1]) * k, (p[0] - a[0]) * 111_320.0
        length2 = bx * bx + by * by
        t = min(max((px * bx + py * by) / length2, 0), 1) if length2 else 0.0
        off = math.hypot(px - t * bx, py - t * by)
        if off <= reach and (best is None or off < best[0]):
            best = (off, total + t * metres(a, b))
        total += metres(a, b)
    return best and best[1]


def brute_along(route, way, reach, directed):
    """One walk along the way, stretch by stretch."""
    if len(way) < 2 or len(route) < 2:
        return False
    walk, length = [(way[0], 0.0)], 0.0
    for a, b in zip(way, way[1:], strict=False):
        hop = metres(a, b)
        n = min(max(math.ceil(hop / 10), 1), 2000)
        walk += [((a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n), length + hop * k / n) for k in range(1, n + 1)]
        length += hop
    run = None
    for p, on in walk:
        a = along_if_near(route, p, reach)
        if a is None:
            run = None
            continue
        run = (min(run[0], a), max(run[1], a), run[2], run[3]) if run else (a, a, on, a)
        span = run[1] - run[0]
        if span > 0 and span >= min(30, length / 2) and span >= 0.9 * (on - run[2]) and (not directed or a > run[3]):
            return True
    return False


@pytest.fixture(scope="module")
def grid_of_lines():
    """Routes over a town's streets, and ways beside, across and against them."""
    rng = random.Random(8)
    node = lambda: (43 + rng.randint(0, 8) * 0.001, -89 + rng.randint(0, 8) * 0.001)
    routes_ = {i: [node() for _ in range(rng.randint(1, 7))] for i in range(25)}
    ways = {}
    for i in range(40):
        base = routes_[rng.randrange(25)]
        part = base[: rng.randint(1, 4)]
        part = part[::-1] if rng.random() < 0.4 else part
        north, east = rng.choice([0, 5e-5, 1.5e-4, 3e-4]), rng.choice([0, 1e-4])
        ways[i] = [(y + north, x + east) for y, x in part] if rng.random() < 0.7 else [node() for _ in range(rng.randint(1, 3))]
    ways[100], ways[101] = [(43.0, -89.0), (float("nan"), -89.0)], [(43.0, -89.0)]
    return routes_, ways


def test_runs_along(spark, grid_of_lines):
    routes_, ways = grid_of_lines
    v = spark.createDataFrame([(r, i, *p) for r, line in routes_.items() for i, p in enumerate(line)], "route long, seq long, lat double, lon double")
    w = spark.createDataFrame([(k, i, *p, k % 2 == 0) for k, line in ways.items() for i, p in enumerate(line)], "way long, seq long, lat double, lon double, directed boolean")
    sound = {k: line for k, line in ways.items() if not any(math.isnan(y) for y, _ in line)}
    for reach, directed in ((20.0, None), (40.0, F.col("directed"))):
        got = {tuple(r) for r in lines.runs_along(v, w, directed, reach).collect()}
        want = {(r, k) for r, a in routes_.items() for k, b in sound.items() if brute_along(a, b, reach, directed is not None and k % 2 == 0)}
        assert got == want and len(want) > 10
    tags = spark.createDataFrame([(k, {"highway": "primary"} if k % 3 else {"highway": "footway"}) for k in ways], "way long, tags map<string,string>")
    limits = {tuple(r) for r in lines.limits_on_route(v, w.drop("directed"), tags).collect()}
    assert limits == {(r, k) for r, a in routes_.items() for k, b in sound.items() if k % 3 and brute_along(a, b, 20.0, False)}
    assert lines.runs_along(v.limit(0), w).count() == 0 and lines.drives_closures(v, w.limit(0)).count() == 0


def test_posted_limits(spark):
    cases = [({"highway": "primary"}, True), ({}, False), (None, False), ({"highway": "steps"}, False), ({"highway": "service", "service": "driveway"}, False), ({"highway": "track", "access": "private"}, False),
             ({"highway": "road", "access": "permit"}, True), ({"highway": "road", "building": "yes"}, False), ({"highway": "road", "amenity": "parking"}, False), ({"amenity": "parking"}, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t map<string,string>")
    assert {r.i: r.c for r in df.select("i", roads.posted_limit_counts(F.col("t")).alias("c")).collect()} == {i: c for i, (_, c) in enumerate(cases)}


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 7, 50, 1000])
def test_thinned_lines(spark, limit):
    rng = random.Random(6)
    routes_ = {r: [(43 + rng.random() * 0.01, -89 + rng.random() * 0.01) for _ in range(n)] for r, n in ((1, 1), (2, 2), (3, 60), (4, 200))}
    v = spark.createDataFrame([(r, i, *p) for r, line in routes_.items() for i, p in enumerate(line)], "route long, seq long, lat double, lon double")
    want = []
    for r, line in routes_.items():
        kept = [0]
        for i in range(1, len(line)):
            if metres(line[kept[-1]], line[i]) >= 300:
                kept.append(i)
        if metres(line[kept[-1]], line[-1]) > 1:
            kept.append(len(line) - 1)
        if len(kept) > limit:
            kept = [kept[math.floor(k * (len(kept) - 1) / (limit - 1) + 0.5) if limit > 1 else 0] for k in range(limit)]
        want += [(r, k, i) for k, i in enumerate(kept)]
    assert sorted(map(tuple, routes.decimated(v, 300.0, limit).collect())) == sorted(want)


# -- areas


def holds(ring, y, x):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return len(ring) >= 3 and inside


def test_areas_by_cells(spark):
    """Points against rings of many kinds: also with edges on cells' borders, spikes, and rings that cross themselves."""
    rng = random.Random(12)
    rings = {0: [(0, 0), (4, 0), (4, 4), (0, 4)], 1: [(0, 0), (3, 1), (0, 2), (1, 1)], 2: [(0, 0), (4, 4), (4, 0), (0, 4)], 3: [(1, 1), (2, 2)], 4: [], 5: [(0.5, 0.5), (0.6, 0.5), (0.55, 3.9)]}
    rings |= {i: [(rng.uniform(-3, 6), rng.uniform(-3, 6)) for _ in range(rng.randint(3, 9))] for i in range(6, 26)}
    points = [(i, rng.choice([rng.uniform(-3, 6), rng.randint(-3, 6)]) * 1.0, rng.choice([rng.uniform(-3, 6), rng.randint(-3, 6)]) * 1.0) for i in range(700)]
    r = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in rings.items()], "area long, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    want = {(i, k) for i, y, x in points for k, v in rings.items() if holds(v, y, x)}
    for size in (0.5, 1.0, 20.0):
        got = covers.containing(p, r, ["area"], size)
        assert {(g.id, g.area) for g in got.collect()} == want
    cells = covers.ring_cells(r.where("area = 0"), ["area"], 0.5)
    assert cells.where("not border").count() == 36 and cells.where("border").count() > 0
    plan = covers.containing(p, r, ["area"], 0.5).where("id < 0").select("id")._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(ring") + plan.count("exists(ring") <= 1  # only the branch of border cells meets the ring


def test_alerts_own_rings_first(spark):
    ring = lambda x: [{"x": x, "y": 0.0}, {"x": x + 2, "y": 0.0}, {"x": x + 2, "y": 2.0}, {"x": x, "y": 2.0}]
    alerts = [(1, [ring(0.0)], ["z"]), (2, [], ["z", "z", "none"]), (3, None, ["z"]), (4, [ring(0.0)[:2]], ["z"]), (5, [ring(0.0), ring(5.0)], None), (6, [], None)]
    a = spark.createDataFrame(alerts, "alert_id long, rings array<array<struct<x:double,y:double>>>, zones array<string>")
    z = spark.createDataFrame([("z", ring(5.0)), ("z", ring(9.0))], "zone string, ring array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(10, 1.0, 1.0), (11, 1.0, 6.0), (12, 1.0, 10.0), (13, 9.0, 9.0)], "id long, lat double, lon double")
    got = sorted(map(tuple, covers.alerts_covering(p, a, z, "id", 0.7).collect()))
    assert got == [(10, 1), (10, 5), (11, 2), (11, 3), (11, 4), (11, 5), (12, 2), (12, 3), (12, 4)]


def test_merged_areas(spark):
    ring = lambda x, n=0.0: [{"x": x, "y": n}, {"x": x + 1, "y": n}, {"x": x + 1, "y": n + 1}, {"x": x, "y": n + 1}]
    kind = "id long, event string, ring array<struct<x:double,y:double>>, expires double"
    shown = spark.createDataFrame([(1, "a", ring(0.0), 50.0), (2, "a", ring(3.0), 500.0), (3, "a", ring(6.0), None), (4, "b", ring(9.0), 500.0), (5, "b", ring(12.0), None), (6, "c", ring(15.0), 500.0)], kind)
    live = spark.createDataFrame([(21, "a", ring(3.0, 1e-4), 900.0), (22, "a", ring(6.0), None), (23, "z", ring(9.0), 300.0), (24, "z", ring(20.0), 90.0), (25, "c", ring(15.0), 60.0), (26, "a", ring(3.0), 950.0)], kind)
    looked = spark.createDataFrame([(0.5, 9.5), (0.5, 15.5), (0.5, 3.5)], "lat double, lon double")
    got = {(r.id, r.source) for r in areas.merged(shown, live, looked, F.lit(100.0)).collect()}
    # 1 and 24 are over; 4 was looked at and is gone; 5 wasn't; 6 is named by a live shape that is over itself.
    assert got == {(21, "renewed"), (3, "shown"), (5, "shown"), (6, "shown"), (23, "new")}
    assert {r.id for r in areas.merged(shown, live.limit(0), looked.limit(0), F.lit(100.0)).collect()} == {2, 3, 4, 5, 6}


def test_insides_of_rings(spark):
    rng = random.Random(3)
    rings = [[(math.cos(a) * r, math.sin(a) * r) for a, r in sorted((rng.uniform(0, 2 * math.pi), rng.uniform(0.2, 3)) for _ in range(rng.randint(3, 9)))] for _ in range(40)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in v]) for i, v in enumerate(rings)], "i long, ring array<struct<x:double,y:double>>")
    rows = df.select("i", geo.icon_anchor(F.col("ring")).alias("a"), geo.interior_samples(F.col("ring"), 100).alias("s"), geo.interior_samples(F.col("ring"), 3).alias("t"), geo.ring_centroid(F.col("ring")).alias("c")).collect()
    beside = 0
    for r in rows:
        ring = rings[r.i]
        assert len(r.t) == min(3, len(r.s)) and r.s[0] == r.a
        x0, x1, y0, y1 = min(p[0] for p in ring), max(p[0] for p in ring), min(p[1] for p in ring), max(p[1] for p in ring)
        inside = [(x, y) for i in range(4) for j in range(4) if holds(ring, y := y0 + (y1 - y0) * (i + 0.5) / 4, x := x0 + (x1 - x0) * (j + 0.5) / 4)]
        assert [(pytest.approx(x), pytest.approx(y)) for x, y in inside] == [(p.x, p.y) for p in r.s[1:]]
        if y0 < r.c.y < y1:  # else the ring crosses itself, and its centre lies beyond it
            assert holds(ring, r.a.y, r.a.x)
            beside += not holds(ring, r.c.y, r.c.x)
        else:
            assert r.a == r.c
    assert beside > 0


# -- clusters


@pytest.mark.parametrize("least", [0.3, 2.0, 50.0])
def test_clusters_in_rounds(spark, least):
    rng = random.Random(2)
    marks = [(rng.randint(0, 1), i, rng.randint(0, 2), rng.choice([rng.uniform(0, 6), rng.randint(0, 6)]) * 1.0, rng.uniform(0, 6), float(rng.randint(0, 20))) for i in range(250)]
    df = spark.createDataFrame(marks, "view long, id long, kind long, lat double, lon double, score double")
    best, kept = {}, {}
    for view, i, kind, lat, lon, score in sorted(marks, key=lambda m: (-m[5], m[1])):
        near = [s for s in best.get((view, kind), []) if math.hypot(s[1] - lat, s[2] - lon) < least]
        if near:
            near[0][3].append((lat, lon, score))
        else:
            best.setdefault((view, kind), []).append((i, lat, lon, [(lat, lon, score)]))
        if all(math.hypot(y - lat, x - lon) >= least for y, x, _ in kept.get(view, [])):
            kept.setdefault(view, []).append((lat, lon, i))
    want = {(v, s[0], k): (sum(max(w, 1e-4) * y for y, _, w in s[3]) / sum(max(w, 1e-4) for *_, w in s[3]), len(s[3])) for (v, k), seeds in best.items() for s in seeds}
    got = {(r.view, r.seed, r.kind): (r.lat, r.n) for r in clusters.greedy_clusters(df, "view", least).collect()}
    assert got == {k: (pytest.approx(lat), n) for k, (lat, n) in want.items()}
    assert {r.id for r in clusters.declutter(df, "view", least).collect()} == {i for marks_ in kept.values() for *_, i in marks_}
    assert clusters.greedy_clusters(df.limit(0), "view", least).count() == 0


# -- departures over a span


@pytest.mark.parametrize(("walks", "change"), [(False, 0), (True, 7)])
def test_profile_against_each_departure(spark, walks, change):
    """The Pareto set of a window of departures: earliest arrivals by round for every departure alone, and what none beats."""
    rng = random.Random(4)
    events = []
    for trip in range(60):
        at = rng.randint(0, 300)
        for seq, stop in enumerate(rng.sample(range(9), rng.randint(2, 5))):
            events.append((trip, seq, stop, at, at + rng.randint(0, 3)))
            at = events[-1][4] + rng.randint(1, 30)
    foot = [(a, (a * 3 + 2) % 9, 5 + a) for a in range(9) if a != (a * 3 + 2) % 9] if walks else []
    e = spark.createDataFrame(events, "trip long, seq long, stop long, arrive long, depart long")
    w = spark.createDataFrame(foot, "from_stop long, to_stop long, seconds long") if walks else None
    boards = lambda trip: trip % 5 != 0
    by_trip = {}
    for t, s, stop, arrive, depart in events:
        by_trip.setdefault(t, []).append((s, stop, arrive, depart))
    starts = [(0, 0), *((b, secs) for a, b, secs in foot if a == 0)]
    labels = set()
    for d in {depart - secs for t, _, stop, _, depart in events for b, secs in starts if stop == b and boards(t) and 20 <= depart - secs <= 200}:
        reach = {}
        for b, secs in starts:
            reach[b] = min(reach.get(b, math.inf), d + secs)
        labels |= {(b, 0, d, a) for b, a in reach.items()}
        for k in range(1, 4):
            new = {}
            for t, calls in by_trip.items():
                on = False
                for _, stop, arrive, depart in sorted(calls):
                    if on:
                        new[stop] = min(new.get(stop, math.inf), arrive)
                    if boards(t) and stop in reach and depart >= reach[stop] + (change if k > 1 else 0):
                        on = True
            walked = {}
            for a, b, secs in foot:
                if a in new:
                    walked[b] = min(walked.get(b, math.inf), new[a] + secs)
            for b, at in walked.items():
                new[b] = min(new.get(b, math.inf), at)
            labels |= {(s, k, d, a) for s, a in new.items()}
            reach = new
    beats = lambda y, x: y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] and y[3] <= x[3] and y != x
    want = {x for x in labels if x[1] > 0 and not any(beats(y, x) for y in labels)}
    got = {(r.stop, r["round"], r.depart, r.arrival) for r in raptor.profile(e, 0, 20, 200, rounds=3, walks=w, change=change, boards=F.col("trip") % 5 != 0).collect()}
    assert got == want and len(want) > 20
    found = spark.createDataFrame(sorted(want), "stop long, round int, depart long, arrival long")
    board = {(r.stop, r.place): (r.depart, r.arrival) for r in raptor.board(found, ["stop"], 3).collect()}
    for stop in {x[0] for x in want}:
        now, rows = -1, []
        while some := [x for x in want if x[0] == stop and x[2] > now]:
            best = min(some, key=lambda x: (x[3] + 300 * (x[1] - 1), x[2], x[1]))
            now = best[2]
            if not rows or rows[-1][3] != best[3]:
                rows.append(best)
        assert [board.get((stop, i + 1)) for i in range(3)] == [(r[2], r[3]) for r in rows[:3]] + [None] * (3 - len(rows[:3]))


# -- drives, calls, tuning


def test_drive_habits():
    assert drives.habits_after((1.0, 40.0, 0.2), 10.0, 1609.344, False, 0.5) == pytest.approx((2.0, 40 * 0.9997 + 22.36936 * 0.0003, 0.2 * 0.9997))
    assert drives.habits_after((1.0, 40.0, 0.2), 0.1, 1609.344, True, 0.5) == pytest.approx((3.0, 40.0, 0.2 * 0.9997 + 0.0003))
    assert drives.habits_after((1.0, 40.0, 0.2), -5.0, -1.0, False, 0.5)[0] == 1.0


def test_drives_over_batches(spark, tmp_path):
    """Fixes that come in two batches: a drive goes on from one to the other, and the watermark closes what is over."""
    t0 = datetime.datetime(2024, 5, 1)
    at = lambda minutes: t0 + datetime.timedelta(minutes=minutes)
    schema = "user_id long, ts timestamp, fix long, kind string, speed double, metres double, towing boolean, filled boolean"
    first = [(1, at(0), 1, "a", 10.0, 1609.344, False, False), (1, at(5), 2, "b", 10.0, 1609.344, False, True), (2, at(1), 3, "a", 0.0, 0.0, False, False)]
    later = [(1, at(20), 4, "a", 10.0, 1609.344, False, False), (1, at(300), 5, "a", 10.0, 1609.344, False, False), (3, at(2000), 6, "a", 1.0, 1.0, False, False)]
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.user_id, r.fixes): r for r in drives.settled_stream(spark, drives.drives(source, 3600.0, "1 hour")).collect()}
    assert got.keys() == {(1, 3), (2, 1), (1, 1)}
    assert got[1, 3].kinds == "a:2,b:1" and got[1, 3].miles == pytest.approx(3.0) and got[1, 3].since_fill == pytest.approx(2.0)
    assert got[1, 3].end - got[1, 3].start == 1200 and got[1, 1].since_fill == pytest.approx(3.0)


def test_calls(spark):
    rows = [
        ("sf-police", '{"cad_number":"1","call_type_final_desc":"","call_type_original_desc":"GUN","received_datetime":"2024-01-05T01:02:03.000","intersection_point":{"coordinates":[-122.4,37.7]},"priority_final":"A"}'),
        ("sf-police", '{"cad_number":"2","call_type_final_desc":"GUN","received_datetime":"2024-01-05T01:02:03.000","intersection_point":{"coordinates":[0,0]},"priority_final":"A"}'),
        ("sf-police", '{"cad_number":"3","call_type_final_desc":"GUN","received_datetime":"yesterday","intersection_point":{"coordinates":[-122.4,37.7]},"priority_final":"A"}'),
        ("seattle-fire", '{"type":"Aid Response","datetime":"2024-07-05T01:02:03.000","latitude":"47.6","longitude":-122.3}'), ("seattle-fire", "no json"), ("elsewhere", "{}"), (None, None),
    ]
    got = sorted(map(tuple, dispatch.incidents(spark.createDataFrame(rows, "feed string, row string")).select("id", "kind", "type", "lat", "heard", "lifetime").collect()))
    assert got == [("seattle-fire|2024-07-05T01:02:03.000|Aid Response", "medical", "Aid Response", 47.6, 1_720_166_523, 3600), ("sf-police|1", "police", "GUN", 37.7, 1_704_445_323, 3600)]


def test_tuning_accepts_only_what_helps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 8))
    y = 1 / (1 + np.exp(-x[:, 0]))
    theta = rng.normal(size=head.FEATURES * head.HIDDEN + 2 * head.HIDDEN + 1) * 0.3
    bad = np.where(np.arange(160) % 2 == 0, 0.0, 1.0)  # nothing to learn
    rows = [(k, v.tolist(), float(t), float(w)) for k, target in ((1, y), (2, bad), (3, y)) for v, t, w in zip(x, target, rng.uniform(0.5, 2, 160), strict=True)]
    rows += [(1, x[0].tolist(), None, 1.0), (1, x[0].tolist(), math.nan, 1.0), (1, [1.0], 0.5, 1.0), (4, x[0].tolist(), 0.5, 1.0)]
    r = spark.createDataFrame(rows, "k long, x array<double>, y double, weight double")
    heads = spark.createDataFrame([(k, theta.tolist(), 20, since, 0) for k, since in ((1, None), (2, 100_000.0), (3, 5.0), (4, None), (5, None))], "k long, theta array<double>, trips long, since_last double, tuned_at long")
    got = {t.k: t for t in head.tune_heads(heads, r, "k", epochs=300, rate=2.0, anchor=0.001).collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and got[1].accepted and got[1].after < got[1].before
    assert all(got[k].theta == theta.tolist() and not got[k].accepted for k in (3, 4, 5)) and got[3].before is None
    assert got[2].accepted == (got[2].after <= got[2].before)
    # The passes by plain loops over rows and units.
    n, h = head.FEATURES, head.HIDDEN
    some, target, weight = x[:20], y[:20], rng.uniform(0, 2, 20)
    now = [float(v) for v in theta]
    for _ in range(3):
        gradient = [0.0] * len(now)
        for v, t, w in zip(some, target, weight, strict=True):
            unit = [max(sum(v[i] * now[i * h + j] for i in range(n)) + now[n * h + j], 0) for j in range(h)]
            out = 1 / (1 + math.exp(-(sum(u * now[n * h + h + j] for j, u in enumerate(unit)) + now[-1])))
            d = w * (out - t) * out * (1 - out)
            gradient[-1] += d
            for j, u in enumerate(unit):
                gradient[n * h + h + j] += d * u
                if u > 0:
                    gradient[n * h + j] += d * now[n * h + h + j]
                    for i in range(n):
                        gradient[i * h + j] += d * now[n * h + h + j] * v[i]
        now = [a - 0.5 / max(weight.sum(), 1) * g - 0.1 * (a - b) for a, g, b in zip(now, gradient, theta, strict=True)]
    assert np.allclose(head.tuned(theta, some, target, weight, 3, 0.5, 0.1), now)


# -- needs, clocks, words


def test_needs(spark):
    kind = "trip long, miles double, seed long, gas double, diesel double, electric double, food double, rest double"
    trips = spark.createDataFrame([(1, 250.0, 7, 100.0, None, -5.0, 100.0, math.nan), (2, 0.0, 1, 1.0, 1.0, 1.0, 1.0, 1.0), (3, math.inf, 1, 1.0, 1.0, 1.0, 1.0, 1.0), (4, 100.0, 1, 100.0, 0.0, None, None, 60.0)], kind)
    got = [(r.trip, r.place, r.mile, r.need.split(" ·")[0]) for r in needs.schedule(trips).orderBy("trip", "place").collect()]
    assert got == [(1, 1, 100.0, "Food"), (1, 2, 100.0, "Gas"), (1, 3, 200.0, "Food"), (1, 4, 200.0, "Gas"), (4, 1, 60.0, "Rest")]
    assert sorted(needs.schedule(trips).collect()) == sorted(needs.schedule(trips.repartition(3)).collect())
    ahead = {r.mile: r.place for r in needs.next_needs(needs.schedule(trips), spark.createDataFrame([(1, 0.0), (1, 100.0), (1, 200.0)], "trip long, mile double")).collect()}
    assert ahead == {0.0: 1, 100.0: 3, 200.0: None}


def test_service_days_over_clock_changes(spark):
    cases = [(20260308, "America/Chicago"), (20261101, "America/Chicago"), (20261102, "America/Chicago"), (20260309, "America/Phoenix"), (20260229, "America/Chicago"), (18991231, "America/Chicago"), (None, "America/Chicago")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, d int, z string")
    got = {r.i: r for r in df.select("i", clock.day_start(F.col("d"), F.col("z")).alias("s"), clock.day_starts(F.col("d"), F.col("z"), 3).alias("b"), clock.service_instant(F.col("d"), F.col("z"), F.lit(90_000)).alias("t"), clock.zone_shift(F.col("d"), F.col("z"), F.lit("America/Denver")).alias("v")).collect()}
    from zoneinfo import ZoneInfo

    for i, (d, z) in enumerate(cases[:4]):
        noon = lambda back: datetime.datetime(d // 10_000, d // 100 % 100, d % 100, 12, tzinfo=ZoneInfo(z)) - datetime.timedelta(days=back)  # noqa: B023, E731
        start = [int(noon(k).timestamp()) - 43_200 for k in range(4)]
        assert (got[i].s, got[i].b, got[i].t) == (start[0], [start[0] - s for s in start[1:]], start[0] + 90_000)
    assert got[0].b[0] == 82_800 and got[1].b[0] == 90_000 and got[2].b == [86_400, 176_400, 262_800] and got[3].v == 3600
    assert all(got[i].s is None and got[i].b == [86_400, 172_800, 259_200] for i in (4, 5, 6))


def test_words(spark):
    rows = [(1, "ALERTA: Inundación súbita", "Severe", None), (2, "", "Severe", None), (3, None, None, None), (4, "Lluvia", "Minor", "chubascos de tarde muy fuertes"), (5, "Lluvia", "Minor", "lluvia con rachas muy fuertes"), (6, "Lluvia", "Minor", "60,5 mm"), (7, "Nevada", "Minor", None)]
    df = spark.createDataFrame(rows, "i long, e string, s string, d string")
    got = {r.i: r.w for r in df.select("i", phrases.risk_words(F.col("e"), F.col("s"), F.col("d")).alias("w")).collect()}
    assert got == {1: "Flood Warning", 2: "", 3: None, 4: "Flood Advisory", 5: "Rain Advisory", 6: "Flood Advisory", 7: "Winter Weather Advisory"}
    far = "blue " + "x" * 80 + " sedan " + "y" * 80 + " Ford"
    v = spark.createDataFrame([(1, far), (2, None), (3, "Red FORD car")], "i long, t string").select("i", phrases.vehicle(F.col("t")).alias("v"))
    assert {r.i: r.v and tuple(r.v) for r in v.collect()} == {1: ("sedan", None, None), 2: None, 3: ("sedan", "red", "Ford")}


def test_many_feeds(spark, tmp_path):
    files = {
        "agency": "agency_id,agency_timezone\n1,America/Chicago\n", "stops": "stop_id,stop_lat,stop_lon\nA,43,-89\nB,43.1,-89\n", "routes": "route_id,route_type\nr,3\n", "trips": "route_id,service_id,trip_id\nr,WK,t\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,08:00:00,08:00:00,A,1\nt,08:10:00,08:10:00,B,2\n", "calendar_dates": "service_id,date,exception_type\nWK,20260101,1\n",
        "fare_attributes": "fare_id,price,currency_type\nf,2.5,USD\n", "feed_info": "feed_publisher_name,feed_lang\nX,en\n",
    }
    for name, without in (("a", ()), ("b", ("calendar_dates",)), ("c", ("trips",)), ("d", ())):
        (tmp_path / name).mkdir()
        for file, text in files.items():
            if file not in without:
                (tmp_path / name / f"{file}.txt").write_text(text)
    tables, problems = readers.gtfs_feeds(spark, [str(tmp_path / n) for n in "abcd"])
    assert {(r.feed_no, r.problem) for r in problems.collect()} == {(1, "no calendar"), (2, "no trips")}
    assert Counter(r.feed_no for r in tables["stop_times"].collect()) == {0: 2, 3: 2}
    assert {r.stop_id for r in tables["stop_times"].collect()} == {"0:A", "0:B", "3:A", "3:B"} and tables["fare_attributes"].first().price == 2.5
    assert {tuple(r) for r in readers.agency_zones(tables["agency"]).collect()} == {(0, "America/Chicago"), (3, "America/Chicago")}
    none, _ = readers.gtfs_feeds(spark, [])
    assert none["stops"].count() == 0


def test_ferry_census(spark, tmp_path):
    files = {
        "terminals": "terminal_id,in_operation,latitude,longitude,terminal_name\n1,1,45.0,-85,A\n2,1,45.1,-85,B\n3,0,45.1,-85,C\n4,1,0,0,D\n5,1,x,-85,E\n",
        "operators": "operator_id,operator_name,url\n9,Boats,https://boats.example\n8,Rafts,ftp://x\n",
        "segments": "segment_id,segment_name,seg_terminal1_id,seg_terminal2_id\n10,AB,1,2\n11,AC,1,3\n12,AA,1,1\n13,BA,2,1\n14,AD,1,4\n",
        "operator_segments": "operator_id,segment_id,segment_season_start,segment_season_end,segment_length,average_trip_time,trips_per_year,vehicles\n9,10,5/1/2024,10/31/2024,3.5,20,368,12\n9,10,5/1/2024,10/31/2024,3.5,20,368,12\n8,13,,,x,,0,\n9,11,,,1,1,1,1\n7,10,,,1,1,1,1\n9,12,,,1,1,1,1\n9,14,,,1,1,1,1\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {(r.segment, r.operator): r for r in ferries.routes(ferries.census(spark, str(tmp_path))).collect()}
    assert got.keys() == {(10, 9), (13, 8)}
    r = got[10, 9]
    assert (r.name, r.a, r.b, r.miles, r.minutes, tuple(r.start), tuple(r.end), r.cars, r.per_day, r.url) == ("AB", 1, 2, 3.5, 20, (5, 1), (10, 31), True, 2.0, "https://boats.example")
    r = got[13, 8]
    assert (r.miles, r.minutes, r.start, r.cars, r.per_day, r.url) == (0.0, 0, None, None, 0.0, "")
