"""Rows that share a place: results stay, and no step of a job holds pairs of them."""

import re

import pytest
from pyspark.sql import functions as F

from hazgrid.functions import travel
from hazgrid.operators import areas, cells, covers, graph, habits, hazards, lines, merge, routes, spatial
from hazgrid.plans import joins, registry
from hazgrid.plans import lines as plan_lines

N = 600


def _most_rows(spark, df, metric="number of output rows", join=max):
    """The rows of ``df`` and the most rows that a step of its jobs put out; or another metric, joined otherwise."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    wait()
    before = store.executionsCount()
    rows = df().collect()
    wait()
    most = 0
    for i in range(before, store.executionsCount()):
        one = store.executionsList(i, 1).head().executionId()
        metrics, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                value = metrics.get(m.accumulatorId())
                if m.name() == metric and value.isDefined():
                    most = join(most, int(re.sub(r"\D", "", value.get()) or 0))
    return rows, most


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(N).select("id", (F.col("id") % 2 * 1.0 + 40).alias("lat"), F.lit(-90.0).alias("lon"), (F.col("id") % 3).alias("kind"))


@pytest.fixture(scope="module")
def refs(spark):
    k = F.col("ref")
    return spark.range(N).toDF("ref").select("ref", (k % 2 * 1.0 + 40.1).alias("ref_lat"), F.lit(-90.0).alias("ref_lon"), (k % 3).alias("kind"), (k % 100).cast("double").alias("v"))


def _hold(spark, df, expected):
    rows, most = _most_rows(spark, df)
    assert {tuple(r) for r in rows} == expected
    assert most < 40 * N


def test_nearest(spark, points, refs):
    _hold(spark, lambda: spatial.nearest(points, refs, "id", "ref", 300_000.0, 2.0).select("id", "ref"), {(i, i % 2) for i in range(N)})


def test_decay_and_hazards(spark, points, refs):
    near = 1 - 0.1 * 111_320 / 150_000
    score = lambda s: s.select("id", F.round("score", 6))
    _hold(spark, lambda: score(spatial.decay_max(points, refs, "id", F.col("v") / 100, 150_000.0, 2.0)), {(i, round((0.98 + i % 2 / 100) * near, 6) if i % 2 else round(max(0.98 * near, 0.99 * (1 - 1.1 * 111_320 / 150_000)), 6)) for i in range(N)})
    quakes = refs.withColumns({"magnitude": 3 + F.col("v") / 50, "age_hours": F.lit(0.0), "knots": F.col("v") + 30, "level": F.lit("watch")})
    _hold(spark, lambda: score(hazards.seismic(points, quakes, "id")), {(i, round((0.98 + i % 2 / 100) * 2 / 4 * near, 6)) for i in range(N)})
    assert _most_rows(spark, lambda: hazards.tropical(points, quakes, "id"))[1] < 40 * N
    _hold(spark, lambda: score(hazards.tsunami(points, quakes, "id")), {(i, round(0.72 * (1 - 0.5 * 0.1 * 111_320 / 500_000), 6)) for i in range(N)})


def test_counts(spark, points, refs):
    _hold(spark, lambda: spatial.counts(points, refs, "id", 50_000.0, 1.0).select("id", "n"), {(i, N // 2) for i in range(N)})


def test_nearest_few(spark, points, refs):
    few = lambda: spatial.nearest_few(points, refs, "id", "ref", 150_000.0, 2.0, 3).select("id", "ref", "rank")
    _hold(spark, few, {(i, i % 2 + 2 * k, k + 1) for i in range(N) for k in range(3)})
    twice = {tuple(r) for r in spatial.nearest_few(points.limit(1).union(points.limit(1)), refs, "id", "ref", 150_000.0, 2.0, 3).select("ref", "rank").collect()}
    assert twice == {(0, 1), (0, 2), (2, 3)}
    sized = refs.withColumn("size", F.lit("small"))
    _hold(spark, lambda: habits.nearest_airports(points, sized, "id", "ref", 60_000.0, 2).select("id", "ref"), {(i, i % 2 + 2 * k) for i in range(N) for k in range(2)})


def test_labels_and_unshown(spark, points, refs):
    items = refs.withColumnsRenamed({"ref": "item", "v": "score"})
    best = {(p, k): max((i for i in range(N) if i % 2 == p and i % 3 == k), key=lambda i: (i % 100, -i)) for p in range(2) for k in range(3)}
    want = {(i, best[i % 2, i % 3] if i < 6 else None) for i in range(N)}  # the least badge of a place and kind takes all
    _hold(spark, lambda: habits.labels(points.withColumnRenamed("id", "badge"), items, 60_000.0, 1.0), want)
    shown = refs.where("kind < 2").select("kind", F.col("ref_lat").alias("lat"), F.col("ref_lon").alias("lon"))
    _hold(spark, lambda: merge.unshown(points, shown, 60_000.0, 1.0).select("id"), {(i,) for i in range(N) if i % 3 == 2})


def test_folded_marks(spark, points, refs):
    marks = points.select(F.col("id").alias("mark"), "lat", "lon", F.lit(0.5).alias("risk"), F.lit(1).alias("code"))
    window = refs.select(F.col("ref").alias("w"), (F.col("ref_lat") - 0.1).alias("ref_lat"), "ref_lon", F.lit(0.9).alias("w_risk"), F.lit(1).alias("w_code"))
    _hold(spark, lambda: habits.folded_marks(marks, window), {(i, i if i < 2 else None) for i in range(N)})


def test_crossings(spark, points, refs):
    trips = points.select("id", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), F.col("lat").alias("to_lat"), (F.col("lon") + 5).alias("to_lon"))
    boats = refs.select(F.col("ref").alias("ferry"), F.col("ref_lat").alias("a_lat"), F.col("ref_lon").alias("a_lon"), F.col("ref_lat").alias("b_lat"), (F.col("ref_lon") + 5).alias("b_lon"))
    _hold(spark, lambda: habits.crossings(trips, boats, "id", 50.0, 2).select("id", "ferry", "backward", "rank"), {(i, i % 2 + 2 * k, False, k + 1) for i in range(N) for k in range(2)})


def test_merged_areas(spark, points):
    ring = F.array(*(F.struct((F.lit(-90.0) + dx).alias("x"), (F.lit(40.0) + dy).alias("y")) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    shown = points.select("id", F.lit(1).alias("event"), ring.alias("ring"), F.lit(2000.0).alias("expires"))
    live = points.select((F.col("id") + 10_000).alias("id"), F.when(F.col("id") < 5, 2).otherwise(1).alias("event"), ring.alias("ring"), F.lit(3000.0).alias("expires"))
    merged = lambda: areas.merged(shown, live, points.select("lat", "lon"), F.lit(1000.0), 0.5).select("id", "event", "source")
    _hold(spark, merged, {(10_005, 1, "renewed")} | {(10_000 + i, 2, "new") for i in range(5)})
    gone = lambda: areas.merged(shown, live.where("event = 2"), points.select("lat", "lon"), F.lit(1000.0), 0.5).select("id", "source")
    _hold(spark, gone, {(10_000 + i, "new") for i in range(5)})


@pytest.mark.parametrize("first", [False, True])
def test_worst_in_cell(spark, first):
    k = F.col("id")
    alerts = spark.range(N).select(cells.alert_cell(F.lit(40.0), F.lit(-90.0)).alias("cell"), k.alias("place"), k.alias("alert_id"), F.lit("Tornado Warning").alias("event"), (1 - k / 1000).alias("severity"), F.when(k < N - 1, k * 10.0).alias("expires"))
    samples = spark.range(N).select("id", F.lit(40.0).alias("lat"), F.lit(-90.0).alias("lon"), F.when(k % 3 != 0, k % 90 * 10.0).alias("arrival"))
    want = {(i, min(101 + (i % 90 if i % 3 else 0), N - 1)) for i in range(N)}
    rows, most = _most_rows(spark, lambda: cells.worst_in_cell(samples, alerts, "id", F.lit(1000.0), first).select("id", "alert_id"))
    assert {tuple(r) for r in rows} == want
    assert most < 100 * N


def test_through_closures(spark):
    """Routes that share segments, and closures that share a place: by a vertex, by a segment's middle, past it, and of one vertex."""
    at = {0: [(43.0, -90.0), (43.01, -90.0)], 1: [(43.005, -90.001), (43.005, -89.999)], 2: [(43.005, -90.01), (43.005, -90.002)], 3: [(43.0, -90.0)]}
    v = spark.createDataFrame([(r, s, *at[r % 4][s]) for r in range(N) for s in range(len(at[r % 4]))], "route long, seq int, lat double, lon double")
    closed = spark.createDataFrame([(43.0, -90.0), (43.005, -90.0)] * (N // 2), "closure_lat double, closure_lon double")
    _hold(spark, lambda: routes.through_closures(v, closed), {(r,) for r in range(N) if r % 4 != 2})


def test_days_round_by_value(spark):
    """4.85 lies below its tenths' middle as a number; 24.25 is a middle and goes to the even tenth."""
    s = spark.createDataFrame([(419_040.0,), (2_095_200.0,), (259_200.0,)], "s double")
    assert [r[0] for r in s.select(travel.clock_text(F.col("s"))).collect()] == ["4.8 d", "24.2 d", "3.0 d"]


def test_lateral_latest_of_repeated_customers(spark, tmp_path):
    c = spark.createDataFrame([(1,), (1,), (2,)], "c_custkey long")
    o = spark.createDataFrame([(k, 1, f"2020-01-0{k}") for k in range(1, 5)], "o_orderkey long, o_custkey long, d string").withColumn("o_orderdate", F.to_timestamp_ntz("d"))
    c.write.parquet(f"{tmp_path}/customer.parquet")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, joins.lateral_latest(spark, str(tmp_path)).collect())) == [(1, 3), (1, 4)]


def test_lateral_latest_keeps_its_order(spark, tmp_path):
    """The limit a customer is by date and key itself, not by the order in which a shuffle happens to bring its rows; no key comes last."""
    spark.range(2).toDF("c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    o = spark.createDataFrame([(k, 1, "2020-01-01") for k in (None, 7, 5, 6)] + [(8, 1, None)], "o_orderkey long, o_custkey long, d string").withColumn("o_orderdate", F.to_timestamp_ntz("d"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    latest = joins.lateral_latest(spark, str(tmp_path))
    assert sorted(map(tuple, latest.collect())) == [(1, 5), (1, 6)]
    window = next(x for x in latest._jdf.queryExecution().optimizedPlan().toString().splitlines() if "+- Window [" in x)
    assert re.search(r"\(o_custkey#\w+, o_orderdate#\w+ DESC NULLS LAST, o_orderkey#\w+ ASC", window)


def test_alerts_covering(spark, points):
    """Alerts alike in rings or zones, some with both, and a point of two rows: pairs come out of the last join alone."""
    square = F.array(*(F.struct((F.lit(-90.0) + dx).alias("x"), (F.lit(40.0) + dy).alias("y")) for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))))
    line, none = F.array(F.slice(square, 1, 2)), F.array().cast("array<array<struct<x:double,y:double>>>")
    k = F.col("alert_id")
    rings = F.when(k % 3 == 0, F.array(square)).when(k % 3 == 1, none).otherwise(line)
    alerts = spark.range(N).toDF("alert_id").select("alert_id", rings.alias("rings"), F.array(F.when(k % 2 == 0, "z").otherwise("far")).alias("zones"))
    zones = spark.range(1).select(F.lit("z").alias("zone"), square.alias("ring"))
    covering = {a for a in range(N) if a % 3 == 0 or a % 2 == 0}
    found = covers.alerts_covering(points.unionByName(points.limit(1)), alerts, zones, "id", 0.8).collect()
    assert len(found) == len(covering) * N // 2
    assert {tuple(r) for r in found} == {(i, a) for i in range(0, N, 2) for a in covering}
    samples = points.withColumn("route", F.lit(7))
    spans = lambda: covers.corridor_alerts(samples, alerts, zones, "route", "id", 0.8)
    _hold(spark, spans, {(7, a, 0, N - 2, N // 2) for a in covering})


def test_alerts_covering_is_small_on_disk(spark, tmp_path, monkeypatch):
    """Rows come in an order that repeats within a page of a file, also where a place has more alerts than a page has rows."""
    monkeypatch.setattr(covers, "LIST", 20)
    square = F.array(*(F.struct((F.lit(-90.0) + dx).alias("x"), (F.lit(40.0) + dy).alias("y")) for dx, dy in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))))
    alerts = spark.range(30_000).toDF("alert_id").select("alert_id", F.array(square).alias("rings"), F.array(F.lit("z")).alias("zones"))
    zones = spark.range(1).select(F.lit("z").alias("zone"), square.alias("ring"))
    spot = spark.range(50).select("id", F.lit(40.0).alias("lat"), F.lit(-90.0).alias("lon"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        covers.alerts_covering(spot, alerts, zones, "id", 0.8).write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == spark.read.parquet(f"{tmp_path}/pairs").count() == 50 * 30_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.75 * 50 * 30_000


def test_match_fixes_of_short_routes(spark, monkeypatch):
    """A fix far from all vertices of a route that lies within its stretch has met them all; longer routes are still searched."""
    v = spark.range(N).select((F.col("id") % 150).alias("route"), F.floor(F.col("id") / 150).cast("int").alias("seq"), (43 + F.floor(F.col("id") / 150) / 100).alias("lat"), F.lit(-90.0).alias("lon"))
    far = spark.range(400).select(F.lit(1000).cast("long").alias("route"), F.col("id").cast("int").alias("seq"), (43 + F.col("id") / 100).alias("lat"), F.lit(-90.0).alias("lon"))
    fixes = spark.range(150).select(F.col("id").alias("fix"), F.col("id").alias("route"), F.lit(0).alias("last"), F.lit(43.0299).alias("fix_lat"), F.lit(-90.01).alias("fix_lon"))
    lost = spark.createDataFrame([(1000, 1000, 5, 45.9999, -90.01)], fixes.schema)
    some = lambda f: lambda: routes.match_fixes(v.unionByName(far), f).select("fix", "seq")
    assert {tuple(r) for r in some(fixes.unionByName(lost))().collect()} == {(i, 3) for i in range(150)} | {(1000, 300)}
    monkeypatch.setattr(routes, "nearest_anywhere", None)  # not looked for
    assert {tuple(r) for r in some(fixes)().collect()} == {(i, 3) for i in range(150)}


def test_shortest_paths_move_edges_once(spark):
    chain = spark.range(8).select("id", (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w")).toDF("src", "dst", "w")
    edges = chain.unionByName(spark.range(5000).select((F.col("id") + 100).alias("src"), F.lit(1).cast("long").alias("dst"), F.lit(1.0).alias("w")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, moved = _most_rows(spark, lambda: graph.shortest_paths(edges, 0), "shuffle records written", lambda a, b: a + b)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {tuple(r) for r in rows} == {(i, float(i)) for i in range(9)}
    assert 5000 <= moved < 12_000


def _line_tables(spark, folder, orders):
    """Orders of four lines each, alike but for the map that their keys put them on."""
    at = lambda k, i: (k, (k % 1_000_000 // 3 * 37 + i * 131) % 1000, i, float(i))
    spark.createDataFrame([at(k, i) for k in orders for i in range(4)], "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")


def test_routes_of_other_maps_never_meet(spark, tmp_path):
    """the millionth order lies where the first does, on another map; its SQL has no pair of the two."""
    duckdb = pytest.importorskip("duckdb")
    _line_tables(spark, tmp_path, [k + m * 3_000_000 for k in (0, 3, 4, 6, 9, 12, 15, 18, 24, 27) for m in range(3)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("limits_on_route", "driven_closures"):
        want = {tuple(r) for r in con.execute(plan_lines.SQL[name]).fetchall()}
        assert {tuple(r) for r in getattr(plan_lines, name)(spark, str(tmp_path)).collect()} == want and len(want) > 5


def test_steps_of_roads_are_no_rows(spark):
    """a way of two thousand steps beside its route moves a few rows for each cell that it crosses, not one for each step."""
    ends = [(1, 0, 43.0, -89.0), (1, 1, 43.17, -89.0)]
    v = spark.createDataFrame(ends, "route long, seq long, lat double, lon double")
    w = v.select(F.col("route").alias("way"), "seq", "lat", (F.col("lon") + 1e-4).alias("lon"), F.lit(True).alias("directed"))
    for found in (lambda: lines.runs_along(v, w), lambda: lines.drives_closures(v, w)):
        rows, moved = _most_rows(spark, found, "shuffle records written", lambda a, b: a + b)
        assert {tuple(r) for r in rows} == {(1, 1)} and moved < 500


@pytest.mark.parametrize("name", ["hazard_tropical", "hazard_tsunami", "within_radius_counts", "airport_pairs", "nearest_stops"])
def test_queries_of_two_places(spark, tmp_path, name):
    """F8, F9, F16-F18: customers of one place, suppliers there and at the place of the customers' nation."""
    duckdb = pytest.importorskip("duckdb")
    k, far = F.col("id"), 25
    spark.range(N).select((k * 1000 + far).alias("c_custkey"), F.lit(0).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(N).select((F.floor(k / 2) * 1000 + k % 2 * far).alias("s_suppkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    if name == "airport_pairs":
        want = {(i * 1000 + far, far, 0) for i in range(N)}
    else:
        con = duckdb.connect()
        for table in ("customer", "supplier"):
            con.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = {tuple(map(float, r)) for r in con.execute(registry.oracle_sql()[name]).fetchall()}
    rows, most = _most_rows(spark, lambda: registry.queries()[name](spark, str(tmp_path)))
    assert {tuple(map(float, r)) for r in rows} == want and len(want) >= N
    assert most < 40 * N


def _moved(spark, df):
    """The rows of ``df`` and the rows that its shuffles write, without broadcasts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _most_rows(spark, df, "shuffle records written", lambda a, b: a + b)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_grades_move_once(spark):
    """pieces and marks come together in one shuffle; in blocks, what a block is brought adds a few rows, and nothing is joined."""
    k = F.col("id")
    pieces = spark.range(4 * N).select(F.floor(k / 4).alias("route"), (k % 4 * 30).alias("start_mile"), (k % 4 * 30 + 25).alias("end_mile"), (k % 7 - 3.0).alias("grade"))
    pieces = pieces.unionByName(pieces.where("start_mile = 30").withColumns({"start_mile": F.lit(31).cast("long"), "grade": F.lit(9.0)}))  # of one end, the least start counts
    marks = spark.range(N).select(k.alias("mark"), k.alias("route"), (k % 13 * 10).alias("mile"))
    want = {(i, (4 * i + i % 13 * 10 // 30) % 7 - 3.0 if i % 13 * 10 % 30 <= 25 and i % 13 < 12 else 0.0) for i in range(N)}
    for width, most in ((None, 6 * N), (1000.0, 11 * N), (20.0, 25 * N)):
        rows, moved = _moved(spark, lambda w=width: routes.grades_at(pieces, marks, width=w))
        assert {tuple(r) for r in rows} == want and moved <= most


def test_progress_moves_once(spark):
    """vertices, steps and fixes come together in one shuffle. A step whose end is no vertex, a fix off the route, one that is on a
    later step than its place says, one past all steps, and a route without steps."""
    v = spark.range(5 * N).select(F.floor(F.col("id") / 5).alias("route"), (F.col("id") % 5).alias("seq"), (40 + F.col("id") % 5 * 0.01).alias("lat"), F.lit(-90.0).alias("lon"))
    steps = spark.range(3 * (N - 1)).select(F.floor(F.col("id") / 3).alias("route"), (F.col("id") % 3).alias("step"), F.element_at(F.array(*map(F.lit, (1, 3, 9))), (F.col("id") % 3 + 1).cast("int")).cast("long").alias("end_seq"))
    k = F.col("id") % 5
    fixes = spark.range(N).select(F.col("id").alias("fix"), F.col("id").alias("route"), F.when(k == 4, 7).otherwise(k).cast("long").alias("seq"), F.when(F.col("id") % 2 == 0, 1).otherwise(0).cast("long").alias("step"))
    hop = 1113.2
    want = set()
    for i in range(N - 1):
        seq = i % 5
        if seq < 4:
            step = 1 if seq >= 1 or i % 2 == 0 else 0
            want.add((i, step, round(seq * hop, 3), round((4 - seq) * hop, 3), round(((1, 3)[step] - seq) * hop, 3), round((4 - seq) / 4, 6)))
    rounded = lambda: routes.progress(v, steps, fixes).select("fix", "step", *(F.round(c, 3) for c in ("along", "remaining", "to_end")), F.round("left", 6))
    rows, moved = _moved(spark, rounded)
    assert {tuple(r) for r in rows} == want and moved <= 9 * N
