"""What is learned of travellers and kept of places: rankings, evictions, folds over a key's last rows, and lookups nearby."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.functions.geo import METRES_PER_DEGREE, haversine_km, meters
from hazgrid.operators import spatial
from hazgrid.operators.streams import fold

# Weights of an airport's distance by its size.
REACH = {"large": 0.55, "medium": 0.85, "small": 1.0}


def refuel_accuracy(df: DataFrame, key: str, order: list[Column], error: Column, whole: float = 1.0) -> DataFrame:
    """(key, accuracy): one less the mean of the last ten errors, not below 0; an error of ``whole`` is all."""
    w = Window.partitionBy(key).orderBy(*order)
    last = df.withColumn("_n", F.row_number().over(w)).where("_n <= 10")
    return last.groupBy(key).agg(F.greatest(F.lit(0.0), 1 - F.avg(error) / whole).alias("accuracy"))


def destination_ranks(scored: DataFrame, key: str, place: str, k: int) -> DataFrame:
    """The first ``k`` places of each key by score, scores as shares of the best, with the reason that the hits give."""
    best = scored.groupBy(key).agg(F.max("score").alias("_best"))
    reason = (
        F.when(F.col("context_hits") >= 3, "usually now").when(F.col("context_hits") > 0, "came at this time").when(F.col("time_hits") >= 3, "regular at this hour").when(F.col("total_hits") >= 5, "regular place").otherwise("recent")
    )
    w = Window.partitionBy(key).orderBy(F.desc("score"), place)
    return scored.join(best, key).where("_best > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, place, (F.col("score") / F.col("_best")).alias("score"), reason.alias("reason"), "rank")


def homes(cells: DataFrame, key: str, cell: str, incumbent: DataFrame, least_trips: int = 15, margin: float = 1.5, least_days: float = 30.0) -> DataFrame:
    """(key, cell) from cells (key, cell, weight, trips, days since first seen): the heaviest of a key with enough trips, the
    least cell on ties. The incumbent (key, current) stays unless another is heavier by the margin and long enough known."""
    best = cells.groupBy(key).agg(F.sum("trips").alias("_trips"), F.min(F.struct((-F.col("weight")).alias("w"), cell, "days")).alias("b"))
    now = cells.join(incumbent, key).where(F.col(cell) == F.col("current")).select(key, "current", F.col("weight").alias("_w"))
    df = best.where(F.col("_trips") >= least_trips).join(now, key, "left")
    moves = F.col("current").isNull() | ((-F.col("b.w") >= F.col("_w") * margin) & (F.greatest(F.col("b.days"), F.lit(0.0)) >= least_days))
    return df.select(key, F.when(moves, F.col("b")[cell]).otherwise(F.col("current")).alias(cell))


def evicted(df: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """Of a key with more than ``cap`` rows, the half that comes first in ``order``."""
    w = Window.partitionBy(key)
    df = df.withColumns({"_all": F.count("*").over(w), "_n": F.row_number().over(w.orderBy(*order))})
    return df.where((F.col("_all") > cap) & (F.col("_n") <= F.floor(F.col("_all") / 2))).drop("_all", "_n")


def reachable(stations: DataFrame, key: str, station: str, usable: Column) -> DataFrame:
    """(key, n, level, cheapest): stations (key, station, miles, price) within reach; level by how few they are; the cheapest in
    order of miles, where prices within a tenth of a cent are one and the nearer wins; the nearest where none has a price."""
    near = stations.where(F.col("miles") <= usable)
    counts = near.groupBy(key).agg(F.count("*").cast("int").alias("n"), F.min(F.struct("miles", station))[station].alias("_near"))

    def cheaper(best: tuple | None, row: tuple) -> tuple[tuple, list]:
        _, miles, _, price = row
        if best is not None:
            far = abs(price - best[3]) > 0.001
            if not (price < best[3] if far else miles < best[1]):
                return best, []
        return row, []

    priced = near.where(F.col("price").isNotNull()).select(F.col(key).cast("long").alias(key), F.col("miles").cast("double").alias("miles"), F.col(station).cast("long").alias(station), F.col("price").cast("double").alias("price"))
    best = fold(priced, [key], ["miles", station], ["price"], f"{key} long, _best long", cheaper, lambda best, row: [(best[0], best[2])])
    found = counts.join(best, key, "left")
    return found.select(key, "n", F.when(F.col("n") <= 3, "last chances").otherwise("none").alias("level"), F.coalesce("_best", "_near").alias("cheapest"))


def recommended_rentals(df: DataFrame, key: str, name: str, brands: list[str], k: int) -> DataFrame:
    """The nearest place of each brand (or other name), brands in their order first, then by miles."""
    lower = F.lower(name)
    rank, label = F.lit(len(brands)), lower
    for i, brand in reversed(list(enumerate(brands))):
        rank, label = F.when(lower.contains(brand), i).otherwise(rank), F.when(lower.contains(brand), brand).otherwise(label)
    near = df.withColumns({"brand": label, "_r": rank}).groupBy(key, "brand", "_r").agg(F.min("miles").alias("miles"))
    w = Window.partitionBy(key).orderBy("_r", "miles", "brand")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_r")


def nearest_airports(points: DataFrame, airports: DataFrame, key: str, airport: str, reach: float, k: int) -> DataFrame:
    """The first ``k`` airports (ref_lat, ref_lon, size) within ``reach`` metres of each point by distance weighted with their size."""
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in REACH.items() for x in kv]), F.col("size"))
    found = spatial.nearest_few(points, airports, key, airport, reach, max(0.5, reach / 111_320.0 / 4), k, F.col("meters") * factor, ("size",))
    return found.withColumnRenamed("distance", "weighted")


def airport_pairs(trips: DataFrame, board: DataFrame, alight: DataFrame, key: str, gap: float) -> DataFrame:
    """(key, board, alight): the first pair of different airports at least ``gap`` metres apart in order of their ranks, from
    ``board`` and ``alight`` (key, airport, lat, lon, rank)."""
    a = board.select(key, F.col("airport").alias("board"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("rank").alias("a"))
    b = alight.select(key, F.col("airport").alias("alight"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.col("rank").alias("b"))
    apart = (F.col("board") != F.col("alight")) & (meters(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) >= gap)
    best = trips.select(key).join(a, key).join(b, key).where(apart).groupBy(key).agg(F.min(F.struct("a", "b", "board", "alight")).alias("p"))
    return best.select(key, "p.board", "p.alight")


def crossings(trips: DataFrame, ferries: DataFrame, key: str, reach_km: float, k: int) -> DataFrame:
    """The first ``k`` ferries (ferry, a_lat, a_lon, b_lat, b_lon), in either direction, whose ends lie within reach of a trip's
    (from_lat, from_lon, to_lat, to_lon), by the sum of both ways, then by ferry. Terminals meet trips by cells of the reach; trips
    between the same places are one there, and of ferries between the same places only the first ``k`` can count."""
    size = reach_km / 111.0 * 1.5
    back = ferries.select("ferry", *(F.col(f"{p}_{c}").alias(f"{q}_{c}") for p, q in (("b", "a"), ("a", "b")) for c in ("lat", "lon")))
    both = ferries.withColumn("backward", F.lit(False)).unionByName(back.withColumn("backward", F.lit(True)))
    same = Window.partitionBy("a_lat", "a_lon", "b_lat", "b_lon").orderBy("ferry", "backward")
    both = both.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    ends = ["from_lat", "from_lon", "to_lat", "to_lon"]
    cell = lambda c: F.floor(F.col(c) / size)
    wide = F.ceil(1 / F.greatest(F.cos(F.radians(F.abs("a_lat")) + math.radians(size)), F.lit(0.05))).cast("int")
    spread = both.withColumn("_row", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: cell("a_lat") + d))).withColumn("_column", F.explode(F.transform(F.sequence(-wide, wide), lambda d: cell("a_lon") + d)))
    pairs = trips.select(*ends).distinct().withColumns({"_row": cell("from_lat"), "_column": cell("from_lon")}).join(spread, ["_row", "_column"])
    on, off = haversine_km(F.col("from_lat"), F.col("from_lon"), F.col("a_lat"), F.col("a_lon")), haversine_km(F.col("to_lat"), F.col("to_lon"), F.col("b_lat"), F.col("b_lon"))
    near = pairs.withColumns({"board_km": on, "alight_km": off}).where((F.col("board_km") <= reach_km) & (F.col("alight_km") <= reach_km))
    order = [F.col("board_km") + F.col("alight_km"), "ferry", "backward"]
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy(*ends).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    near = trips.select(key, *ends).join(near, ends)
    w = Window.partitionBy(key).orderBy(*order)  # again, for keys of several rows
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "ferry", "backward", "board_km", "alight_km", "rank")


def spaced(df: DataFrame, key: str, order: str, lat: str, lon: str, least: float) -> DataFrame:
    """(key, order) of the fixes that a trail keeps: each at least ``least`` metres from the last kept one. The fixes of a key
    pass in order, with the last kept one as the state; places at the origin aren't real."""
    real = df.where((F.abs(lat) > 0.0001) | (F.abs(lon) > 0.0001))
    real = real.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(lat).cast("double").alias("_y"), F.col(lon).cast("double").alias("_x"))

    def add(last: tuple | None, row: tuple) -> tuple[tuple, list]:
        k, o, y, x = row
        if last is not None:
            dy = (y - last[0]) * METRES_PER_DEGREE
            dx = (x - last[1]) * METRES_PER_DEGREE * math.cos(math.radians((last[0] + y) / 2))
            if math.sqrt(dx * dx + dy * dy) < least:
                return last, []
        return (y, x), [(k, o)]

    return fold(real, [key], [order], ["_y", "_x"], f"{key} long, {order} long", add)


def throttled(df: DataFrame, key: str, seconds: str, interval: float) -> DataFrame:
    """(key, seconds) of the messages that pass: each at least ``interval`` after the last that did. The messages of a key pass in
    order, with the time of the last one that passed as the state."""

    def add(last: float | None, row: tuple) -> tuple[float | None, list]:
        return (last, []) if last is not None and row[1] - last < interval else (row[1], [row])

    times = df.where(F.col(seconds).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(seconds).cast("double").alias(seconds))
    return fold(times, [key], [seconds], [], f"{key} long, {seconds} double", add)


def folded_marks(marks: DataFrame, window: DataFrame, size: float = 0.05, reach: float = 600.0, margin: float = 0.02) -> DataFrame:
    """(mark, source): for marks of a route (mark, lat, lon, risk, code), the last mark of a later window (w, ref_lat, ref_lon,
    w_risk, w_code) that repainted each: windows go to their nearest mark, in order, and repaint where the risk moved or the
    code changed since the last repaint. Null where none did. The windows of a mark pass in order, with its paint as the state."""
    at = window.select(F.col("w").cast("long").alias("w"), F.col("w_risk").cast("double").alias("w_risk"), F.col("w_code").cast("long").alias("w_code"), F.col("ref_lat").alias("lat"), F.col("ref_lon").alias("lon"))
    refs = marks.select("mark", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    painted = spatial.nearest_known(at, refs, ["w", "w_risk", "w_code"], "mark", reach, size).select("mark", "w", "w_risk", "w_code")
    first = marks.select("mark", F.lit(None).cast("long").alias("w"), F.col("risk").cast("double").alias("w_risk"), F.col("code").cast("long").alias("w_code"))

    def paint(state: tuple | None, row: tuple) -> tuple[tuple, list]:
        _, w, risk, code = row
        if state is None or (w is not None and (abs(state[0] - risk) > margin or state[1] != code)):
            return (risk, code, w), []
        return state, []

    return fold(first.unionByName(painted), ["mark"], ["w"], ["w_risk", "w_code"], "mark long, source long", paint, lambda state, row: [(row[0], state[2])])


def labels(badges: DataFrame, labelled: DataFrame, reach: float, size: float) -> DataFrame:
    """(badge, label): each labelled item (item, kind, ref_lat, ref_lon, score) goes to the nearest badge (badge, kind, lat, lon)
    of its kind within reach; a badge takes the best-scored of its items, the first on ties."""
    items = labelled.select("item", "score", "kind", F.col("ref_lat").alias("lat"), F.col("ref_lon").alias("lon"))
    refs = badges.select("badge", "kind", F.col("lat").alias("ref_lat"), F.col("lon").alias("ref_lon"))
    near = spatial.nearest_known(items, refs, ["item", "score"], "badge", reach, size, on=("kind",))
    best = near.groupBy("badge").agg(F.min(F.struct((-F.col("score")).alias("s"), "item"))["item"].alias("label"))
    return badges.select("badge").join(best, "badge", "left")


def lattice(box: DataFrame, key: str, per_side: int) -> DataFrame:
    """(key, lat, lon): points of a grid over boxes (key, lat, lon, span_lat, span_lon) whose steps are halves of powers of two, so
    that neighbouring views share them."""
    step = lambda span: F.pow(F.lit(2.0), F.ceil(2 * F.log2(F.col(span) / max(per_side, 1))) / 2)
    df = box.withColumns({"_sy": step("span_lat"), "_sx": step("span_lon")})
    line = lambda c, span, s: F.sequence(F.ceil((F.col(c) - F.col(span) / 2) / F.col(s)), F.floor((F.col(c) + F.col(span) / 2) / F.col(s)))
    some = (F.ceil((F.col("lat") - F.col("span_lat") / 2) / F.col("_sy")) <= F.floor((F.col("lat") + F.col("span_lat") / 2) / F.col("_sy"))) & (F.ceil((F.col("lon") - F.col("span_lon") / 2) / F.col("_sx")) <= F.floor((F.col("lon") + F.col("span_lon") / 2) / F.col("_sx")))
    df = df.where(some).withColumn("_i", F.explode(line("lat", "span_lat", "_sy"))).withColumn("_j", F.explode(line("lon", "span_lon", "_sx")))
    return df.select(key, (F.col("_i") * F.col("_sy")).alias("lat"), (F.col("_j") * F.col("_sx")).alias("lon"))


def probes(legs: DataFrame, key: str, metres: Column, most: int = 16) -> DataFrame:
    """(key, place, lat, lon): points every 20 km between two samples (lat, lon, to_lat, to_lon), one a cell of a quarter degree;
    none where that takes too many."""
    steps = F.greatest(F.floor(metres / 20_000), F.lit(1))
    df = legs.withColumn("_n", steps).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    f = F.col("place") / F.col("_n")
    df = df.select(key, "place", (F.col("lat") + (F.col("to_lat") - F.col("lat")) * f).alias("lat"), (F.col("lon") + (F.col("to_lon") - F.col("lon")) * f).alias("lon"))
    first = df.groupBy(key, F.round(F.col("lat") * 4).alias("_y"), F.round(F.col("lon") * 4).alias("_x")).agg(F.min(F.struct("place", "lat", "lon")).alias("p"))
    n = first.groupBy(key).agg(F.count("*").alias("_c")).where(F.col("_c") <= most)
    return first.join(n, key).select(key, "p.place", "p.lat", "p.lon")
