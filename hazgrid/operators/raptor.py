"""Earliest arrivals over a timetable in rounds of boardings, with walks between stops, and the journeys behind them.

A timetable is rows (trip, seq, stop, arrive, depart). A round boards each trip once, at its first stop that is reached in
time, and rides it to all later stops: joins by stop and by trip, minima with partial sums, and never a pair of stops. The
rounds' results are tables of at most a row a stop, checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.operators.asof import asof
from hazgrid.operators.shared import settled

#: Boardings at most, where a caller says nothing.
ROUNDS = 4
# Fixed value: seconds that a change of vehicles counts for when journeys are compared.
CHANGE_COST = 300
#: Seconds of departures in a block of the board.
BLOCK = 3600


def _timetable(events: DataFrame, boards: Column | None) -> DataFrame:
    """The events, settled: each round reads them twice. ``boards`` says where a rider may get on."""
    e = events.select("trip", *(F.col(c).cast("long").alias(c) for c in ("seq", "stop", "arrive", "depart")), (F.lit(True) if boards is None else F.coalesce(boards, F.lit(False))).alias("boards"))
    return settled(e)


def arrivals(events: DataFrame, origin, start: int, rounds: int = ROUNDS, walks: DataFrame | None = None, change: int = 0, boards: Column | None = None) -> DataFrame:
    """(stop, round, arrival, trip, board_stop, off_stop): the earliest arrival at each stop with up to ``rounds`` boardings, a
    row for each round that comes earlier than all before it. ``walks`` (from_stop, to_stop, seconds) may follow a ride or
    begin the journey; between two rides ``change`` seconds pass. A trip is boarded only at events where ``boards`` holds, as
    for some kinds of vehicles or where none are taken on. Ties go to the least trip."""
    spark = events.sparkSession
    e = _timetable(events, boards)
    kind = dict(events.dtypes)["trip"]
    columns = ("arrival", "trip", "board_stop", "off_stop")

    def walked(reached: DataFrame) -> DataFrame:
        if walks is None:
            return reached
        on = reached.join(walks, reached["stop"] == walks["from_stop"])
        on = on.select(walks["to_stop"].cast("long").alias("stop"), (F.col("arrival") + F.col("seconds")).cast("long").alias("arrival"), "trip", "board_stop", "off_stop")
        both = reached.select("stop", *columns).unionByName(on)
        return both.groupBy("stop").agg(F.min(F.struct(*columns)).alias("b")).select("stop", "b.*")

    first = spark.createDataFrame([(origin, start)], "stop long, arrival long").select("stop", "arrival", F.lit(None).cast(kind).alias("trip"), F.lit(None).cast("long").alias("board_stop"), F.col("stop").alias("off_stop"))
    frontier = settled(walked(first).withColumn("round", F.lit(0)))
    best = frontier
    for k in range(1, rounds + 1):
        ready = frontier.select("stop", (F.col("arrival") + (change if k > 1 else 0)).alias("ready"))
        boarded = e.where("boards").join(ready, "stop").where(F.col("depart") >= F.col("ready")).groupBy("trip").agg(F.min(F.struct("seq", "stop")).alias("on"))
        rides = e.join(boarded, "trip").where(F.col("seq") > F.col("on.seq")).select("stop", F.col("arrive").alias("arrival"), "trip", F.col("on.stop").alias("board_stop"), F.col("stop").alias("off_stop"))
        reached = walked(rides.groupBy("stop").agg(F.min(F.struct(*columns)).alias("b")).select("stop", "b.*"))
        known = best.groupBy("stop").agg(F.min("arrival").alias("_known"))
        better = reached.join(known, "stop", "left").where(F.col("_known").isNull() | (F.col("arrival") < F.col("_known")))
        frontier = settled(better.select("stop", *columns, F.lit(k).alias("round")))
        if frontier.isEmpty():
            break
        best = best.unionByName(frontier)
    return best.select("stop", "round", *columns)


def journeys(found: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(target, round, arrival, leg, trip, board_stop, off_stop, stop): the rides of the journeys to ``targets`` (target), read
    back from ``arrivals``: the ride of a round boards at a stop that the round before reached."""
    at = found.join(targets, found["stop"] == targets["target"]).select("target", F.col("round").alias("total"), F.col("arrival").alias("_end"), "stop", "round", "trip", "board_stop", "off_stop")
    legs, now = None, at.where(F.col("round") > 0)
    for _ in range(rounds):
        part = now.select("target", F.col("total").alias("round"), F.col("_end").alias("arrival"), F.col("round").alias("leg"), "trip", "board_stop", "off_stop", "stop")
        legs = part if legs is None else legs.unionByName(part)
        before = found.select("round", "trip", "board_stop", "off_stop", F.col("stop").alias("at_stop"))
        now = now.select("target", "total", "_end", F.col("board_stop").alias("at_stop"), (F.col("round") - 1).alias("round")).join(before, ["at_stop", "round"]).where(F.col("round") > 0).withColumnRenamed("at_stop", "stop")
    return legs


def departures(events: DataFrame, origin, target, depart: Column) -> DataFrame:
    """The direct rides from ``origin`` to ``target`` that leave from ``depart`` on and that no later one overtakes:
    (trip, depart, arrive), as a board shows them."""
    on = events.where(F.col("stop") == F.lit(origin)).select("trip", F.col("seq").alias("on"), "depart")
    off = events.where(F.col("stop") == F.lit(target)).select("trip", F.col("seq").alias("off"), "arrive")
    rides = on.join(off, "trip").where((F.col("off") > F.col("on")) & (F.col("depart") >= depart)).groupBy("trip").agg(F.max(F.struct("depart", (-F.col("arrive")).alias("a"))).alias("b"))
    rides = rides.select("trip", F.col("b.depart").alias("depart"), (-F.col("b.a")).alias("arrive"))
    # An hour of departures is a block: the least arrival of all later blocks, then of later departures in the block.
    blocks = rides.groupBy(F.floor(F.col("depart") / BLOCK).alias("block")).agg(F.min("arrive").alias("least"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.min("least").over(later).alias("after"))
    inside = Window.partitionBy("block").orderBy(F.desc("depart")).rangeBetween(Window.unboundedPreceding, -1)
    rides = rides.withColumn("block", F.floor(F.col("depart") / BLOCK)).withColumn("within", F.min("arrive").over(inside)).join(blocks, "block")
    best = F.least("after", "within")
    return rides.where(best.isNull() | (F.col("arrive") < best)).select("trip", "depart", "arrive")


def profile(events: DataFrame, origin, first: int, last: int, rounds: int = ROUNDS, walks: DataFrame | None = None, change: int = 0, boards: Column | None = None) -> DataFrame:
    """(stop, round, depart, arrival): for every stop the journeys that leave ``origin`` from ``first`` to ``last`` and that no other
    one beats: leaving no earlier, arriving no later, with no more boardings; nor a walk from ``origin``. Rules as in ``arrivals``.

    A round carries labels (stop, depart, arrival). An event takes the latest label that is ready by then, in one stream a stop;
    a ride carries the latest departure among its boardings so far; and what another label beats goes at once. So there are
    never pairs of labels and events, and a stop has at most a label for each departure and round."""
    spark = events.sparkSession
    e = _timetable(events, boards)
    links = spark.createDataFrame([(origin, 0)], "stop long, walk long")
    if walks is not None:
        links = links.unionByName(walks.where(F.col("from_stop") == F.lit(origin)).select(F.col("to_stop").cast("long").alias("stop"), F.col("seconds").cast("long").alias("walk")))
    links = settled(links.groupBy("stop").agg(F.min("walk").alias("walk")))
    # The times to leave at: those that just make a departure. A rider who left then may also wait for later ones.
    first_on = e.where("boards").join(links, "stop").select("trip", "seq", (F.col("depart") - F.col("walk")).alias("at"), F.lit(0).alias("from"))
    leaving = settled(first_on.where(F.col("at").between(first, last)).select("from", "at", F.col("at").alias("left")).distinct())
    known = frontier = spark.createDataFrame([], "stop long, depart long, arrival long, round int")
    for k in range(1, rounds + 1):
        if k == 1:
            on = asof(first_on, leaving, "from", "at", ["left"], strict=False, width=BLOCK)
        else:
            ready = frontier.select("stop", (F.col("arrival") + change).alias("at"), F.col("depart").alias("left"))
            on = asof(e.where("boards").withColumn("at", F.col("depart")), ready, "stop", "at", ["left"], strict=False, width=BLOCK)
        on = on.where("left is not null").select("trip", "seq", "left")
        w = Window.partitionBy("trip").orderBy("seq", "left").rowsBetween(Window.unboundedPreceding, 0)
        earlier = on.select("trip", "seq", F.max("left").over(w).alias("left"))
        rides = asof(e, earlier, "trip", "seq", ["left"]).where("left is not null")
        reached = rides.select("stop", F.col("left").alias("depart"), F.col("arrive").alias("arrival"))
        if walks is not None:
            reached = settled(reached.distinct())
            on_foot = reached.join(walks, reached["stop"] == walks["from_stop"]).select(walks["to_stop"].cast("long").alias("stop"), "depart", (F.col("arrival") + F.col("seconds")).cast("long").alias("arrival"))
            reached = reached.unionByName(on_foot)
        reached = reached.groupBy("stop", "depart").agg(F.min("arrival").alias("arrival")).join(links, "stop", "left")
        reached = reached.where(F.col("walk").isNull() | (F.col("arrival") - F.col("depart") < F.col("walk"))).drop("walk")  # else one walks
        both = known.unionByName(reached.select("stop", "depart", "arrival", F.lit(k).alias("round")))
        later = Window.partitionBy("stop").orderBy(F.desc("depart"), "arrival", "round").rowsBetween(Window.unboundedPreceding, -1)
        best = F.min("arrival").over(later)
        frontier = settled(both.withColumn("_best", best).where((F.col("round") == k) & (F.col("_best").isNull() | (F.col("arrival") < F.col("_best")))).drop("_best"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.select("stop", "round", "depart", "arrival")


def board(found: DataFrame, key: list[str], count: int) -> DataFrame:
    """(key, round, depart, arrival, place): the next ``count`` departures of each ``key`` among the journeys of ``profile``: the
    cheapest one, with five minutes charged for each change, then the cheapest of those that leave later, and so on. One that
    arrives with the row before it by more changes isn't a departure of its own."""
    cost = F.struct((F.col("arrival") + CHANGE_COST * (F.col("round") - 1)).alias("cost"), "depart")
    from_here = Window.partitionBy(*key).orderBy(F.desc("depart")).rangeBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("_cost", cost)
    rows = rows.withColumn("_least", F.min("_cost").over(from_here)).where(F.col("_cost") == F.col("_least"))
    rows = rows.groupBy(*key, "depart").agg(F.min(F.struct("round", "arrival")).alias("b")).select(*key, "depart", "b.round", "b.arrival")
    w = Window.partitionBy(*key).orderBy("depart")
    rows = rows.withColumn("_before", F.lag("arrival").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("arrival")))
    rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)
    return rows.select(*key, "round", "depart", "arrival", "place")


def carried(events: DataFrame, day_start: int) -> DataFrame:
    """Trips of an earlier service day that still run at ``day_start`` seconds of their own day: their events from then on, as
    seconds of the new day; a trip with fewer than two of them is over."""
    rest = events.where(F.col("depart") >= day_start)
    going = rest.groupBy("trip").agg(F.count("*").alias("_n")).where("_n >= 2")
    rest = rest.join(going, "trip", "left_semi")
    return rest.withColumns({"arrive": F.greatest("arrive", F.lit(day_start)) - day_start, "depart": F.col("depart") - day_start})
