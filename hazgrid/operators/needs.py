"""What travellers will need along a trip: periodic sequences of fuel, food and rest, merged by mile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.operators.asof import asof

# Needs that recur, and the kinds of food that one of them is drawn from.
FUELS, REST = ("Gas", "Diesel", "Electric"), "Rest"
FOOD = ("Fast food", "Pizza", "American", "Mexican", "Italian", "Chinese", "Greek", "Coffee", "Breakfast")
#: Of the draws: ((seed + k * STEP) * FACTOR mod MODULUS), whose products stay within 64 bits for seeds below 2 ** 40.
STEP, FACTOR, MODULUS = 7_919, 104_729, 1_000_003
#: Stops at most of a trip; one with more has none.
MOST = 1_000_000


def _drawn(seed: Column, k: Column) -> Column:
    kinds = F.array(*(F.lit(f"Food · {x}") for x in FOOD))
    return F.get(kinds, (F.pmod((seed + k * STEP) * FACTOR, F.lit(MODULUS)) % len(FOOD)).cast("int"))


def schedule(trips: DataFrame) -> DataFrame:
    """(trip, place, mile, need) of ``trips`` (trip, miles, seed, and intervals gas, diesel, electric, food, rest in miles): each need
    recurs after its interval, before the trip's end; food is drawn by the seed, the same in every run. Places go by mile,
    then by the need's name. Intervals that are null, no number or not above 0 never come due; a trip without miles has no rows."""
    needs = []
    for name, label in (("gas", FUELS[0]), ("diesel", FUELS[1]), ("electric", FUELS[2]), ("food", None), ("rest", REST)):
        every = F.col(name)
        due = F.when((every > 0) & ~F.isnan(every) & (F.col("miles") > every), F.ceil(F.col("miles") / every) - 1).otherwise(0).cast("long")
        needs.append(F.struct(due.alias("n"), every.cast("double").alias("every"), F.lit(label).cast("string").alias("label")))
    rows = trips.where((F.col("miles") > 0) & (F.col("miles") < float("inf"))).select("trip", "miles", "seed", F.array(*needs).alias("_needs"))
    rows = rows.where(F.aggregate("_needs", F.lit(0).cast("long"), lambda t, x: t + x["n"]) <= MOST)
    rows = rows.select("trip", "miles", "seed", F.explode("_needs").alias("x")).where("x.n > 0").select("trip", "miles", "seed", "x.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.n"))).alias("k"))
    rows = rows.select("trip", "miles", (F.col("every") * F.col("k")).alias("mile"), F.coalesce("label", _drawn(F.col("seed"), F.col("k"))).alias("need")).where("mile < miles")
    w = Window.partitionBy("trip").orderBy("mile", "need")
    return rows.select("trip", F.row_number().over(w).alias("place"), "mile", "need")


def next_needs(stops: DataFrame, marks: DataFrame, width: float = 1000.0) -> DataFrame:
    """``marks`` (trip, mile, ...) with the place, mile and name of the first stop of their trip beyond them, null without one."""
    ahead = stops.select("trip", F.col("mile").cast("double").alias("mile"), "place", F.col("mile").alias("next_mile"), "need")
    first = ahead.groupBy("trip", "mile").agg(F.min(F.struct("place", "next_mile", "need")).alias("s")).select("trip", "mile", "s.*")
    return asof(marks.withColumn("mile", F.col("mile").cast("double")), first, "trip", "mile", ["place", "next_mile", "need"], width=width, forward=True)
