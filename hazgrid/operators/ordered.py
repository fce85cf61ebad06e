"""Operators along a path: running sums, prefixes, grades, spans and cuts. A path is a partition key and an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative(df: DataFrame, path: list[str], order: list[str], length: Column) -> DataFrame:
    w = Window.partitionBy(*path).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("along", F.sum(length).over(w))


def prefix(df: DataFrame, path: list[str], order: list[str], length: str, limit: float) -> DataFrame:
    """Rows of a path up to ``limit`` along it; the row that passes it stays with what is left of its length."""
    df = cumulative(df, path, order, F.col(length))
    start = F.col("along") - F.col(length)
    return df.where(start < limit).withColumn("kept", F.least(F.col(length), limit - start))


def grade_segments(df: DataFrame, path: list[str], order: list[str], elevation: str, length: str) -> DataFrame:
    """Percent of grade from each known elevation to the next one."""
    w = Window.partitionBy(*path).orderBy(*order)
    known = df.where(F.col(elevation).isNotNull())
    return known.withColumn("_next", F.lead(elevation).over(w)).where(F.col("_next").isNotNull() & (F.col(length) > 0)).withColumn("grade", 100 * (F.col("_next") - F.col(elevation)) / F.col(length)).drop("_next")


def spans(df: DataFrame, path: list[str], order: list[str], inside: Column) -> DataFrame:
    """Maximal runs of rows where ``inside`` holds: first and last order value and number of rows."""
    w = Window.partitionBy(*path).orderBy(*order)
    df = df.withColumns({"_in": F.coalesce(inside, F.lit(False)), "_all": F.row_number().over(w)}).where("_in")
    df = df.withColumn("_run", F.col("_all") - F.row_number().over(w))
    return df.groupBy(*path, "_run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n_rows")).drop("_run")


def local_low(df: DataFrame, path: list[str], order: list[str], value: str, reach: int = 4) -> DataFrame:
    w = Window.partitionBy(*path).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("local_low", F.min(value).over(w))


def nearest_known(df: DataFrame, path: list[str], order: list[str], value: str, reach: int = 2) -> DataFrame:
    """``value``, or the nearest known one within ``reach`` rows, the earlier first."""
    w = Window.partitionBy(*path).orderBy(*order)
    tries = [F.col(value)]
    for k in range(1, reach + 1):
        tries += [F.lag(value, k).over(w), F.lead(value, k).over(w)]
    return df.withColumn("known", F.coalesce(*tries))
