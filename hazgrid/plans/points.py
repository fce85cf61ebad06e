"""The driver's tables as hazard inputs: places, readings and trips derived from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The event types of the test stream and the hazard families that they stand for.
FAMILY_OF = {"error": "closure", "purchase": "storm", "view": "wind", "click": "heat", "signup": "air"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def family_of(column: str = "event_type"):
    return F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY_OF.items() for x in kv]), F.col(column))


FAMILY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY_OF.items()) + " END"


def place(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points from keys, spread over 25..50 by -120..-70 degrees."""
    k = F.col(key).cast("long")
    return df.withColumns({lat: 25 + F.pmod(k * 7919, F.lit(1000)) / 40.0, lon: -120 + F.pmod(k * 104729, F.lit(1000)) / 20.0})


def place_sql(key: str, lat: str = "lat", lon: str = "lon") -> str:
    return f"25 + (CAST({key} AS BIGINT) * 7919 % 1000) / 40.0 AS {lat}, -120 + (CAST({key} AS BIGINT) * 104729 % 1000) / 20.0 AS {lon}"


METERS_SQL = "sqrt(power((rlat - lat) * 111320.0, 2) + power((rlon - lon) * 111320.0 * cos(radians((lat + rlat) / 2)), 2))"
