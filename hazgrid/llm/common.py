"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazgrid.operators.shared import settled as checkpointed
from hazgrid.operators.shared import shared_dir

__all__ = ["SPACES", "SPACE_CLASS", "checkpointed", "let", "shared_dir", "table", "whole_text", "written"]

#: The characters that separate words: space and the five ASCII controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside lambdas where no projection can hold it."""
    return F.element_at(F.transform(F.array(value), body), 1)
