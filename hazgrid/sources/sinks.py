"""Writers. Tables are Parquet, clustered by what their readers prune on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_field(df: DataFrame, path: str) -> None:
    """A risk field, sorted by grid cell within files, so that boxes prune row groups."""
    df.repartitionByRange("cell_row", "cell_column").sortWithinPartitions("cell_row", "cell_column").write.mode("overwrite").parquet(path)


def write_places(df: DataFrame, path: str) -> None:
    """Places by state, each state's files in cell order."""
    df.repartition("state", "cell_row").sortWithinPartitions("state", "cell_row", "cell_column").write.mode("overwrite").partitionBy("state").parquet(path)


def write_timetable(stop_times: DataFrame, path: str, buckets: int, table: str) -> None:
    """Stop events bucketed by trip, so that joins of trips with themselves don't shuffle."""
    stop_times.write.mode("overwrite").option("path", path).bucketBy(buckets, "trip_id").sortBy("trip_id", "stop_sequence").saveAsTable(table)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
