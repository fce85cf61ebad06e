"""The folder that driver and executors share, for tables between the steps of a job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder under the warehouse, or of this machine in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hazgrid-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/hazgrid-checkpoints")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder, for small intermediate tables: later steps neither recompute it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled_by(df: DataFrame, key: str) -> DataFrame:
    """``settled``, spread by ``key`` over the session's number of shuffle partitions, so that joins and aggregates by it don't move
    the table again. Adaptive execution is off for this job, since its plans don't tell how their result is spread."""
    spark = df.sparkSession
    spread = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settled(spread)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
