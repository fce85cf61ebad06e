"""As-of joins: for each row, the latest row of another table up to its time, or the next one from it on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame, right: DataFrame, key: str | list[str], time: str | list[str], values: list[str], strict: bool = True, width: float | None = None, forward: bool = False
) -> DataFrame:
    """``left`` with ``values`` of the latest ``right`` row of the same key before (or, unless strict, at) its time; forward,
    of the first one after (or at) it. Of ``time`` the first column is a number or an instant, further ones break ties.

    Both sides are put in one ordered stream a key and the last right row is carried on: one shuffle, no pairs. ``width``, in
    units of the time (seconds for instants), splits each key into blocks of that much time, which lie in different tasks; what
    a block has to carry on goes through a row for each block, and comes to a later block as its first row, so nothing is joined.
    So a hot key is no single task, and matches may lie any time apart.
    """
    keys, times = [key] if isinstance(key, str) else list(key), [time] if isinstance(time, str) else list(time)
    at = F.struct(*(F.col(t).alias(f"t{i}") for i, t in enumerate(times)))
    axis = F.col(times[0])
    if dict(left.dtypes)[times[0]].startswith("timestamp"):
        axis = axis.cast("timestamp")
    axis = axis.cast("double") / (width or 1)
    block = F.floor(-axis if forward else axis) if width else F.lit(0).cast("long")
    first = 1 if strict else 0  # where right rows come among those of one time, in either direction
    whole = F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType)
    tagged = right.select(*keys, block.alias("_b"), at.alias("_t"), F.lit(first).alias("_o"), F.struct(*values).alias("_v"), whole.alias("_l"))
    rows = left.select(*keys, block.alias("_b"), at.alias("_t"), F.lit(1 - first).alias("_o"), F.lit(None).cast(tagged.schema["_v"].dataType).alias("_v"), F.struct("*").alias("_l"))
    stream = rows.unionByName(tagged)

    if width:
        kept = F.when(F.col("_v").isNotNull(), F.col("_t"))
        blocks = stream.groupBy(*keys, "_b").agg((F.min_by if forward else F.max_by)("_v", kept).alias("_e"))
        before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        brought = blocks.withColumn("_v", F.last("_e", ignorenulls=True).over(before)).where(F.col("_v").isNotNull())
        empty = [F.lit(None).cast(tagged.schema[c].dataType).alias(c) for c in ("_t", "_o", "_l")]
        stream = stream.unionByName(brought.select(*keys, "_b", "_v", *empty))

    order = F.desc_nulls_first if forward else F.asc_nulls_first  # what a block is brought comes before its rows
    w = Window.partitionBy(*keys, "_b").orderBy(order("_t"), "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stream.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    return carried.select("_l.*", *(F.col(f"_last.{v}").alias(v) for v in values))
