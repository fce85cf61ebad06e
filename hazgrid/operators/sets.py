"""Unions with priorities, and what joins on keys say about sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_by_priority(tables: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all tables, one a key: the earlier table wins, then ``order``."""
    tagged = [t.withColumn("priority", F.lit(i)) for i, t in enumerate(tables)]
    w = Window.partitionBy(*keys).orderBy("priority", *order)
    return reduce(DataFrame.unionByName, tagged).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_with_offsets(feeds: list[DataFrame], id_column: str, sizes: list[int]) -> DataFrame:
    """Feeds one after another, each feed's ids moved past those before it; feed_no tells them apart."""
    out, offset = [], 0
    for no, (feed, size) in enumerate(zip(feeds, sizes, strict=True)):
        out.append(feed.withColumns({id_column: F.col(id_column) + offset, "feed_no": F.lit(no)}))
        offset += size
    return reduce(DataFrame.unionByName, out)
