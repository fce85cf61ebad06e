"""Token counts: the exact histogram of encoded lengths, and suffix sums that answer for every context limit.

Scale: a text becomes one number where it is read; numbers are counted before they are shuffled. The histogram has at most
as many rows as the longest text has tokens. Its suffix sums are windows over blocks of lengths, then over the few block
totals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.llm.common import written
from hazgrid.llm.tokens import gathered, word_encoder

BLOCK = 256


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and n_tokens of each whole text (0 for null and empty texts)."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for part in gathered(batches, "_text"):
            _, lengths = encoder.encode(part.column("_text"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lengths, pa.int64())], [*part.schema.names[:-1], "n_tokens"])

    return source.mapInArrow(count, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of every length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: n_docs of just that length, docs_le and docs_ge (documents
    up to it and from it on), tokens_ge (all tokens of the latter), total_tokens, truncated_tokens (what all documents
    keep when cut to the limit) and lost_tokens. Between two lengths that occur, truncated totals are linear in the limit.
    An empty histogram gives no rows."""
    h = histogram.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_sum"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def above(column: str) -> Column:
        return F.coalesce(F.sum(column).over(later), F.lit(0))

    blocks = blocks.select(
        "_block", above("_docs").alias("_docs_above"), above("_sum").alias("_sum_above"),
        F.sum("_docs").over(everything).alias("_all_docs"), F.sum("_sum").over(everything).alias("total_tokens"),
    )
    down = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumns({"_docs_in": F.sum("n_docs").over(down), "_sum_in": F.sum("_tokens").over(down)}).join(blocks, "_block")
    h = h.withColumns({"docs_ge": F.col("_docs_in") + F.col("_docs_above"), "tokens_ge": F.col("_sum_in") + F.col("_sum_above")})
    lost = F.col("tokens_ge") - F.col("n_tokens") * F.col("docs_ge")
    return h.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("_all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"), "docs_ge", "tokens_ge", "total_tokens",
        (F.col("total_tokens") - lost).alias("truncated_tokens"), lost.alias("lost_tokens"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row: for each of ``limits``, tokens that remain when all documents are cut to it."""
    return histogram.agg(*(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias(f"upto_{limit}") for limit in limits))


def length_quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """One row: for each share, the least length that at least that share of documents do not exceed (null without documents)."""
    docs = F.col("docs_le") + F.col("docs_ge") - F.col("n_docs")
    return limits.agg(*(F.min(F.when(F.col("docs_le") >= F.lit(q) * docs, F.col("context_limit"))).alias(f"q{round(100 * q)}") for q in shares))


def op7_token_counts(spark, sf_dir):
    """The histogram of encoded lengths of all documents, with totals for every limit."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    histogram = length_histogram(encoded_lengths(docs, public_tokenizers.path("word_bpe_49k.json")))
    return context_limits(written(histogram, "histogram"))  # read twice: written, so that texts are encoded once
