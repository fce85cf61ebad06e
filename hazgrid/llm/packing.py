"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Scale: only lengths travel. Pieces are dealt by a hash of row and piece into groups of bounded size, each packed on its
own, so no group grows with the data and copies or a hot source change nothing; a group leaves a few bins part filled,
which downsizing then shrinks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.common import written
from hazgrid.llm.lengths import encoded_lengths

#: Permitted sequence lengths, in tokens.
SIZES = (1024, 2048, 4096, 8192, 16384)
#: Cost of a sequence of c tokens: OVERHEAD + c + c * c / QUADRATIC, for its fixed, linear and attention work.
OVERHEAD, QUADRATIC = 64, 262_144
#: Pieces in a group.
GROUP = 4096

RESULT = "row long, doc_id long, piece long, token_start long, length long, bin_id long, bin_size long, bin_offset long"


def best_fit(lengths: list[int], sizes: tuple[int, ...]) -> list[tuple[int, int]]:
    """(bin, offset) of each of ``lengths``, which come longest first and within the largest of ``sizes``.

    A piece goes to the open bin that it leaves the least room in. Without one, a bin of the size with the least cost for
    each token that it can be expected to hold opens: the piece itself, and of its remaining room what the pieces still to
    come that fit there can fill.
    """
    suffix = [0, *accumulate(reversed(lengths))][::-1]
    rising = [-x for x in lengths]
    free: list[tuple[int, int]] = []
    place, room, n_bins = [], {}, 0
    for i, length in enumerate(lengths):
        k = bisect_left(free, (length, -1))
        if k < len(free):
            left, b = free.pop(k)
        else:

            def price(c: int, i: int = i, length: int = length) -> tuple[float, int]:
                to_come = suffix[max(i + 1, bisect_left(rising, length - c))]
                return (OVERHEAD + c + c * c / QUADRATIC) / (length + min(c - length, to_come)), c

            left = b = n_bins
            left = room[b] = min((c for c in sizes if c >= length), key=price)
            n_bins += 1
        place.append((b, room[b] - left))
        if left > length:
            insort(free, (left - length, b))
    return place


def pack(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, group: int = GROUP) -> DataFrame:
    """``lengths`` (doc_id, n_tokens) as placed pieces: doc_id, piece, token_start, length, bin_id, bin_size, bin_offset; see
    ``placed`` for the rest."""
    rows = written(lengths.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_tokens"), "lengths")
    return placed(rows, sizes, group).drop("row")


def placed(rows: DataFrame, sizes: tuple[int, ...] = SIZES, group: int = GROUP) -> DataFrame:
    """``rows`` (row, doc_id, n_tokens), written ones whose row tells them apart, as placed pieces.

    A document longer than the largest size is cut into pieces of it and a rest. Documents of null or less than one token
    take one token (their end). Repeated doc_ids are documents of their own; a null doc_id stays null. Each bin finally has
    the least permitted size that holds its contents. Empty input gives no rows; further columns are ignored.
    """
    sizes = tuple(sorted(sizes))
    top = sizes[-1]
    tokens = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(1)).cast("long")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("_n"), F.col("row").alias("_row"))
    n_pieces = rows.agg(F.sum(F.ceil(F.col("_n") / top))).first()[0] or 0
    groups = max(1, -(-n_pieces // group))
    pieces = rows.select("doc_id", "_n", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / top))).alias("piece"))
    pieces = pieces.select(
        "doc_id", "piece", (F.col("piece") * top).alias("token_start"), F.least(F.lit(top), F.col("_n") - F.col("piece") * top).alias("length"), "_row",
        F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)).alias("_group"),
    )

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row", "piece"], ascending=[False, True, True], ignore_index=True)
        at = pd.DataFrame(best_fit(frame["length"].tolist(), sizes), columns=["_bin", "bin_offset"], dtype="int64")
        used = frame["length"].groupby(at["_bin"]).transform("sum")
        frame["bin_size"] = [sizes[bisect_left(sizes, x)] for x in used]
        frame["bin_id"] = frame["_group"] * 2**32 + at["_bin"]
        frame["bin_offset"] = at["bin_offset"]
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame["row"] = frame["_row"]
        return frame[["row", "doc_id", "piece", "token_start", "length", "bin_id", "bin_size", "bin_offset"]]

    return pieces.groupBy("_group").applyInPandas(place, RESULT)


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens): the tokens of each whole text (null: empty) and an end token."""
    return encoded_lengths(docs, tokenizer, keep=("doc_id",)).withColumn("n_tokens", F.col("n_tokens") + 1)


def sequences(docs: DataFrame, sizes: tuple[int, ...] = SIZES, group: int = GROUP) -> DataFrame:
    """The training sequences of ``docs`` (doc_id, ids array<int>): bin_id, bin_size, ids in order (an id 0 for a document
    without any) and doc_ids and offsets of the pieces in it. A sequence is no longer than the largest size, so gathering
    its pieces into a row is bounded."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(F.lit(0))).alias("ids")), "ids")
    pieces = placed(rows.select("row", "doc_id", F.size("ids").cast("long").alias("n_tokens")), sizes, group)
    part = F.slice("ids", (F.col("token_start") + 1).cast("int"), F.col("length").cast("int"))
    pieces = pieces.join(rows.select("row", "ids"), "row").select("bin_id", "bin_size", F.struct("bin_offset", "doc_id", part.alias("ids")).alias("p"))
    bins = pieces.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return bins.select("bin_id", "bin_size", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.bin_offset").alias("offsets"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Where the pieces of each document lie in the sequences, by the lengths of the tokenizer ``word_bpe_49k``."""
    import public_tokenizers

    return pack(token_lengths(docs, public_tokenizers.path("word_bpe_49k.json")))


def op6_best_fit_packing(spark, sf_dir):
    """Pieces of all documents in sequences of five sizes."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
