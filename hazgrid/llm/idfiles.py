"""Token-id files: whole texts encoded, written in ascending doc_id order, and read back.

The file format is a Parquet table of segments: shard and segment (their order is that of doc_id), the doc_ids in a
segment, and the segment's bytes as ``idcoder`` makes them. Spark writes and commits it like any table, so lost executors
cost a retry and any store that Spark writes to will do.

Scale: one range partitioning by doc_id (ties by text); a segment holds whole documents of about SEGMENT ids, and its
blocks decode alone. Where documents start is a sum over segments of a shard and one over shards: no step sees all rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazgrid.llm.common import shared_dir
from hazgrid.llm.idcoder import BLOCK, LANES, decode_segment, encode_segment
from hazgrid.llm.tokens import gathered, word_encoder

SEGMENT = BLOCK * LANES
FILES = "shard int, segment int, n_docs long, n_ids long, doc_ids binary, no_id binary, ids binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode each whole text (null: empty), append ``end_id``, and write the ids in ascending doc_id order to ``path``.

    Documents without doc_id come first; repeated doc_ids are documents of their own, in order of a hash of their text.
    Further columns are ignored; an empty table writes an empty one.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        shard, segment = TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, n = pa.concat_arrays(keys), np.concatenate(lengths)
            no_id = np.packbits(key.is_null().to_numpy(zero_copy_only=False)).tobytes()
            doc_ids = key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            row = {"shard": shard, "segment": segment, "n_docs": len(n), "n_ids": int(n.sum()), "doc_ids": doc_ids, "no_id": no_id, "ids": encode_segment(n, np.concatenate(ids))}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for part in gathered(batches, "_text"):
            found, n = encoder.encode(part.column("_text"))
            ends = np.cumsum(n)
            found, n = np.insert(found, ends, end_id), n + 1  # each document's end follows its ids
            ends += np.arange(1, len(n) + 1)
            first = 0
            while first < len(n):  # whole documents until the segment is full
                start = ends[first] - n[first]
                last = min(len(n), int(np.searchsorted(ends, start + SEGMENT - size, side="left")) + 1)
                keys.append(part.column("doc_id").slice(first, last - first))
                lengths.append(n[first:last])
                ids.append(found[start : ends[last - 1]])
                size, first = size + int(ends[last - 1] - start), last
                if size >= SEGMENT:
                    yield flush()
                    keys, lengths, ids, size, segment = [], [], [], 0, segment + 1
        if keys:
            yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    ordered = source.repartitionByRange("doc_id", F.xxhash64("_text")).sortWithinPartitions("doc_id", F.xxhash64("_text"))
    ordered.mapInArrow(run, FILES).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the files at ``path``, all
    checksums verified; with_ids adds the ids themselves (array<int>)."""
    files = spark.read.schema(FILES).parquet(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, ids = decode_segment(row["ids"])
                wide = ids.astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                sums = [zlib.crc32(wide[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=row["n_docs"]).astype(bool)
                n = len(lengths)
                columns = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=no_id), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["segment"], np.int32)),
                    pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ids.size).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "segment", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    docs = files.mapInArrow(run, "doc_id long, shard int, segment int, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    above = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_segment_start")).join(shards, "shard")
    joined = docs.join(segments, ["shard", "segment"])
    return joined.select("doc_id", (F.col("_shard_start") + F.col("_segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op1_token_id_files(spark, sf_dir):
    """Ids of all documents, written to files and read back from them."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-ids/{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path)
