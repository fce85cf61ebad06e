"""Best-fit decreasing packing of token ids into windows of one length, and the cuts that leave no padding.

A document longer than a window is first cut into full windows, which are sequences as they are. The rests are dealt by a
hash of their row into groups of bounded size. In a group they go, longest first, into the open window with the least room
that holds them, found by a segment tree over remaining capacities. Last, the windows that stay part filled are topped up
from the emptiest of them, and the one that is left over is cut at powers of two, which need no padding.

Scale: one pass over the texts and one shuffle, which carries the ids of rests (two bytes each) and a few numbers of full
windows. The number of groups follows from a count of rows. A group holds about ``group`` rests, so copies, a hot source or
a long text change nothing: its full windows spread over all groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.tokens import ByteEncoder, gathered, word_encoder

WINDOW, END, GROUP = 2048, 1, 4096

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary, part int"


class Capacities:
    """Open windows by remaining capacity: a segment tree that counts them, with the windows of each capacity as a stack."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(top + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += n
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) of a window with the least capacity from ``least`` on, which is then no longer open."""
        counts, node = self.counts, least + self.leaves
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):  # up to a node with something to its right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Indices of ``lengths`` (1 to ``window``) in each window that is opened."""
    windows: list[list[int]] = []
    room = Capacities(window)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = room.take(lengths[i])
        if found is None:
            left, at = window, len(windows)
            windows.append([])
        else:
            left, at = found
        windows[at].append(i)
        if left > lengths[i]:
            room.put(left - lengths[i], at)
    return windows


Piece = tuple[int, int, int]  # index, start in it, length


def top_up(windows: list[list[int]], lengths: list[int], window: int = WINDOW) -> list[list[Piece]]:
    """``windows`` as sequences of pieces of which none needs padding: the fullest of the part filled ones take what they lack
    from the emptiest, which cuts a piece where it is longer than the gap, and the last is cut at powers of two."""
    used = [sum(lengths[i] for i in w) for w in windows]
    full = [[(i, 0, lengths[i]) for i in w] for w, n in zip(windows, used, strict=True) if n == window]
    partly = sorted((k for k, n in enumerate(used) if n < window), key=lambda k: (-used[k], k))
    pieces = [[(i, 0, lengths[i]) for i in windows[k]] for k in partly]
    room = [window - used[k] for k in partly]
    first, last = 0, len(pieces) - 1
    while first < last:
        if not room[first]:
            first += 1
        elif not pieces[last]:
            last -= 1
        else:
            i, start, length = pieces[last].pop()
            moved = min(length, room[first])
            pieces[first].append((i, start, moved))
            room[first] -= moved
            if moved < length:
                pieces[last].append((i, start + moved, length - moved))
    done = full + pieces[:first]
    for rest in pieces[first : first + 1]:
        left = sum(p[2] for p in rest)
        for size in (1 << k for k in reversed(range(window.bit_length()))):
            if size <= left:
                taken, left = [], left - size
                while size:
                    i, start, length = rest.pop()
                    moved = min(length, size)
                    taken.append((i, start, moved))
                    size -= moved
                    if moved < length:
                        rest.append((i, start + moved, length - moved))
                done.append(taken)
    return [p for p in done if p]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(tokenizer: str, window: int, end: int, groups: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full windows with their checksum and number, and the rests with their ids."""
        encoder, n_full = word_encoder(tokenizer, ByteEncoder), 0
        for batch in gathered(batches, "_text"):
            ids, lengths = encoder.encode(batch.column("_text"))
            ends = np.cumsum(lengths)
            found: list[list] = [[] for _ in range(9)]
            for row, doc_id, stop, n in zip(batch.column("_row").to_pylist(), batch.column("_doc").to_pylist(), ends.tolist(), lengths.tolist(), strict=True):
                of = np.append(ids[stop - n : stop], np.uint16(end))
                for start in range(0, n + 1, window):
                    some = of[start : start + window]
                    whole = len(some) == window
                    # Odd numbers: a partition's share of rows has its own upper bits in the row number.
                    sequence = 2 * ((row >> 33 << 40) + n_full) + 1 if whole else None
                    n_full += whole
                    part = (row * 0x9E3779B1 + start // window) % groups
                    values = (row, doc_id, start, len(some), _crc(some) if whole else None, n + 1, sequence, None if whole else some.tobytes(), part)
                    for column, value in zip(found, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, [*[pa.int64()] * 7, pa.binary(), pa.int32()], strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    return cut


def packed_windows(docs: DataFrame, tokenizer: str, text: str = "text", window: int = WINDOW, end: int = END, group: int = GROUP) -> DataFrame:
    """Where each id of ``docs`` (doc_id, text) lies: a row for each piece with doc_id, start (its document's ids before it),
    length, ids_crc32, doc_tokens (with the end id), sequence_id and offset in the sequence.

    ``tokenizer`` is a byte-level one with ids under 65536, of which ``end`` closes each document. ``window`` is a power of two;
    no sequence is longer, and each is as long as it or a smaller power of two. Null and empty texts are the end id alone.
    Rows with equal or null doc_id are documents of their own. Further columns are ignored, and an empty table gives no rows.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    groups = max(1, -(-docs.count() // group))
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col(text).alias("_text"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        out: list[list] = [[] for _ in range(7)]

        def add(*values) -> None:
            for column, value in zip(out, values, strict=True):
                column.append(value)

        rests = []
        for x in table.to_pylist():
            if x["ids"] is None:
                add(x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"], x["sequence_id"], 0)
            else:
                rests.append(x)
        lengths = [x["length"] for x in rests]
        for k, pieces in enumerate(top_up(best_fit_decreasing(lengths, window), lengths, window)):
            sequence, offset = 2 * ((table["part"][0].as_py() << 32) + k), 0
            for i, start, length in pieces:
                x = rests[i]
                add(x["doc_id"], x["start"] + start, length, _crc(np.frombuffer(x["ids"], np.uint16)[start : start + length]), x["doc_tokens"], sequence, offset)
                offset += length
        return pa.table({name.split()[0]: pa.array(values, pa.int64()) for name, values in zip(RESULT.split(", "), out, strict=True)})

    return source.mapInArrow(_pieces(tokenizer, window, end, groups), _PIECES).groupBy("part").applyInArrow(place, RESULT)


def op11_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 2048 ids at most."""
    import public_tokenizers

    return packed_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
