"""Compression of vectors to codes: each of several equal parts of a vector becomes the number of the nearest entry of its
part position's codebook, and the codebooks are trained by rounds of assigning and averaging, all in integers.

The nearest entry is searched in a vantage-point tree over the entries of a part position: a node keeps how far its inner
entries reach and where its outer ones begin, rounded outwards, and a branch is left out only if its bound lies beyond the
best distance so far; a branch at just that distance is visited, so the lowest index wins a tie. Distances of entries
that are visited are exact integers.

Scale: a round is one pass over the vectors that gives each task's sums of parts by entry, at most entries x parts rows a
task, added up in a shuffle. Only codebooks, whose size the parameters fix, come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.common import checkpointed, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf; labels whose totals are sent to all executors.
LEAF, BROADCAST_LABELS = 8, 65_536
#: Rows in work at a time, and what a distance computed as a root of a rounded square can be off by, relatively.
ROWS, SLACK = 8192, 1e-14
#: Components below this are worked on in 64 bits, for parts of up to 256 components.
NARROW = 1 << 26
LONG_MAX = 2**63 - 1


@dataclass
class Node:
    """A leaf with ``entries``, or a vantage entry with the entries within ``reach`` of it and those from ``begin`` on."""

    entries: np.ndarray
    vantage: int = -1
    reach: float = 0.0
    begin: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(axis=-1)


def _root(squares: np.ndarray) -> np.ndarray:
    """Distances as floats; not a number where integers are too long for one, which no bound then rules out."""
    try:
        return np.sqrt(squares.astype(np.float64))
    except OverflowError:
        return np.full(len(squares), np.nan)


def tree(book: np.ndarray, some: np.ndarray | None = None) -> Node:
    """A vantage-point tree over ``some`` (all) entries of ``book``."""
    some = np.arange(len(book)) if some is None else some
    if len(some) <= LEAF:
        return Node(np.sort(some))
    vantage, rest = int(some[0]), some[1:]
    squares = _squares(book[rest], book[vantage])
    order = np.argsort(squares, kind="stable")
    half = len(rest) // 2
    inner, outer = rest[order[:half]], rest[order[half:]]
    reach, begin = _root(squares[order[[half - 1, half]]]).tolist()
    return Node(some, vantage, reach * (1 + SLACK), begin * (1 - SLACK), tree(book, inner), tree(book, outer))


def nearest(x: np.ndarray, book: np.ndarray, root: Node) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry of ``book``, its squared distance) of each row of ``x``; ties go to the lower index."""
    best = _squares(x, book[root.entries[0]])
    index = np.full(len(x), root.entries[0])

    def take(rows: np.ndarray, squares: np.ndarray, entry: np.ndarray | int) -> None:
        better = (squares < best[rows]) | ((squares == best[rows]) & (entry < index[rows]))
        best[rows[better]] = squares[better]
        index[rows[better]] = entry[better] if isinstance(entry, np.ndarray) else entry

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.vantage < 0:
            squares = ((x[rows, None, :] - book[None, node.entries, :]) ** 2).sum(axis=2)
            least = squares.argmin(axis=1)
            take(rows, squares[np.arange(len(rows)), least], node.entries[least])
            return
        squares = _squares(x[rows], book[node.vantage])
        take(rows, squares, node.vantage)
        away = _root(squares)
        inside = away <= (node.reach + node.begin) / 2

        def go(branch: Node, among: np.ndarray) -> None:
            bound = away * (1 - SLACK) - node.reach if branch is node.inner else node.begin - away * (1 + SLACK)
            visit(branch, rows[among & ~(bound > _root(best[rows]) * (1 + SLACK))])

        go(node.inner, inside)
        go(node.outer, ~inside)
        go(node.outer, inside)
        go(node.inner, ~inside)

    visit(root, np.arange(len(x)))
    return index, best


def _integers(vectors: pa.Array) -> np.ndarray:
    """Floors of SCALE times the components of vectors of one length, as rows; of Python's integers where 64 bits may not do."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    if not flat.size or np.abs(flat).max() < NARROW / SCALE:
        return np.floor(flat * SCALE).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 2**52 else math.floor(v * SCALE) for v in row] for row in flat.tolist()], object)


class Codebooks:
    """Entries by part position, and their trees."""

    def __init__(self, books: list[list[list[int]]]):
        wide = any(abs(x) >= NARROW for book in books for entry in book for x in entry)
        width = len(books[0][0]) if books and books[0] else 0
        self.books = [np.array(book, object if wide else np.int64).reshape(len(book), width) for book in books]
        self.trees = [tree(book) for book in self.books]
        self.dims = len(books) * width

    def digest(self) -> str:
        """sha256 of all components as decimal integers, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book.tolist() for x in entry).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry numbers by row and part, squared distances summed over parts) of rows of integers."""
        parts = x.reshape(len(x), len(self.books), -1)
        found = [nearest(parts[:, p], book, root) for p, (book, root) in enumerate(zip(self.books, self.trees, strict=True))]
        return np.stack([f[0] for f in found], axis=1), sum(f[1].astype(object) for f in found)


def _usable(vector: Column) -> Column:
    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))

    return vector.isNotNull() & F.forall(vector, finite)


def usable_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """_id, _vector and _label of the rows whose vector is there and holds finite components only."""
    whole = vectors.where(_usable(F.col(vector)))
    return whole.select(F.col("vec_id").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"), (F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")).alias("_label"))


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows and their integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _integers(part.column("_vector"))


def _of_length(rows: DataFrame, books: Codebooks) -> DataFrame:
    return rows.where(F.size("_vector") == books.dims)


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """Parts of the vectors with the least ids (of equal ids: the least vectors; null ids last). None without vectors, or if the
    first one's length isn't a multiple of ``parts``."""
    first = rows.orderBy(F.asc_nulls_last("_id"), F.asc("_vector")).select("_vector").limit(1).collect()
    if not first or not first[0][0] or len(first[0][0]) % parts:
        return None
    least = rows.where(F.size("_vector") == len(first[0][0])).orderBy(F.asc_nulls_last("_id"), F.asc("_vector")).select("_vector").limit(entries).collect()
    x = _integers(pa.array([r[0] for r in least], pa.list_(pa.float64()))).reshape(len(least), parts, -1)
    return Codebooks([x[:, p].tolist() for p in range(parts)])


def trained(rows: DataFrame, books: Codebooks) -> Codebooks:
    """``books`` after a round: each entry becomes the floor of the mean of the parts that it is nearest to; unused ones stay."""
    n_parts, n_entries = len(books.books), len(books.books[0])

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books.dims // n_parts
        total, counts = np.zeros((n_parts, n_entries, width), object), np.zeros((n_parts, n_entries), np.int64)
        for _, x in _batches(batches):
            index, _ = books.assign(x)
            for p in range(n_parts):
                part = np.zeros((n_entries, width), x.dtype)
                np.add.at(part, index[:, p], x.reshape(len(x), n_parts, -1)[:, p])
                total[p] += part
                counts[p] += np.bincount(index[:, p], minlength=n_entries)
        at = np.argwhere(counts)
        values = [[str(v) for v in total[p, e]] for p, e in at]
        longs = [pa.array(x, pa.int64()) for x in (at[:, 0] * n_entries + at[:, 1], counts[at[:, 0], at[:, 1]])]
        yield pa.RecordBatch.from_arrays([*longs, pa.array(values, pa.list_(pa.string()))], ["at", "n", "sums"])

    def mean(key: tuple, batches: pa.Table) -> pa.Table:
        n = sum(batches["n"].to_pylist())
        whole = [sum(int(v) for v in column) for column in zip(*batches["sums"].to_pylist(), strict=True)]
        return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "entry": pa.array([[str(v // n) for v in whole]], pa.list_(pa.string()))})

    partial = _of_length(rows, books).select("_vector").mapInArrow(sums, "at long, n long, sums array<string>")
    new = [book.tolist() for book in books.books]
    for r in partial.groupBy("at").applyInArrow(mean, "at long, entry array<string>").collect():  # no more rows than entries
        new[r["at"] // n_entries][r["at"] % n_entries] = [int(v) for v in r["entry"]]
    return Codebooks(new)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = trained(rows, books)
    return books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """_id, _label, code (two hex digits a part) and error (squared distances summed over parts, 2**63 - 1 at most) of ``rows``."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _batches(batches):
            index, errors = books.assign(x)
            flat = index.astype(np.uint8).tobytes().hex()
            n = 2 * index.shape[1]
            codes = [flat[at : at + n] for at in range(0, len(flat), n)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), pa.array(codes, pa.string()), pa.array([min(e, LONG_MAX) for e in errors], pa.int64())], ["_id", "_label", "code", "error"])

    shape = rows.select("_id", "_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    return _of_length(rows, books).select("_id", "_label", "_vector").mapInArrow(assign, shape)


def label_errors(rows: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``rows`` (written ones: they are read twice) and label_error, the error summed over rows with the same _label (nulls are
    one), 2**63 - 1 at most.

    Totals of up to ``broadcast_labels`` labels are sent to all executors. Of more, those that have more than their share of
    rows are: there are fewer than ``broadcast_labels`` of them, and no other label is hot.
    """
    totals = rows.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n"))
    totals = checkpointed(totals.select(F.col("_label").alias("_of"), F.least("_sum", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"), "_n"))
    same = F.col("_label").eqNullSafe(F.col("_of"))
    if totals.count() <= broadcast_labels:
        return rows.join(F.broadcast(totals), same).drop("_of", "_n")
    n = totals.agg(F.sum("_n")).first()[0]
    hot = F.col("_n") * broadcast_labels > n
    with_hot = rows.join(F.broadcast(totals.where(hot)), same, "left")
    found = with_hot.where("_n is not null").drop("_of", "_n")
    rest = with_hot.where("_n is null").drop("_of", "_n", "label_error").join(totals.where(~hot), same).drop("_of", "_n")
    return found.unionByName(rest)


def compressed(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of ``vectors`` (vec_id, ``vector``, label).

    Rows whose vector is null or holds a null or non-finite component are left out. Vectors whose length isn't that of the one
    with the least id stay as rows with null code and errors, and so do all if that length is 0 or no multiple of ``parts``.
    Repeated ids are rows of their own. Further columns are ignored; a table without label counts as one of null labels; an
    empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry number has two hex digits")
    rows = usable_vectors(vectors, vector)
    books = train(rows, parts, entries, rounds)
    other = rows if books is None else rows.where(F.size("_vector") != books.dims)
    nulls = [F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"))]
    other = other.select(F.col("_id").alias("vec_id"), *nulls, F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
    if books is None:
        return other
    found = label_errors(written(encoded(rows, books), "codes"))
    return found.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")).unionByName(other)


def op13_vector_codes(spark, sf_dir):
    """Codes of all vectors in 16 parts of 64 entries."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """x: a row for each component; b, a and s of a round: entries, nearest entries, sums."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(
            f"""m{k} AS (SELECT row, p, min(lpad(d::VARCHAR, 18, '0') || lpad(e::VARCHAR, 3, '0')) AS best FROM (
    SELECT row, p, e, sum((c - z) * (c - z))::BIGINT AS d FROM x JOIN b{k} USING (p, i) GROUP BY row, p, e) GROUP BY row, p),
a{k} AS MATERIALIZED (SELECT row, p, best[1:18]::BIGINT AS d, best[19:]::BIGINT AS e FROM m{k})"""
        )
        if k < ROUNDS:
            steps.append(
                f"""s{k} AS (SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n FROM a{k} JOIN x USING (row, p) GROUP BY p, e, i),
b{k + 1} AS MATERIALIZED (SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, z) AS z FROM b{k} LEFT JOIN s{k} USING (p, e, i))"""
            )
    last = ROUNDS
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda u: u IS NULL OR NOT isfinite(u))) = 0),
u AS (SELECT row, unnest(range(len(embedding))) AS j, len(embedding) // {PARTS} AS w, unnest(embedding) AS y FROM v),
x AS MATERIALIZED (SELECT row, j // w AS p, j % w AS i, floor(y::DOUBLE * {SCALE})::BIGINT AS c FROM u),
b0 AS MATERIALIZED (SELECT p, row AS e, i, c AS z FROM x WHERE row < {ENTRIES}),
{", ".join(steps)},
r AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY row),
h AS (SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (row), h
"""


OP13_SQL = _sql()
