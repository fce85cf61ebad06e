"""Near-duplicates by min-max hashing: each permutation gives its minimum and its maximum over a document's shingles.

1. One pass over the texts: exact shingle sets become a digest, a size, and the hashes of bands of the signature.
2. Equal sets are one class, represented by its least doc_id, so thousands of exact copies cost as much as one text.
3. Documents that share a band are candidates. Each bucket's leader is its member with the most company over all buckets,
   as the source of many copies is; it is held against the others (a star), and links that the full sets confirm give
   components. Where a leader's followers still lie in different components, those outside the largest one are compared
   with the rest: exactly, in blocks of sets, by counting common shingles for a whole block at once, so that pairs are
   never rows. No candidate pair between components goes unseen, whatever a group's size.
4. Components of the confirmed links.

Scale: texts are read again only where candidates are confirmed, and only those of candidates travel; buckets are counted by partial aggregation and joined,
so a hot bucket is a skewed join that Spark can split. A pair at the threshold misses all 40 bands of 5 values with
probability (1 - 0.8**5)**40, about 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.common import checkpointed, written
from hazgrid.llm.components import connected_components
from hazgrid.llm.tokens import slices

PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
THRESHOLD = 80  # in hundredths
CACHE_WORDS = 400_000
#: Followers of one leader that are compared at a time.
BLOCK = 256
#: The share of all texts, one in so many, beyond which the copies of a text are hot.
HOT = 1000

_random = np.random.default_rng(20_240_601)
_A = (_random.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_BAND = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_words = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of ``text``, its A-Z lower-cased, its words split at
    spaces and ASCII controls 9 to 13. Fewer words are one shingle; no words are the empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return _mixed(np.array([int((h * _PLACE[: len(h)]).sum()) ^ len(words)], np.uint64))
    n = len(h) - width + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, width):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def min_max_signature(shingles: np.ndarray) -> np.ndarray:
    """All permutations' minima, then all their maxima, over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least, most = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for start in range(0, len(x), 1024):
        y = x[start : start + 1024] * _A
        y += _B
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(least, y.min(axis=1), out=least)
        np.maximum(most, y.max(axis=1), out=most)
    return np.concatenate([least, most])


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    values = min_max_signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((values * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """row, doc_id, n_shingles, digest of the set (null when empty) and bands of ``rows`` (row, kept)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, digests, bands = [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, width)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(band_hashes(s) if len(s) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["row", "doc_id", "n_shingles", "digest", "bands"],
                )

    return rows.select("row", F.col("kept.doc_id").cast("long").alias("doc_id"), "kept.text").mapInArrow(run, "row long, doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(row, shingles as bytes) of the rows in ``wanted``.

    Texts meet ``wanted`` by a merge join at every size, so that plan and figures don't change where the ids of candidates
    outgrow a broadcast; on large scans Spark's runtime filter keeps other texts out of the shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, width).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], ["row", "shingles"])

    return rows.select("row", "kept.text").join(wanted.hint("merge"), "row", "left_semi").mapInArrow(run, "row long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = np.intersect1d(x, y, assume_unique=True).size
                similar.append(100 * common >= THRESHOLD * (len(x) + len(y) - common) > 0)
            yield batch.select(["u", "v"]).filter(pa.array(similar, pa.bool_()))

    left = sets.select(F.col("row").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("row").alias("v"), F.col("shingles").alias("b"))
    return checkpointed(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def _close(n: str, m: str):
    """Sets whose sizes differ by more than the threshold allows aren't similar enough."""
    return 100 * F.least(n, m) >= THRESHOLD * F.greatest(n, m)


def _common(strays: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``strays`` with all ``others``: a product of incidence matrices, a range of shingles at a time."""
    sizes = [np.array([len(x) for x in some]) for some in (strays, others)]
    flat = [np.concatenate(some) for some in (strays, others)]
    owner = [np.repeat(np.arange(len(n), dtype=np.int32), n) for n in sizes]
    both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    counts = np.zeros((len(strays), len(others)), np.float64)
    if not len(both):
        return counts
    places = [np.searchsorted(both, x) for x in flat]
    held = [both[np.minimum(at, len(both) - 1)] == x for at, x in zip(places, flat, strict=True)]
    order = [np.argsort(at[h], kind="stable") for at, h in zip(places, held, strict=True)]
    places = [at[h][o] for at, h, o in zip(places, held, order, strict=True)]
    owner = [w[h][o] for w, h, o in zip(owner, held, order, strict=True)]
    for start in range(0, len(both), 8192):
        part = []
        for at, w, rows in zip(places, owner, (len(strays), len(others)), strict=True):
            low, high = np.searchsorted(at, [start, start + 8192])
            m = np.zeros((rows, min(8192, len(both) - start)), np.float32)
            m[w[low:high], at[low:high] - start] = 1
            part.append(m)
        counts += part[0] @ part[1].T
    return counts


def _of_groups(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """``placed`` with what is known of their leader's group. Groups with more than one in HOT of all rows, of which there are
    fewer than HOT, are sent to all executors, so that no task gets all followers of a leader."""
    bound = placed.count() // HOT
    hot = groups.where(F.col("size") > bound)
    rest = placed.join(F.broadcast(hot.select("leader")), "leader", "left_anti").join(groups.where(F.col("size") <= bound), "leader")
    return placed.join(F.broadcast(hot), "leader").unionByName(rest)


def _links_of_strays(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (u, v) between followers (leader, rep, c) of one leader in different components.

    Followers of a leader are dealt into blocks of about BLOCK by hash; each block of strays meets each block of all of
    them. Leaders with few followers share a task.
    """
    sizes = placed.groupBy("leader", "c").agg(F.count("*").alias("size"))
    groups = sizes.groupBy("leader").agg(F.max(F.struct("size", "c"))["c"].alias("largest"), F.count("*").alias("parts"), F.sum("size").alias("size")).where("parts > 1")
    open_ = written(_of_groups(placed, checkpointed(groups.select("leader", "largest", "size"))), "open")
    sets = sets.withColumnRenamed("row", "rep")
    n_open = open_.count()
    blocks = F.ceil(F.col("size") / BLOCK)
    tasks = max(1, n_open // (4 * BLOCK))
    rows = open_.join(sets, "rep").withColumn("task", F.when(blocks > 1, F.concat(F.lit("l"), "leader")).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("leader"), F.lit(tasks)))))
    rows = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks)})
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    keys = ["task", "row", "col"]
    strays = rows.where("c != largest").withColumn("row", F.col("block")).withColumn("col", F.explode(every)).select(*keys, "leader", "rep", "c", "shingles")
    others = rows.withColumn("col", F.col("block")).withColumn("row", F.explode(every))
    others = others.select(*(F.col(c).alias(c) for c in (*keys, "leader", "rep", "c", "shingles")))  # fresh columns: both sides come from one table

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        theirs = dict(tuple(right.groupby("leader"))) if len(left) else {}
        for leader, mine in left.groupby("leader") if len(left) else ():
            if leader not in theirs:
                continue
            their = theirs[leader]
            a, b = ([np.frombuffer(x, np.uint64) for x in some["shingles"]] for some in (mine, their))
            common = _common(a, b)
            union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - common
            apart = mine["c"].to_numpy()[:, None] != their["c"].to_numpy()[None, :]
            i, j = np.nonzero(apart & (100 * common >= THRESHOLD * union) & (union > 0))
            u, v = mine["rep"].to_numpy()[i], their["rep"].to_numpy()[j]
            found.append(pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}))
        return pd.concat(found) if found else pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})

    return checkpointed(strays.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(compare, "u long, v long").distinct())


def _of_class(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``texts`` with the head and component_id of the class of their digest. Classes with more than one in HOT of all texts,
    of which there are fewer than HOT, are sent to all executors, so that no task gets all copies of a text."""
    bound = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // HOT
    hot = classes.where(F.col("copies") > bound).drop("copies").withColumn("_hot", F.lit(True))
    marked = texts.join(F.broadcast(hot), "digest", "left")
    rest = marked.where("_hot is null").select(*texts.columns).join(classes.where(F.col("copies") <= bound).drop("copies"), "digest")
    return marked.where("_hot").drop("digest", "_hot").unionByName(rest.drop("digest"))


def grouped(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as written (row, a number of its own, and kept, all columns as a struct), and a verdict for each:
    row, doc_id, n_shingles, component_id (least doc_id reachable over links) and stands (the one row that stands for its
    group: the first by doc_id, null ones last).

    Two documents link if 100 * intersection >= 80 * union of their shingle sets. Null texts count as empty; empty ones
    link with nothing and each stands for itself. Rows that repeat a document with its text are one class. Rows without
    doc_id link like others; a group of such rows only has no component_id. Columns may have any names; an empty table
    gives no rows.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("kept")), "rows")
    signed = written(_signed(rows, width), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    texts = signed.where(F.col("digest").isNotNull())
    classes = texts.groupBy("digest").agg(first.alias("f"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = written(classes.select("digest", F.col("f.row").alias("rep"), F.col("f.doc_id").alias("doc_id"), "bands", "n", "copies"), "classes")
    buckets = classes.select(F.posexplode("bands").alias("band", "hash"), "rep", "n").select(F.xxhash64("band", "hash").alias("bucket"), "rep", "n")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = written(buckets.join(shared, "bucket"), "members")
    company = members.groupBy("rep").agg(F.sum("members").alias("company"))
    ranked = members.join(company, "rep")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("rep")).alias("minus"), "n")).alias("m"))
    leaders = leaders.select("bucket", (-F.col("m.minus")).alias("leader"), F.col("m.n").alias("leader_n"))
    followers = written(members.join(leaders, "bucket").select("leader", "leader_n", "rep", "n").distinct(), "followers")

    stars = followers.where(F.col("rep") != F.col("leader")).where(_close("n", "leader_n"))
    sets = written(_sets(rows, followers.select(F.col("rep").alias("row")).distinct(), width), "sets")
    links = confirmed(checkpointed(stars.select(F.least("leader", "rep").alias("u"), F.greatest("leader", "rep").alias("v")).distinct()), sets)
    components = checkpointed(connected_components(links))

    placed = followers.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("leader", "rep", F.coalesce("component", "rep").alias("c"))
    placed = written(placed, "followers-placed")
    links = links.unionByName(_links_of_strays(placed, sets))
    components = checkpointed(connected_components(links)).withColumnRenamed("node", "row")

    placed = written(classes.select("digest", F.col("rep").alias("row"), "doc_id", "copies").join(components, "row", "left").withColumn("c", F.coalesce("component", "row")), "placed")
    heads = placed.groupBy("c").agg(first.alias("f")).select("c", F.col("f.row").alias("head"), F.col("f.doc_id").alias("component_id"))
    of_class = written(placed.join(heads, "c").select("digest", "head", "component_id", "copies"), "verdicts")
    with_words = _of_class(texts.select("row", "doc_id", "n_shingles", "digest"), of_class)
    without = signed.where(F.col("digest").isNull()).select("row", "doc_id", "n_shingles", F.col("row").alias("head"), F.col("doc_id").alias("component_id"))
    verdicts = with_words.unionByName(without)
    return rows, verdicts.select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("head")).alias("stands"))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id, so that all rows which repeat a kept document are
    kept), a row for each row of ``docs``; see ``grouped``. Rows without doc_id are kept if their group has no doc_id."""
    _, verdicts = grouped(docs.select("doc_id", "text"), width)
    return verdicts.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row that stands for it."""
    rows, verdicts = grouped(docs, width)
    return rows.join(verdicts.where("stands").select("row"), "row", "left_semi").select("kept.*")


def op4_minhash_near_dedup(spark, sf_dir):
    """Groups of near-duplicates by shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
