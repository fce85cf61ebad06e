"""Byte-level BPE by DuckDB recursive queries, one database for each worker.

Token-position rows join the merge table; every round contracts each word's least-ranked pair, leftmost first, until no
pair of any word merges; ordered aggregation puts the ids of a word, and their bytes, together. Spark partitions the
texts; a partition meets the database only with words that its worker has not met lately.

Scale: map-only, nothing is shuffled. Memory is bounded by SLICE_CHARS of text, WORDS words a query and CACHE_WORDS
remembered words, whatever the input's size.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.tokens import slices

#: Chunks that a worker remembers at most twice over (a young and an old generation), and the length beyond which it doesn't.
CACHE_WORDS, CACHE_LENGTH = 300_000, 64
#: Bytes of words in one recursive query, and the length from which a word contracts many pairs a round.
QUERY_BYTES, LONG = 400_000, 200

# The characters with the White_Space property. Of two chunks, no match of the pattern takes parts of both.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Every way to put a token together from two. safe: no merge that takes this one's result has a smaller rank, so that
#: contracting all occurrences of a word's least-ranked pair at once gives what contracting them one by one does.
MERGES_SQL = """
CREATE TABLE merges AS
WITH hexed AS (SELECT id, hex(token) AS h FROM vocabulary),
     split AS (SELECT id AS merged, h[1:2 * k] AS l, h[2 * k + 1:] AS r FROM (SELECT id, h, unnest(range(1, length(h) // 2)) AS k FROM hexed)),
     pairs AS (SELECT a.id AS l, b.id AS r, merged FROM split JOIN hexed a ON a.h = split.l JOIN hexed b ON b.h = split.r)
SELECT l, r, merged, merged NOT IN (SELECT l FROM pairs WHERE merged < l UNION SELECT r FROM pairs WHERE merged < r) AS safe FROM pairs
"""

#: Short words. A symbol's key k holds its word and its place; a round contracts each word's leftmost least-ranked pair.
ENCODE_SQL = """
CREATE OR REPLACE TEMP TABLE encoded AS
WITH RECURSIVE tokens(k, id, done) AS (
  SELECT k, id, FALSE FROM symbols
  UNION ALL
  (WITH nexts AS (SELECT k, id, lead(k) OVER w AS nk, lead(id) OVER w AS nid FROM tokens WHERE NOT done WINDOW w AS (ORDER BY k)),
        paired AS MATERIALIZED (SELECT n.k, n.id, n.nk, m.merged FROM nexts n LEFT JOIN merges m ON m.l = n.id AND m.r = n.nid AND n.k >> 32 = n.nk >> 32),
        best AS (SELECT k >> 32 AS word, min(merged) AS merged, arg_min(k, (merged::BIGINT << 32) | (k & 4294967295)) AS kept, arg_min(nk, (merged::BIGINT << 32) | (k & 4294967295)) AS gone
                 FROM paired WHERE merged IS NOT NULL GROUP BY ALL)
   SELECT p.k, CASE WHEN p.k = b.kept THEN b.merged ELSE p.id END, b.word IS NULL
   FROM paired p LEFT JOIN best b ON b.word = p.k >> 32 WHERE b.word IS NULL OR p.k <> b.gone))
SELECT k, id FROM tokens WHERE done
"""

#: Long words: a round contracts all occurrences of the pair where that is safe. Only the latest state of a place is held.
ENCODE_LONG_SQL = """
CREATE OR REPLACE TEMP TABLE encoded AS
WITH RECURSIVE tokens(k, id) USING KEY (k) AS (
  SELECT k, id FROM symbols
  UNION ALL
  (WITH nexts AS (SELECT k, id, lead(k) OVER w AS nk, lead(id) OVER w AS nid, row_number() OVER w AS nth FROM tokens WHERE id IS NOT NULL WINDOW w AS (ORDER BY k)),
        paired AS MATERIALIZED (SELECT n.k, n.id, n.nth, m.merged, m.safe FROM nexts n LEFT JOIN merges m ON m.l = n.id AND m.r = n.nid AND n.k >> 32 = n.nk >> 32),
        least AS (SELECT k >> 32 AS word, min(merged) AS merged FROM paired WHERE merged IS NOT NULL GROUP BY ALL),
        hits AS (SELECT l.word, p.nth, p.safe, row_number() OVER w AS hit, p.nth - row_number() OVER w AS run
                 FROM paired p JOIN least l ON l.word = p.k >> 32 AND l.merged = p.merged WINDOW w AS (PARTITION BY l.word ORDER BY p.nth)),
        chosen AS (SELECT nth FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY nth) AS j FROM hits) WHERE j % 2 = 1 AND (safe OR hit = 1))
   SELECT p.k, CASE WHEN c.nth IS NOT NULL THEN l.merged WHEN e.nth IS NOT NULL THEN NULL ELSE p.id END
   FROM paired p JOIN least l ON l.word = p.k >> 32 LEFT JOIN chosen c ON c.nth = p.nth LEFT JOIN chosen e ON e.nth = p.nth - 1))
SELECT k, id FROM tokens WHERE id IS NOT NULL
"""

#: A word's ids in order, and the bytes that they stand for.
DECODE_SQL = """
SELECT k >> 32 AS word, string_agg(id::VARCHAR, ' ' ORDER BY k) AS ids, count(*) AS n, unhex(string_agg(h, '' ORDER BY k)) AS decoded
FROM encoded JOIN (SELECT id, hex(token) AS h FROM vocabulary) USING (id) GROUP BY ALL
"""


class BpeDatabase:
    """A DuckDB database in memory with the vocabulary and the merge table, and the chunks encoded lately.

    A chunk is a run of the text that the pattern never matches across; its matches are the words of the queries.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "token": pa.array(self.ranks.keys(), pa.binary())})
        self.db.register("given", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS FROM given")
        self.db.execute(MERGES_SQL)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.joined = np.zeros((256, 256), bool)  # byte pairs that stand in some token; between others nothing merges
        for token in self.ranks:
            for a, b in zip(token, token[1:], strict=False):
                self.joined[a, b] = True
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}
        self.young_words: dict[bytes, tuple[str, int, bytes]] = {}
        self.old_words: dict[bytes, tuple[str, int, bytes]] = {}

    def _token(self, id_: int) -> tuple[str, int, bytes]:
        return str(id_), 1, self.tokens[id_]

    def _units(self, word: bytes) -> list[bytes]:
        """``word``, a long one cut where nothing merges."""
        if len(word) < LONG:
            return [word]
        flat = np.frombuffer(word, np.uint8)
        cuts = (np.flatnonzero(~self.joined[flat[:-1], flat[1:]]) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _query(self, words: list[bytes], sql: str) -> dict[bytes, tuple[str, int, bytes]]:
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        places = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("symbols", pa.table({"k": (np.repeat(np.arange(len(words), dtype=np.int64), lengths) << 32) | places, "id": ids}))
        self.db.execute(sql)
        return {words[word]: (ids, n, decoded) for word, ids, n, decoded in self.db.execute(DECODE_SQL).fetchall()}

    def _words(self, words: set[bytes]) -> dict[bytes, tuple[str, int, bytes]]:
        """(ids as text, their number, decoded bytes) of each word. A word that is a token is that token; bytes come from ids."""
        found = {w: self._token(self.ranks[w]) for w in words if w in self.ranks}
        for cache in (self.young_words, self.old_words):
            found.update((w, cache[w]) for w in words if w in cache)
        split = {w: self._units(w) for w in words if w not in found}
        waiting = {u for units in split.values() for u in units} - self.ranks.keys()
        units: dict[bytes, tuple[str, int, bytes]] = {}
        for sql, some in ((ENCODE_SQL, [u for u in waiting if len(u) < LONG]), (ENCODE_LONG_SQL, [u for u in waiting if len(u) >= LONG])):
            batch, size = [], 0
            for u in some:
                batch.append(u)
                size += len(u)
                if size >= QUERY_BYTES:
                    units |= self._query(batch, sql)
                    batch, size = [], 0
            if batch:
                units |= self._query(batch, sql)
        for w, parts in split.items():
            if len(parts) == 1:
                found[w] = units[w]
            else:
                done = [units[u] if u in units else self._token(self.ranks[u]) for u in parts]
                found[w] = " ".join(d[0] for d in done), sum(d[1] for d in done), b"".join(d[2] for d in done)
        if len(self.young_words) + len(split) > CACHE_WORDS:
            self.young_words, self.old_words = {}, self.young_words
        self.young_words.update((w, found[w]) for w in split if len(w) <= CACHE_LENGTH)
        return found

    def _learn(self, chunks: set[str]) -> dict[str, tuple[str, int, bytes]]:
        found = {c: self.old[c] for c in chunks if c in self.old}
        fresh = {c: [m.encode("utf-8") for m in self.pattern.findall(c)] for c in chunks if c not in found}
        words = self._words({w for ws in fresh.values() for w in ws})
        for c, ws in fresh.items():
            done = [words[w] for w in ws]
            found[c] = done[0] if len(done) == 1 else (" ".join(d[0] for d in done), sum(d[1] for d in done), b"".join(d[2] for d in done))
        if len(self.young) + len(found) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        self.young.update((c, x) for c, x in found.items() if len(c) <= CACHE_LENGTH)
        return found

    def encode(self, texts: list[str | None]) -> list[list[tuple[str, int, bytes]]]:
        """For each text (null: empty) its chunks in order as (ids as text, number of ids, decoded bytes)."""
        split = [CHUNK.findall(t or "") for t in texts]
        parts = [list(map(self.young.get, chunks)) for chunks in split]
        missing = {c for chunks, part in zip(split, parts, strict=True) if None in part for c, p in zip(chunks, part, strict=True) if p is None}
        if missing:
            found = self._learn(missing)
            parts = [[found[c] if p is None else p for c, p in zip(chunks, part, strict=True)] if None in part else part for chunks, part in zip(split, parts, strict=True)]
        return parts


_databases: dict[tuple[str, str], BpeDatabase] = {}


def bpe_database(ranks_path: str, pattern: str) -> BpeDatabase:
    """This worker's database: tasks that follow one another on a worker share it."""
    key = ranks_path, pattern
    if key not in _databases:
        _databases[key] = BpeDatabase(ranks_path, pattern)
    return _databases[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes that the ids
    decode to) of each whole text; with_ids adds ids (array<int>) and decoded (binary).

    Null texts count as empty; empty texts have no ids. Repeated rows give repeated rows, an empty table none; further
    columns are ignored.
    """
    source = docs.select("doc_id", F.col(text).alias("_text"))
    wanted = source.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))
    if with_ids:
        wanted = wanted.select("*", F.array().cast("array<int>").alias("ids"), F.lit(b"").alias("decoded"))

    names, schema = wanted.columns, wanted.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        database = bpe_database(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "_text"):
                n, ids_sha, decoded_sha, all_ids, all_decoded = [], [], [], [], []
                for chunks in database.encode(part.column("_text").to_pylist()):
                    ids, decoded = " ".join([c[0] for c in chunks]), b"".join([c[2] for c in chunks])
                    n.append(sum([c[1] for c in chunks]))
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids.split(), np.int32))
                        all_decoded.append(decoded)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_decoded, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def op10_byte_bpe(spark, sf_dir):
    """Encoded and decoded digests of every document."""
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
