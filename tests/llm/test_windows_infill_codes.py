"""Window packing, fill-in-middle and vector codes: against brute force, SQL and the libraries themselves, and odd rows."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from hazgrid.llm import codes, idcoder, infill, queries, tokens, windows

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, length long, sequence_id string, _text string, output string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "clash", "clash", "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["ñandú", "漢字", "it's", "A.B,", "\U0001f600", "(x)", "İstanbul", "İİ", "a b"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    edges = [None, "", " \n\t", "one", "  lead", "tail  ", "x" * 30_000, "the same words\n" * 4000, "a <S> b", "<P>", "<", "<S", "a   b  c", "<|endoftext|> after <|endoftext|>"]
    return some + edges + some[:3]


# -- tokens


@pytest.fixture(scope="module", params=[("word_bpe_49k.json", tokens.WordEncoder), ("byte_bpe_50k.json", tokens.ByteEncoder)], ids=["word", "byte"])
def encoder(request):
    from tokenizers import Tokenizer

    path, kind = request.param
    return kind, P.path(path), Tokenizer.from_file(P.path(path))


def check_encoder(kind, path, library, texts):
    found = kind(path)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ids, lengths = found.encode(pa.array(some, pa.string()))
        ends = np.cumsum(lengths)
        for t, end, n, want in zip(some, ends, lengths, library.encode_batch([t or "" for t in some], add_special_tokens=False), strict=True):
            assert ids[end - n : end].tolist() == want.ids, t


def odd_texts():
    rng = random.Random(3)
    letters = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha()]
    signs = list("ab cZ'st  \n\t.,!<|>123éİı漢«»“”—  　\x85\x1c  \U0001f600̇")
    return [f"{c} ({c}) a{c}b {c}{c}." for c in letters] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(4000)]


def test_encoders_against_the_library(encoder, texts):
    check_encoder(*encoder, texts + odd_texts())


def test_words_that_share_a_key(encoder, texts, monkeypatch):
    real = tokens.word_keys
    monkeypatch.setattr(tokens, "word_keys", lambda *a: (lambda keys, checks: (keys % np.uint64(53), checks))(*real(*a)))
    check_encoder(*encoder, texts + odd_texts()[:600])


def test_encoders_that_forget(encoder, texts, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 40)
    check_encoder(*encoder, texts + texts)


def test_known_words_are_looked_up(monkeypatch):
    """op1: words that the table holds are found by their first bits; no batch is sorted by key for that."""
    own, some = tokens.WordEncoder(P.path("word_bpe_49k.json")), pa.array([" ".join(f"word{i}x" for i in range(500))] * 3)
    first = own.encode(some)
    monkeypatch.setattr(np, "argsort", None)
    assert all((a == b).all() for a, b in zip(first, own.encode(some), strict=True))


def test_encoders_take_little_memory(encoder):
    """pipeline: what is found of many texts is worked on a few texts at a time, and no more is kept than their ids."""
    own = encoder[0](encoder[1])
    some = pa.array([" ".join(f"word{i % 7}x" for i in range(k, k + 5000)) for k in range(100)])
    own.encode(some)
    tracemalloc.start()
    own.encode(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * some.nbytes


def test_batches_are_looked_up_once(monkeypatch):
    """op1: when words are new, those that the table holds aren't looked up again; ids of the coder's numbers take 16 bits."""
    own, real, calls = tokens.WordEncoder(P.path("word_bpe_49k.json")), tokens._Table.find, []
    monkeypatch.setattr(tokens._Table, "find", lambda *a: calls.append(1) or real(*a))
    own.encode(pa.array(["some new words", "some more"]))
    model = idcoder._Model(4)
    model.predict()
    assert len(calls) == 1 and {x.itemsize for x in (model.p1, model.p2, model.last, model.weight, model.borders)} == {2}


# -- packing into windows


def test_tightest_window():
    rng = random.Random(5)
    for _ in range(200):
        top = rng.choice([8, 64, 256])
        lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 90))]
        used: list[list[int]] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            open_ = [(top - sum(lengths[j] for j in w), k) for k, w in enumerate(used) if top - sum(lengths[j] for j in w) >= lengths[i]]
            if open_:
                used[min(open_)[1]].append(i)
            else:
                used.append([i])
        found = windows.best_fit_decreasing(lengths, top)
        assert sorted(i for w in found for i in w) == list(range(len(lengths)))
        assert Counter(sum(lengths[i] for i in w) for w in found) == Counter(sum(lengths[i] for i in w) for w in used)
        pieces = windows.top_up(found, lengths, top)
        covered = Counter((i, k) for w in pieces for i, start, n in w for k in range(start, start + n))
        assert covered == {(i, k): 1 for i, n in enumerate(lengths) for k in range(n)}
        assert all((n := sum(p[2] for p in w)) <= top and n & (n - 1) == 0 for w in pieces)


@pytest.mark.parametrize("group", [4096, 7])
def test_packed_windows(spark, texts, group):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = windows.packed_windows(frame(spark, rows).repartition(3), path, group=group).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length > 0 and r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids.tobytes())
    for doc_id, pieces in by_doc.items():
        times = Counter(k for r in pieces for k in range(r.start, r.start + r.length))
        assert times == dict.fromkeys(range(len(want[doc_id])), sum(i == doc_id for i, _ in rows))
    assert by_doc.keys() == want.keys()
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert any(r.length == 2048 for r in got)


def test_no_documents(spark):
    none = frame(spark, [])
    assert windows.packed_windows(none, P.path("byte_bpe_50k.json")).collect() == []
    assert infill.fill_in_middle(none).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        windows.packed_windows(none, P.path("byte_bpe_50k.json"), window=1000)


# -- fill in middle


def brute_units(text, unit):
    """Where each unit begins, letter by letter."""
    if unit == "code_point":
        return list(range(len(text)))
    kinds = ["space" if c in " \t\n\x0b\x0c\r" else "sign" if c in infill.SIGNS else "letters" for c in text]
    return [i for i, k in enumerate(kinds) if i == 0 or k == "sign" or k != kinds[i - 1]]


@pytest.mark.parametrize("unit", ["code_point", "run"])
def test_fill_in_middle(spark, texts, unit):
    rows = [*enumerate(texts), (3, texts[3]), (None, "no id at all")]
    made = infill.fill_in_middle(frame(spark, rows), unit=unit).withColumn("again", infill.restored())
    got = sorted(map(tuple, made.collect()), key=str)
    want = []
    for doc_id, t in rows:
        text = t or ""
        begins = [*brute_units(text, unit), len(text)]
        n = len(begins) - 1
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = begins[a], begins[b]
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((doc_id, n, "plain", None, None, text, text))
        elif h[3] % 100 < 20:
            want.append((doc_id, n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b], text))
        else:
            want.append((doc_id, n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b], text))
    assert got == sorted(want, key=str)
    assert {r[2] for r in want} == {"plain", "spm", "psm"}


def test_every_place():
    scan = infill.automaton()
    for text in ("", "a", "  ", "a  b,,c", "\n\n漢字 (x) <S> \U0001f600!", "é\tü"):
        for unit in ("code_point", "run"):
            begins = brute_units(text, unit)
            units = infill.Units(text, scan, unit)
            assert units.n == len(begins) and [units.place(r) for r in range(units.n + 1)] == [*begins, len(text)], text
            assert units.sentinel == ("<S>" in text)


# -- codes of vectors


def brute_codes(rows, parts, entries, rounds):
    """By loops over exact integers; ``rows`` are (vec_id, vector, label), usable and of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    whole = [[math.floor(Fraction(v) * 256) for v in r[1]] for r in rows]
    cut = [[tuple(x[p * width : p * width + width]) for p in range(parts)] for x in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found, members = assign(), defaultdict(list)
        for c, f in zip(cut, found, strict=True):
            for p in range(parts):
                members[p, f[p][1]].append(c[p])
        for (p, k), m in members.items():
            books[p][k] = tuple(sum(v) // len(m) for v in zip(*m, strict=True))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    top = codes.LONG_MAX
    return [(r[0], "".join(f"{k:02x}" for _, k in f), min(e, top), min(by_label[r[2]], top), digest) for r, f, e in zip(rows, found, errors, strict=True)]


VECTORS = "vec_id long, embedding array<double>, label int, code string, _id long"


@pytest.mark.parametrize(("entries", "spread", "labels"), [(24, 3.0, 65_536), (64, 0.02, 65_536), (9, 1e6, 3), (20, 1e200, 65_536)], ids=["some", "ties", "few", "huge"])
def test_compressed(spark, monkeypatch, entries, spread, labels):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", labels)
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(150)]), [rng.uniform(-1, 1) * spread for _ in range(12)], rng.choice([None, 0, 0, 0, *range(9)])) for _ in range(180)]
    rows += [(r[0], list(r[1]), r[2]) for r in rows[:30]] + [(5, [0.0] * 12, 1)] * 3
    bad = [(0, None, 1), (0, [None] * 12, 1), (1, [math.nan] * 12, 2), (2, [0.0] * 11 + [math.inf], None)]
    odd = [(900, [1.0] * 8, 3), (901, [], 3), (None, [1.0] * 24, 3)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + bad + odd], VECTORS).repartition(3)
    if labels == 3:
        found = codes.train(codes.usable_vectors(df), 4, entries, 2)
        written = codes.written(codes.encoded(codes.usable_vectors(df), found), "test")
        assert sorted(codes.label_errors(written, 3).select("_id", "label_error").collect(), key=str) == sorted(codes.label_errors(written).select("_id", "label_error").collect(), key=str)
    got = [tuple(r) for r in codes.compressed(df, parts=4, entries=entries, rounds=2).collect()]
    want = brute_codes(rows, 4, entries, 2)
    want += [(i, None, None, None, want[0][4]) for i, _, _ in odd]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert codes.compressed(none).collect() == []
    lone = spark.createDataFrame([(1, [0.5] * 16, None, "x", 1)], VECTORS).drop("label")
    assert [r.code for r in codes.compressed(lone).collect()] == ["00" * 16]
    uneven = spark.createDataFrame([(1, [0.5] * 15, 1, "x", 1)], VECTORS)
    assert [tuple(r)[:4] for r in codes.compressed(uneven).collect()] == [(1, None, None, None)]


@pytest.mark.parametrize("scale", [1, 1 << 30])
def test_trees_find_the_nearest(scale):
    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 64, 200):
        for width in (1, 4):
            book, x = (rng.integers(-20, 20, (k, width)).astype(object) * scale for k in (n, 300))
            if scale == 1:
                book, x = book.astype(np.int64), x.astype(np.int64)
            index, squares = codes.nearest(x, book, codes.tree(book))
            every = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
            assert index.tolist() == every.argmin(axis=1).tolist() and squares.tolist() == every.min(axis=1).tolist()


# -- queries


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_vector_codes"])
def test_matches_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    theirs = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    ours = queries.queries()[name](spark, folder)
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(map(str, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(map(str, theirs.fetchall()))
