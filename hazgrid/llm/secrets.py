"""Secret scan in DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings.

All work is one map-only projection a document: nothing is shuffled, so hot sources and copies cost nothing extra.
Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.common import let, whole_text

# The three base patterns. A run shorter than its bound fails; for access and hex the bound stands in the
# pattern, which finds the same runs since each match takes its whole run.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LENGTH = 8

#: kind: order in the result. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")

#: A candidate for the entropy scan (a name and its = aren't part of it), the runs of hex digits of one case that are candidates
#: of their own, also within a longer one, and the window that slides over them.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
HEX_RUN = r"[0-9a-f]{20,}|[0-9A-F]{20,}"
WINDOW = 20
#: class: (alphabet, pattern of a candidate of that class, least entropy in bits of a window). A candidate has the first class
#: that it fits; a window that lies within a hex run is measured as hex, whatever holds the run.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+$", 3.6),
    "entropy_lower": ("abcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"^(?=.*[0-9])(?=.*[a-z]).+$", 3.8),
    "entropy_upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", r"^(?=.*[0-9])(?=.*[A-Z]).+$", 3.8),
}
#: Words that no window of a secret holds: placeholders and running alphabets. A window that overlaps one isn't hot.
ALLOWED_WORDS = ("placeholder", "changeme", "abcdefgh", "01234567", "12345678", "qwertyui", "00000000", "example", "sample", "dummy", "your_", "your-", "xxxx")
#: Whole candidates that are known not to be secrets: UUIDs, and slash- or dash-joined plain words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+[/_=-]*$",
)
BLOCK = 256
#: Bits of a count (WINDOW + 1 at most), and counts in a long integer.
BITS, LANES = 5, 12


def prefix_sums(values: Column) -> Column:
    """Sums of all values up to each one, with appends to short blocks so that long arrays don't cost their square."""

    def add(state: Column, x: Column) -> Column:
        return F.struct((state["sum"] + x).alias("sum"), F.array_append(state["out"], state["sum"] + x).alias("out"))

    nothing = F.array().cast("array<int>")

    def block(state: Column, start: Column) -> Column:
        inner = F.aggregate(F.slice(values, start + 1, F.lit(BLOCK)), F.struct(state["sum"].alias("sum"), nothing.alias("out")), add)
        return let(inner, lambda b: F.struct(b["sum"].alias("sum"), F.concat(state["out"], b["out"]).alias("out")))

    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK))).otherwise(nothing)
    return F.aggregate(starts, F.struct(F.lit(0).alias("sum"), nothing.alias("out")), block)["out"]


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("no"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


SPAN = "struct<start:int,no:int,end:int,kind:string>"


def _scan(df: DataFrame, keep: list[str], pattern: str, column: str) -> DataFrame:
    """Adds the array ``column`` of (start, text) of all matches of ``pattern`` in _t: the text between matches gives the starts."""
    df = df.withColumn("_m", F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_between", F.when(F.size("_m") > 0, F.split("_t", pattern, -1)))
    lengths = F.zip_with("_m", "_between", lambda m, b: F.length(m) + F.length(b))
    df = df.withColumn("_ends", F.when(F.size("_m") > 0, prefix_sums(F.slice(lengths, F.lit(1), F.size("_m")))))
    matches = F.zip_with("_m", "_ends", lambda m, e: F.struct((e - F.length(m)).alias("start"), m.alias("text")))
    return df.withColumn(column, F.when(F.size("_m") > 0, matches).otherwise(F.array().cast("array<struct<start:int,text:string>>"))).select(*keep, "_t", column)


def _masked(text: Column) -> Column:
    """``text`` with each allow-listed word, in either case, as blanks, which no alphabet holds."""
    for word in ALLOWED_WORDS:
        text = F.regexp_replace(text, f"(?i){word}", " " * len(word))
    return text


def hot_runs(text: Column, alphabet: str, bits: float) -> Column:
    """array of (start, end): the maximal runs of overlapping windows of at least ``bits`` of Shannon entropy whose characters
    are all of ``alphabet``.

    The window's counts by character change by one in and one out at each step, and so does sum(c * log2(c)) of them:
    entropy = log2(WINDOW) - sum / WINDOW. Counts are fields of BITS bits in a few long integers, so that a step changes two
    fields and copies no array. Code 0 stands for characters outside the alphabet.
    """
    words = -(-(len(alphabet) + 1) // LANES)
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))
    term = F.array(*(F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)))
    limit = (math.log2(WINDOW) - bits) * WINDOW + 1e-9
    spans = "array<struct<start:int,end:int>>"

    def step(code: Column):
        def count(state: Column, c: Column) -> Column:
            word = state["n0"]
            for k in range(1, words):
                word = F.when(c >= k * LANES, state[f"n{k}"]).otherwise(word)
            return F.call_function("shiftright", word, (c % LANES) * BITS).bitwiseAND(F.lit(2**BITS - 1)).cast("int")

        def one(c: Column, k: int) -> Column:
            """What word k gains by a character c (null: none)."""
            return F.when((c >= k * LANES) & (c < (k + 1) * LANES), F.call_function("shiftleft", F.lit(1).cast("long"), (c % LANES) * BITS)).otherwise(F.lit(0).cast("long"))

        def run(state: Column, i: Column) -> Column:
            pair = F.struct(F.get(code, i).alias("into"), F.when(i >= WINDOW, F.get(code, i - WINDOW)).alias("out"))

            def slide(p: Column) -> Column:
                into, out = p["into"], p["out"]
                c_in, c_out = count(state, into), count(state, out)
                same = F.coalesce(into == out, F.lit(False))
                less = F.when(out.isNotNull(), F.get(term, c_out - 1) - F.get(term, c_out)).otherwise(0.0)
                total = F.when(same, state["s"]).otherwise(state["s"] + less + F.get(term, c_in + 1) - F.get(term, c_in))
                foreign = state["foreign"] + (into == 0).cast("int") - F.coalesce((out == 0).cast("int"), F.lit(0))
                first = i - (WINDOW - 1)
                hot = (first >= 0) & (total <= limit) & (foreign == 0)
                fresh = hot & (state["last"].isNull() | (first >= state["last"] + WINDOW))
                closed = F.array_append(state["runs"], F.struct(state["first"].alias("start"), (state["last"] + WINDOW).alias("end")))
                return F.struct(
                    *(F.when(same, state[f"n{k}"]).otherwise(state[f"n{k}"] + one(into, k) - one(out, k)).alias(f"n{k}") for k in range(words)),
                    total.alias("s"), foreign.alias("foreign"), F.when(fresh, first).otherwise(state["first"]).alias("first"), F.when(hot, first).otherwise(state["last"]).alias("last"),
                    F.when(fresh & state["last"].isNotNull(), closed).otherwise(state["runs"]).alias("runs"),
                )

            return let(pair, slide)

        none, nothing = F.lit(None).cast("int"), F.array().cast(spans)
        zero = F.struct(*(F.lit(0).cast("long").alias(f"n{k}") for k in range(words)), F.lit(0.0).alias("s"), F.lit(0).alias("foreign"), none.alias("first"), none.alias("last"), nothing.alias("runs"))
        end = lambda s: F.when(s["last"].isNotNull(), F.array_append(s["runs"], F.struct(s["first"].alias("start"), (s["last"] + WINDOW).alias("end")))).otherwise(nothing)
        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), zero, run, end)

    return let(codes, step)


def _entropy_spans(candidates: str, kind: str) -> Column:
    alphabet, pattern, bits = CLASSES[kind]
    before = [p for k, (_, p, _) in CLASSES.items() if KINDS.index(k) < KINDS.index(kind)]
    of_class = F.filter(candidates, lambda c: reduce(lambda found, p: found & ~c["text"].rlike(p), before, c["text"].rlike(pattern)))
    hot = F.transform(of_class, lambda c: F.transform(hot_runs(_masked(c["text"]), alphabet, bits), lambda h: _span(c["start"] + h["start"], c["start"] + h["end"], kind)))
    return F.flatten(hot)


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: ``keep``, and spans, an array of (start, no, end, kind) by start, then kind as in KINDS.

    The base kinds are found whatever the method says. The entropy scan takes runs of 20 or more characters, tells their
    class (hex digits, mixed base64, letters of one case with digits), slides a window over them by incremental counts and
    keeps each maximal run of overlapping hot windows, unless the candidate is on the allow-list or the span lies within a
    base span; windows that overlap an allow-listed word aren't hot. Hex runs are candidates
    of their own too, so that a key within a longer run is measured by what it is. Null and empty texts have no spans. Repeated rows give repeated rows, an
    empty table none. Columns of ``keep`` may have any names but ``spans``.
    """
    if "spans" in keep:
        raise ValueError("a kept column can't be named spans, as the result's is")
    df = docs.select(F.struct(*keep).alias("_kept"), whole_text(text).alias("_t"))
    keep = ["_kept"]
    found: list[str] = []
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_candidates", CANDIDATE), ("_hexes", HEX_RUN)):
        df = _scan(df, keep + found, pattern, name)
        found.append(name)
    as_span = lambda kind: lambda m: _span(m["start"], m["start"] + F.length(m["text"]), kind)
    long_enough = F.filter("_assign", lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 1)) >= ASSIGN_LENGTH)
    df = df.select(
        *keep,
        F.transform(long_enough, as_span("assign")).alias("_assign"),
        F.transform("_access", as_span("access")).alias("_access"),
        F.transform("_hex", as_span("hex")).alias("_hex"),
        F.filter("_candidates", lambda c: ~c["text"].rlike("|".join(f"(?:{p})" for p in ALLOWED))).alias("_candidates"),
        "_hexes",
    )
    # Hex runs stand for the candidates that are hex as a whole.
    hexes = F.when(F.size("_hexes") > 0, _entropy_spans("_hexes", "entropy_hex")).otherwise(F.array().cast(f"array<{SPAN}>"))
    df = df.select(
        *keep,
        F.concat("_assign", "_access", "_hex").alias("_base"),
        F.concat(hexes, F.when(F.size("_candidates") > 0, F.concat(*(_entropy_spans("_candidates", kind) for kind in KINDS[4:]))).otherwise(F.array().cast(f"array<{SPAN}>"))).alias("_more"),
    )
    within = F.filter("_more", lambda m: ~F.exists("_base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return df.select("_kept.*", F.array_sort(F.concat("_base", within)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans in its text replaced by ``mark`` and n_chars brought up to date.

    Every document stays; null texts stay null. Only columns of ``docs`` come back, whatever they are called.
    """
    columns = docs.columns
    df = scan_secrets(docs.select(F.struct(*columns).alias("row"), "text"), keep=("row",)).select("row", "spans", F.col("row.text").alias("text"))
    pieces = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        before = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(state["out"], F.concat(before, F.lit(mark)))).otherwise(state["out"]).alias("out"))

    text = F.aggregate("spans", pieces, cut, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    df = df.select("row", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in columns:
        new["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return df.select(*(new.get(c, F.col("row")[c]).alias(c) for c in columns))


def op9_secret_scans(spark, sf_dir):
    """Base counts and digest, and all spans, of every document."""
    scanned = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["no"] < 3)

    def of_kind(no: int):
        return lambda s: s["no"] == no

    return scanned.select(
        "doc_id",
        *(F.size(F.filter("spans", of_kind(no))).cast("long").alias(f"n_{KINDS[no]}") for no in range(3)),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
