"""Quality rules with robust multivariate outliers, in DataFrame functions only.

``text_statistics`` counts, per document and in one map-only projection, what the rules need.
``outlier_verdicts`` fits a minimum-covariance-determinant (MCD) estimate of location and scatter per language and
source: two concentration steps from several starts, then, from the start with the least determinant of each group, steps
until that group's determinant falls no more. A step that makes an estimate worse is never taken. It rejects documents
whose Mahalanobis distance is too large.

Scale: texts are read once and never shuffled. What is kept is one short numeric row a document, written to the shared
folder. Each concentration step is two partial aggregations over those rows (an exact rank of quantised distances, then
sums), so a source that holds a third of all rows still meets the final task as one row a map task. The estimates are a few
rows a group; they are broadcast while their counted number is below a bound, and beyond it the rows of a group are salted
over many tasks, so that a hot group never meets one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazgrid.llm.common import SPACE_CLASS, SPACES, checkpointed, whole_text, written

WINDOW = 8
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: The transformed statistics, in the order of the matrix.
FEATURES = ("x_word_length", "x_symbols", "x_dup_lines", "x_repeats", "x_upper", "x_digits")
P = len(FEATURES)
#: Steps of the grid of a transformed statistic; whole numbers make sums exact and so independent of their order.
GRID = 1000


@dataclass(frozen=True)
class OutlierSettings:
    """support: share of a group that the estimate rests on. steps: concentration steps from every start, before the best one
    goes on until it no longer improves by ``least_fall`` (of half the logarithm of the determinant). small: starts from as few
    rows as give a scatter, of which some hold no outlier even where many rows are, besides the start from medians and the
    one from all rows. floor: standard deviation, in units of the transformed statistics, below which no direction counts as known. min_group: documents a group needs for
    an estimate of its own; smaller groups of a language pool, and smaller pools pool again over all languages.
    tail: chance that a clean Gaussian document is rejected; far below usual levels, since honest text has heavier tails than a Gaussian."""

    support: float = 0.75
    steps: int = 2
    small: int = 3
    least_fall: float = 1e-6
    floor: float = 0.06
    min_group: int = 100
    tail: float = 1e-14


def _fold_pairs(values: Column, step: int) -> Column:
    return F.zip_with(values, F.slice(values, F.lit(step + 1), F.size(values)), lambda a, b: F.xxhash64(a, b))


def text_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """One row a document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the raw counts of
    the outlier statistics. Null text counts as empty (no words); empty texts have all counts 0 and fail the base rule.

    Words in repeated windows come from 64-bit hashes of the document's own 8-word windows: three pairwise folds build
    them, a sort by hash finds the repeated ones, and sorted starts give the words that they cover.
    """
    t = whole_text(text)
    trimmed = F.trim(t, F.lit(SPACES))
    rare = F.regexp_replace(t, r"[^0-9A-Z#*$%&|<>]+", "")
    df = docs.select(*keep, t.alias("_t"), trimmed.alias("_trimmed"), rare.alias("_rare"))
    empty = F.array().cast("array<string>")

    def rare_length(pattern: str) -> Column:
        return F.length(F.regexp_replace("_rare", pattern, "")).cast("long")

    df = df.select(
        *keep,
        F.when(F.col("_trimmed") == "", empty).otherwise(F.split("_trimmed", f"{SPACE_CLASS}+")).alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("_lines"),
        (F.length("_t") - F.length(F.regexp_replace("_t", NOT_SPACE, ""))).cast("long").alias("word_chars"),
        rare_length("[0-9A-Z]+").alias("n_symbols"),
        rare_length("[^0-9]+").alias("_digits"),
        rare_length("[^A-Z]+").alias("_upper"),
    )
    counts = ("word_chars", "n_symbols", "_digits", "_upper")
    df = df.select(
        *keep, *counts,
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    counts += ("n_words", "_n_lines", "n_dup_lines")
    for step in (1, 2, 4):
        df = df.select(*keep, *counts, _fold_pairs(F.col("_h"), step).alias("_h"))
    df = df.select(*keep, *counts, F.slice("_h", F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")).alias("_h"))
    repeats = F.size("_h") > F.size(F.array_distinct("_h"))
    df = df.select(*keep, *counts, F.when(repeats, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_s"))
    again = F.filter("_s", lambda s, i: (F.get("_s", i - 1)["x"] == s["x"]).__or__(F.get("_s", i + 1)["x"] == s["x"]))
    df = df.select(*keep, *counts, F.array_sort(F.transform(again, lambda s: s["i"])).alias("_p"))
    gaps = F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    df = df.select(*keep, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _grid(x: Column) -> Column:
    return F.round(x * GRID).cast("double")


def transformed(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistic vector: rates, shrunk towards usual text for short documents, under roots and logarithms."""
    words, lines = F.col("n_words") + 40, F.col("_n_lines") + 10
    return stats.withColumns({
        "x_word_length": _grid(F.log((F.col("word_chars") + 200) / words)),
        "x_symbols": _grid(F.sqrt(F.col("n_symbols") / words)),
        "x_dup_lines": _grid(F.sqrt(F.col("n_dup_lines") / lines)),
        "x_repeats": _grid(F.sqrt(F.col("n_repeat_words") / words)),
        "x_upper": _grid(F.sqrt(F.col("_upper") / (F.col("word_chars") + 200))),
        "x_digits": _grid(F.sqrt(F.col("_digits") / (F.col("word_chars") + 200))),
    })


def chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution with an even number of degrees of freedom, in closed form."""
    terms = [1.0]
    for i in range(1, df // 2):
        terms.append(terms[-1] * (x / 2) / i)
    return 1.0 - math.exp(-x / 2) * sum(terms)


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < q else (low, middle)
    return high


def _key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), p), F.lit("null")) for p in parts))


def group_keys(rows: DataFrame, min_group: int) -> DataFrame:
    """(_full, _group) for each language and source: itself if it has enough documents, else its language's pool, else the pool of all."""
    full, lang = _key(F.col("lang").cast("string"), F.col("source").cast("string")), _key(F.col("lang").cast("string"))
    sizes = rows.groupBy(full.alias("_full"), lang.alias("_lang")).agg(F.count("*").alias("_n"))
    small = F.col("_n") < min_group
    pools = sizes.where(small).groupBy("_lang").agg(F.sum("_n").alias("_pool"))
    return sizes.join(pools, "_lang", "left").select(
        "_full",
        F.when(~small, F.concat(F.lit("source:"), "_full")).when(F.col("_pool") >= min_group, F.concat(F.lit("lang:"), "_lang")).otherwise(F.lit("all")).alias("_group"),
    )


#: Rows of a table that is broadcast, each a few hundred bytes; and parts of a group where it isn't.
BROADCAST_ROWS, SALT = 20_000, 64


def _with(rows: DataFrame, table: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` joined with the checkpointed ``table`` of a few rows a group; few: their number is below the bound."""
    if few:
        return rows.join(F.broadcast(table), on, how)
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)))
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return rows.join(table, [*on, "_salt"], how).drop("_salt")


def _sums(rows: DataFrame, keys: tuple[str, ...] = ("_group", "_start")) -> DataFrame:
    xs = [F.col(f) for f in FEATURES]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        *(F.sum(x).alias(f"_s{i}") for i, x in enumerate(xs)),
        *(F.sum(xs[i] * xs[j]).alias(f"_s{i}_{j}") for i in range(P) for j in range(i + 1)),
    )


def _whitener(sums: DataFrame, scale: float, floor: float) -> DataFrame:
    """Means, the inverse W of the Cholesky factor of scale * covariance + floor**2 (the distance is |W (x - mean)|**2), and
    _logdet, half the logarithm of its determinant."""
    keys = ["_group", "_start"]
    df = sums.select(*keys, *((F.col(f"_s{i}") / F.col("_n")).alias(f"_m{i}") for i in range(P)), *("_n", *(f"_s{i}_{j}" for i in range(P) for j in range(i + 1))))
    means = [f"_m{i}" for i in range(P)]

    def covariance(i: int, j: int) -> Column:
        c = (F.col(f"_s{i}_{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}")) * scale
        return F.greatest(c, F.lit(0.0)) + (floor * GRID) ** 2 if i == j else c

    df = df.select(*keys, *means, *(covariance(i, j).alias(f"_c{i}_{j}") for i in range(P) for j in range(i + 1)))

    def minus(value: Column, terms: list[Column]) -> Column:
        return reduce(lambda a, b: a - b, terms, value)

    for j in range(P):  # a column of the factor at a time; each level is a projection, so that nothing is expanded twice
        df = df.withColumn(f"_l{j}_{j}", F.sqrt(minus(F.col(f"_c{j}_{j}"), [F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)])))
        df = df.withColumns({f"_l{i}_{j}": minus(F.col(f"_c{i}_{j}"), [F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") for k in range(j)]) / F.col(f"_l{j}_{j}") for i in range(j + 1, P)})
    for i in range(P):
        inverse = {f"_w{i}_{i}": 1.0 / F.col(f"_l{i}_{i}")}
        for j in range(i):
            inverse[f"_w{i}_{j}"] = -reduce(lambda a, b: a + b, [F.col(f"_l{i}_{k}") * F.col(f"_w{k}_{j}") for k in range(j, i)]) / F.col(f"_l{i}_{i}")
        df = df.withColumns(inverse)
    logdet = reduce(lambda a, b: a + b, [F.log(F.col(f"_l{i}_{i}")) for i in range(P)])
    return checkpointed(df.select(*keys, *means, *(f"_w{i}_{j}" for i in range(P) for j in range(i + 1)), logdet.alias("_logdet")))


def _starts(rows: DataFrame, settings: OutlierSettings) -> DataFrame:
    """First estimates of each group: exact medians, and quartile ranges as independent scales (start 0; the grid bounds the
    distinct values that percentile() holds); mean and covariance of all rows (start 1), and of P + 1 rows, those with the
    least hash of their values under a seed of the start's (starts 2 on; a map task passes on no more rows than that)."""
    floor = settings.floor * GRID
    q = rows.groupBy("_group").agg(*(F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q{i}") for i, f in enumerate(FEATURES)))
    spread = [F.greatest((F.get(f"_q{i}", F.lit(2)) - F.get(f"_q{i}", F.lit(0))) / 1.349, F.lit(floor)) for i in range(P)]
    medians = q.select(
        "_group", F.lit(0).alias("_start"), *(F.get(f"_q{i}", F.lit(1)).alias(f"_m{i}") for i in range(P)),
        *((1.0 / spread[i] if i == j else F.lit(0.0)).alias(f"_w{i}_{j}") for i in range(P) for j in range(i + 1)), F.lit(None).cast("double").alias("_logdet"),
    )
    sums = _sums(rows.withColumn("_start", F.lit(1)))
    for start in range(2, 2 + settings.small):
        hashed = rows.select("_group", *FEATURES, F.xxhash64(F.lit(start), *FEATURES).alias("_hash"))
        w = Window.partitionBy("_group").orderBy("_hash")
        few = hashed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= P + 1)
        sums = sums.unionByName(_sums(few.withColumn("_start", F.lit(start))))
    return checkpointed(medians.unionByName(_whitener(sums, 1.0, settings.floor)))


def _distances(rows: DataFrame, estimate: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    z = [F.col(f) - F.col(f"_m{i}") for i, f in enumerate(FEATURES)]
    y = [reduce(lambda a, b: a + b, [F.col(f"_w{i}_{j}") * z[j] for j in range(i + 1)]) for i in range(P)]
    distance = reduce(lambda a, b: a + b, [v * v for v in y])
    return _with(rows, estimate, ["_group"], few, how).select(*rows.columns, "_start", distance.alias("_d2"))


def _concentrated(rows: DataFrame, estimate: DataFrame, settings: OutlierSettings, few: bool) -> DataFrame:
    """The estimate after a step: that of the share of each group that lies nearest by the one before."""
    consistency = settings.support / chi2_cdf(chi2_quantile(settings.support, P), P + 2)
    # Distances on a grid of a hundredth in logarithm: the exact rank of the support needs a few hundred counts a group.
    near = _distances(rows, estimate, few).withColumn("_b", F.floor(100 * F.log(F.col("_d2") + 1e-6)).cast("long"))
    cut = checkpointed(near.groupBy("_group", "_start").agg(F.expr(f"percentile_disc({settings.support}) WITHIN GROUP (ORDER BY _b)").alias("_cut")))
    return _whitener(_sums(_with(near, cut, ["_group", "_start"], few).where(F.col("_b") <= F.col("_cut"))), consistency, settings.floor)


def _least(estimates_: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the estimate with the least determinant; of equal ones that of the first start."""
    rest = [c for c in estimates_.columns if c not in (*keys, "_logdet", "_start")]
    order = ["_logdet", *(["_start"] if "_start" not in keys else []), *rest]
    best = estimates_.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_e"))
    return checkpointed(best.select(*((F.col(c) if c in keys else F.col(f"_e.{c}")).alias(c) for c in estimates_.columns)))


def estimates(rows: DataFrame, settings: OutlierSettings = OutlierSettings(), few: bool = False) -> DataFrame:
    """The reweighted MCD estimate of each _group of ``rows`` (_group and FEATURES on the grid): means _m, inverse factor _w.
    few: the groups are few enough to broadcast."""
    s = settings
    estimate = _concentrated(rows, _starts(rows, s), s, few)
    for _ in range(s.steps - 1):
        estimate = _least(estimate.unionByName(_concentrated(rows, estimate, s, few)), ["_group", "_start"])
    best = moving = _least(estimate, ["_group"])
    while True:  # each round, at least one group's determinant falls by least_fall, and floor bounds it from below
        new = _concentrated(rows, moving, s, few)
        old = moving.select("_group", F.col("_logdet").alias("_old"))
        moving = checkpointed(new.join(old, "_group").where(F.col("_logdet") < F.col("_old") - s.least_fall).drop("_old"))
        if moving.isEmpty():
            break
        best = checkpointed(best.join(moving, "_group", "left_anti").unionByName(moving))
    weight_cut = chi2_quantile(0.975, P)
    return _whitener(_sums(_distances(rows, best, few).where(F.col("_d2") <= weight_cut)), 0.975 / chi2_cdf(weight_cut, P + 2), s.floor)


def outlier_verdicts(stats: DataFrame, settings: OutlierSettings = OutlierSettings()) -> DataFrame:
    """``stats`` with distance2 (null where base_failed) and kept.

    Only documents that pass the base rules shape the estimates. A language and source with fewer than ``min_group`` of
    them share the estimate of their pool (see ``group_keys``); null languages or sources are groups like others. Equal
    rows and ties at the support's rank all count in. A direction without spread gets ``floor`` as its deviation.
    Empty input gives an empty result. kept is false if base_failed, else whether the distance is within the chi-square
    bound for ``tail``.
    """
    full = _key(F.col("lang").cast("string"), F.col("source").cast("string"))
    rows = stats.where(~F.col("base_failed")).select(full.alias("_full"), *FEATURES)
    keys = checkpointed(group_keys(stats.where(~F.col("base_failed")), settings.min_group))
    few = keys.count() * (2 + settings.small) <= BROADCAST_ROWS
    rows = written(_with(rows, keys, ["_full"], few).drop("_full"), "grouped")
    estimate = estimates(rows, settings, few)
    bound = chi2_quantile(1 - settings.tail, P)
    judged = _with(stats.withColumn("_full", full), keys, ["_full"], few, "left")
    judged = _distances(judged, estimate, few, "left").withColumn("distance2", F.when(~F.col("base_failed"), F.col("_d2")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= bound)).drop("_full", "_group", "_start", "_d2")


def _judged(docs: DataFrame, settings: OutlierSettings) -> DataFrame:
    """Statistics and verdict of each row of ``docs`` (kept_row, a struct, lang, source, text). The statistics are written to
    the shared folder with the rows, so texts are read once whatever the number of steps, and verdicts never have to find
    the rows that they are of."""
    stats = transformed(text_statistics(docs, keep=("kept_row", "lang", "source")))
    return outlier_verdicts(written(stats, "quality"), settings)


def quality_rules(docs: DataFrame, settings: OutlierSettings = OutlierSettings()) -> DataFrame:
    """doc_id, lang, source, statistics and verdict of each document (columns doc_id, lang, source, text are read; others are
    ignored). Repeated rows of a document give repeated rows; see ``text_statistics`` and ``outlier_verdicts`` for the rest."""
    return _judged(docs.select(F.struct("doc_id").alias("kept_row"), "lang", "source", "text"), settings).select("kept_row.doc_id", "*").drop("kept_row")


def kept_documents(docs: DataFrame, settings: OutlierSettings = OutlierSettings()) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, all columns, whatever they are called."""
    return _judged(docs.select(F.struct(*docs.columns).alias("kept_row"), "lang", "source", "text"), settings).where("kept").select("kept_row.*")


OUTPUT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document, with its squared distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(*OUTPUT, "distance2")
