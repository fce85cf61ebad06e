"""Fitted operators and the pipeline."""

import math
import os
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hazgrid.llm import toxicity

SF = "/root/testdata/sf0.001"


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            sentences.insert(rng.randint(0, len(sentences)), f"you utter {rng.choice(['zork', 'zorka', 'zorkel'])} " + rng.choice(plain))
        rows.append((i, ". ".join(sentences), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels.where("doc_id < 400"))
    got = toxicity.score(docs, model).where("doc_id >= 400").collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    where = {r.doc_id: r.sentence for r in toxicity.offending_sentences(docs.where("doc_id >= 400"), model).collect()}
    assert set(where) == {r.doc_id for r in got if r.predicted} and all("zork" in s for s in where.values())


def test_fit_takes_little_memory():
    """pipeline: a step of the fit makes parts of what it needs, besides the features themselves."""
    rng = np.random.default_rng(2)
    docs = [[rng.integers(0, 5000, 20_000).astype(np.int32)] for _ in range(200)]
    tracemalloc.start()
    toxicity.fit_noisy_or(docs, np.arange(200) % 2, toxicity.TrainSettings(steps=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * 4 * 20_000 * 200


def test_toxicity_edges(spark):
    docs, labels = corpus(spark, 40)
    odd = spark.createDataFrame([(None, "x y. z", "en", "s", 0), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a " * 50_000, "en", "s", 0)], docs.schema)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 5 and [r.score for r in rows if r.doc_id in (1, 2)] == [0.0] * 3
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_scores_are_the_noisy_or_of_sentences(spark):
    docs, labels = corpus(spark, 80)
    model = toxicity.train(docs, labels)
    weights = np.frombuffer(model, np.float32)
    for r in toxicity.score(docs, model, keep=("doc_id", "text")).collect():
        harmless, worst = 1.0, (0.0, 0)
        for start, _, words in toxicity.sentences(r.text):
            z = float(weights[-1]) + sum(float(weights[f]) for w in words for f in toxicity.word_features(w))
            p = 1 / (1 + math.exp(-z))
            harmless *= 1 - p
            worst = max(worst, (p, -start))
        assert r.score == pytest.approx(1 - harmless, abs=1e-4) and r.worst_start == -worst[1]


def test_gradient_steps_against_plain_loops():
    """One step of the fit moves each weight against the gradient of the noisy-or loss, as found by differences."""
    docs = [[np.array([0, 1]), np.array([2])], [np.array([1])], [np.array([0, 2]), np.array([1, 2])]]
    toxic = np.array([1, 0, 1])
    settings = toxicity.TrainSettings(least_docs=1, steps=1, rate=0.01, decay=0.0)
    share = [settings.prior / 2, (1 - settings.prior), settings.prior / 2]

    def loss(w):
        total = 0.0
        for d, y, s in zip(docs, toxic, share, strict=True):
            harmless = math.prod(1 - 1 / (1 + math.exp(-(w[3] + sum(w[f] for f in sentence)))) for sentence in d)
            total -= s * math.log(1 - harmless if y else harmless)
        return total

    moved = toxicity.fit_noisy_or(docs, toxic, settings)[[0, 1, 2, -1]] - np.array([0, 0, 0, -6.0])
    for k in range(4):
        up, down = ([(-6.0 if i == 3 else 0.0) + (e if i == k else 0.0) for i in range(4)] for e in (1e-5, -1e-5))
        assert np.sign(moved[k]) == -np.sign(loss(up) - loss(down)) and abs(abs(moved[k]) - 0.01) < 1e-3


def test_repeated_rows_do_not_grow_the_sample(spark):
    docs, labels = corpus(spark, 60)
    many = docs.unionByName(docs).unionByName(docs.limit(0))
    assert toxicity.train(many, labels) == toxicity.train(docs, labels)


def odd_documents(spark, docs):
    """``docs`` with nulls in every column, empty and long texts, repeated rows, and columns whose names clash."""
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (990_001, "word " * 30_000, None, "s", None), (990_002, "just one", "en", "s", 8)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    odd = odd.unionByName(docs.limit(20)).unionByName(docs.limit(20))
    return odd.withColumns({c: F.lit(i) for i, c in enumerate(("spans", "_t", "_text", "score", "kept", "row", "digest", "n_words", "kept_row", "base_failed", "_group"))})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_documents(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = odd_documents(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    out = stage(spark, odd, SF)
    n = out.count()
    if name == "best_fit_packing":
        assert n >= odd.count()
        assert stage(spark, odd.limit(0), SF).count() == 0
        return
    assert out.columns == odd.columns and 0 < n <= odd.count()
    assert stage(spark, odd.limit(0), SF).count() == 0
    if name == "near_duplicates":
        with_words = out.where("doc_id is not null and n_chars > 0")
        assert with_words.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    if name == "quality_rules":
        assert out.where("doc_id in (990001, 990002)").isEmpty()
    if name == "secret_scan":
        assert n == odd.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_rejected_row_goes_though_another_has_its_doc_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF).select("doc_id").first()[0]
    junk = docs.limit(1).select(F.lit(kept).alias("doc_id"), F.lit("junk").alias("text"), *(c for c in docs.columns if c not in ("doc_id", "text"))).select(*docs.columns)
    out = corpus_pipeline.quality_stage(spark, docs.unionByName(junk), SF).where(F.col("doc_id") == kept)
    assert [r.text == "junk" for r in out.collect()] == [False]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "secret_scan", "best_fit_packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before and len(after) >= 0.5 * len(before), name
        assert kept.columns == docs.columns
        if name == "secret_scan":
            assert after == before
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == after
    whole = corpus_pipeline.run(spark, SF)
    assert whole.select("doc_id").distinct().count() == len(after)
