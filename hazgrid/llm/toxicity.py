"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from labels of documents.

A document is toxic unless all of its sentences are harmless: P = 1 - prod(1 - p_s) with p_s = sigmoid(bias + weights of
the sentence's words). Words count by hashed features: the word and its first three to six characters.

Scale: the model is fitted in one task on a sample of labelled documents that ``TrainSettings`` bounds, and is a vector of
fixed size; scoring is map-only over all whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazgrid.llm.tokens import slices

BITS = 18
THRESHOLD = 0.3
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 300_000
#: Features that a step of the fit works on at a time.
PART = 500_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class TrainSettings:
    """max_toxic, max_clean: labelled documents of each class that the model is fitted on at most, those with the least
    hash of their doc_id. least_docs: documents of the sample that a feature must stand in. steps, rate, decay: of the
    gradient descent (Adam, weights decayed towards 0 at each step). prior: weight of the toxic class in the loss, whatever
    its part of the sample, so that scores mean the same at every size. decay and prior were chosen on fold 0, with models
    of folds 1 and 3."""

    max_toxic: int = 1500
    max_clean: int = 2500
    least_docs: int = 8
    steps: int = 70
    rate: float = 0.3
    decay: float = 0.04
    prior: float = 0.2


def word_features(word: str) -> list[int]:
    keys = [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) >> (32 - BITS) for k in keys]


class _Features(dict):
    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = np.array(word_features(word), np.int32)
        self[word] = value
        return value


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of ``text`` that have words: runs between full stops, marks and line ends."""
    for m in SENTENCE.finditer(text or ""):
        words = WORD.findall(m[0].lower())
        if words:
            yield m.start(), m.end(), words


def fit_noisy_or(docs: list[list[np.ndarray]], toxic: np.ndarray, settings: TrainSettings) -> np.ndarray:
    """Weights, the last one the bias, from each document's sentences (arrays of features) and its label."""
    keep = [i for i, d in enumerate(docs) if d]
    toxic = toxic[keep].astype(np.float64)
    n_toxic = toxic.sum()
    share = np.where(toxic == 1, settings.prior / max(n_toxic, 1), (1 - settings.prior) / max(len(toxic) - n_toxic, 1))
    per_sentence = [s for i in keep for s in docs[i]]
    if not per_sentence:
        return np.append(np.zeros(1 << BITS, np.float32), np.float32(-6))
    n_sentences = np.array([len(docs[i]) for i in keep])
    owner = np.repeat(np.arange(len(keep)), n_sentences)
    first = np.cumsum(n_sentences) - n_sentences
    lengths = np.array([len(s) for s in per_sentence], np.int64)
    flat = np.concatenate(per_sentence)
    in_docs = np.zeros(1 << BITS, np.int32)
    for i in keep:
        in_docs[np.unique(np.concatenate(docs[i]))] += 1
    used = np.flatnonzero(in_docs >= settings.least_docs)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    index = place[flat]
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[index >= 0]
    index = index[index >= 0]
    # The features in parts of whole sentences: what a step makes of them is as large as a part.
    borders = np.unique(np.searchsorted(sentence, sentence[::PART])).tolist() + [len(index)]
    parts = [(slice(a, b), sentence[a], sentence[b - 1] + 1) for a, b in zip(borders, borders[1:])]
    w, bias = np.zeros(len(used)), -6.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, settings.steps + 1):
        z = np.zeros(len(lengths))
        for part, first_of, end in parts:
            z[first_of:end] = np.bincount(sentence[part] - first_of, w[index[part]], end - first_of)
        z = np.clip(bias + z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        harmless = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first)
        total = np.maximum(-np.expm1(harmless), 1e-9)
        pull = share * np.where(toxic == 1, -np.exp(harmless) / total, 1.0)
        slope = pull[owner] * p
        gradient = np.append(np.zeros(len(used)), slope.sum())
        for part, *_ in parts:
            np.add.at(gradient, index[part], slope[sentence[part]])
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        move = settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w = (w - move[:-1]) * (1 - settings.decay)
        bias -= move[-1]
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[used], weights[-1] = w, bias
    return weights


def train(docs: DataFrame, labels: DataFrame, settings: TrainSettings = TrainSettings()) -> bytes:
    """The model (float32 weights as bytes) from ``labels`` (doc_id, toxic 0 or 1) of ``docs``.

    Labels that are null count as missing, a document with several takes the greatest. Of several rows with one doc_id the
    least text is learned from, so that the sample stays within its bounds. Without labelled documents the model finds
    nothing toxic.
    """
    each = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = [each.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, settings.max_toxic), (0, settings.max_clean))]
    sample = some[0].unionByName(some[1])

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Features()
        for batch in batches:
            for part in slices(batch, "text"):
                flat, ends = [], []
                for text in part.column("text").to_pylist():
                    found = [np.concatenate([table[w] for w in words]) for _, _, words in sentences(text)]
                    flat.append(np.concatenate(found).tobytes() if found else b"")
                    ends.append(np.cumsum([len(x) for x in found], dtype=np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(flat, pa.binary()), pa.array(ends, pa.binary())], ["doc_id", "toxic", "flat", "ends"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "flat"], ignore_index=True)
        pairs = zip(frame["flat"], frame["ends"], strict=True)
        documents = [np.split(np.frombuffer(f, np.int32), np.frombuffer(e, np.int32)[:-1]) if e else [] for f, e in pairs]
        return pd.DataFrame({"model": [fit_noisy_or(documents, frame["toxic"].to_numpy(), settings).tobytes()]})

    # The sample's size is bounded by the settings, so broadcasting its ids and gathering its features in one task are too.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    made = chosen.mapInArrow(features, "doc_id long, toxic int, flat binary, ends binary").withColumn("sample", F.lit("all"))
    rows = made.groupBy("sample").applyInPandas(fit, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else fit_noisy_or([], np.empty(0), settings).tobytes()


class _Weights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = float(self.weights[word_features(word)].sum())
        self[word] = value
        return value


def score(docs: DataFrame, model: bytes, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, score (noisy-or of all sentences of the whole text, 0 without any), predicted (score >= 0.3), and the place
    of the worst sentence (worst_start, worst_end in code points, worst_score; null without sentences).

    Null and empty texts score 0. Repeated rows give repeated rows, an empty table none. Of equally bad sentences the first
    is the worst. Columns of ``keep`` may have any names but those of the result."""
    fields = {"score": "double", "predicted": "int", "worst_start": "int", "worst_end": "int", "worst_score": "double"}
    if set(keep) & fields.keys():
        raise ValueError("a kept column can't have the name of a result's column")
    source = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = source.select("kept", *(F.lit(None).cast(t).alias(k) for k, t in fields.items())).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, np.float32)
        table, bias = _Weights(weights[:-1]), float(weights[-1])
        for batch in batches:
            for part in slices(batch, "_text"):
                out: list[list] = [[], [], [], [], []]
                for text in part.column("_text").to_pylist():
                    found = [(s, e, bias + sum(map(table.__getitem__, words))) for s, e, words in sentences(text)]
                    row = (0.0, 0, None, None, None)
                    if found:
                        z = np.clip(np.array([f[2] for f in found]), -30, 30)
                        total = float(-np.expm1(-np.logaddexp(0, z).sum()))
                        k = int(z.argmax())
                        row = total, int(total >= THRESHOLD), found[k][0], found[k][1], float(1 / (1 + np.exp(-z[k])))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("kept"), *arrays], ["kept", *fields])

    return source.mapInArrow(run, schema).select("kept.*", *fields)


def offending_sentences(docs: DataFrame, model: bytes, least: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, sentence, score) of each sentence whose own score is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, np.float32)
        table, bias = _Weights(weights[:-1]), float(weights[-1])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for start, end, words in sentences(text):
                    p = 1 / (1 + float(np.exp(-np.clip(bias + sum(map(table.__getitem__, words)), -30, 30))))
                    if p >= least:
                        rows.append((doc_id, start, end, text[start:end], p))
            names = ["doc_id", "start", "end", "sentence", "score"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start int, end int, sentence string, score double")


def fold() -> Column:
    """The fold of a document; fold 2 is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))


def toxicity_model(spark, docs: DataFrame, sf_dir: str) -> bytes:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 2)
    return train(docs, labels)


def op5_toxicity(spark, sf_dir):
    """Scores of every document by a model of the labels outside fold 2, with the worst sentence's place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted", "worst_start", "worst_end", "worst_score")
