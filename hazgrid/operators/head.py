"""A small neural head: eight features, sixteen rectified units, one sigmoid. Training takes one bounded sample a key; prediction
is a column expression, so that scoring stays in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES, HIDDEN = 8, 16
# Fixed values of a tuning: passes, rate, pull towards the given weights; trips, seconds since the last one and new trips that
# make one due.
TUNE_EPOCHS, TUNE_RATE, TUNE_ANCHOR, TUNE_TRIPS, TUNE_SECONDS, TUNE_NEW = 60, 0.01, 0.02, 12, 86_400.0, 5


def forward(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, 1 / (1 + np.exp(-(hidden @ w2 + b2)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, seed: int) -> np.ndarray:
    """All weights in one vector, by Adam on the weighted squared error."""
    rng = np.random.default_rng(seed)
    theta = np.concatenate([rng.normal(0, np.sqrt(2 / (FEATURES + HIDDEN)), FEATURES * HIDDEN), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / (HIDDEN + 1)), HIDDEN), [0.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = FEATURES * HIDDEN
    for step in range(1, epochs + 1):
        w1, b1, w2, b2 = theta[:n].reshape(FEATURES, HIDDEN), theta[n : n + HIDDEN], theta[n + HIDDEN : n + 2 * HIDDEN], theta[-1]
        hidden, p = forward(w1, b1, w2, b2, x)
        out = 2 * weight * (p - y) * p * (1 - p) / weight.sum()
        back = np.outer(out, w2) * (hidden > 0)
        gradient = np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), hidden.T @ out, [out.sum()]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def train_heads(rows: DataFrame, key: str, keep: int = 5000, epochs: int = 400, rate: float = 0.02, seed: int = 7) -> DataFrame:
    """(key, theta, n): a head for each key from rows (key, x array<double>, y, weight); the ``keep`` rows with the least hash of
    their features are its sample, so no key's rows are gathered whole."""
    w = Window.partitionBy(key).orderBy(F.xxhash64("x"), "y")
    sample = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).select(key, "x", "y", "weight")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "weight"], ignore_index=True)
        theta = fit(np.stack(frame["x"].to_numpy()), frame["y"].to_numpy(float), frame["weight"].to_numpy(float), epochs, rate, seed)
        return pd.DataFrame({key: [frame[key].iloc[0]], "theta": [theta], "n": [len(frame)]})

    return sample.groupBy(key).applyInPandas(one, f"{key} long, theta array<double>, n long")


def tuning_due(trips: Column, since_last: Column, tuned_at: Column) -> Column:
    """Whether a head is to be tuned: enough trips, a day since the last time (null: never), and enough new trips since."""
    rested = since_last.isNull() | F.isnan(since_last) | (since_last >= TUNE_SECONDS)
    return F.coalesce((trips >= TUNE_TRIPS) & rested & (trips - F.coalesce(tuned_at, F.lit(0)) >= TUNE_NEW), F.lit(False))


def tuned(theta: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, anchor: float) -> np.ndarray:
    """``theta`` after full passes of descent on the weighted squared error, each of which also pulls it back to where it began."""
    n = FEATURES * HIDDEN
    now = theta.copy()
    for _ in range(epochs):
        w1, b1, w2, b2 = now[:n].reshape(FEATURES, HIDDEN), now[n : n + HIDDEN], now[n + HIDDEN : n + 2 * HIDDEN], now[-1]
        hidden, p = forward(w1, b1, w2, b2, x)
        out = weight * (p - y) * p * (1 - p)
        back = np.outer(out, w2) * (hidden > 0)
        gradient = np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), hidden.T @ out, [out.sum()]])
        now = now - rate / max(weight.sum(), 1.0) * gradient - anchor * (now - theta)
    return now


def tune_heads(
    heads: DataFrame, rows: DataFrame, key: str, keep: int = 5000, share: int = 4, epochs: int = TUNE_EPOCHS, rate: float = TUNE_RATE, anchor: float = TUNE_ANCHOR
) -> DataFrame:
    """(key, theta, accepted, before, after, n) of the ``heads`` (key, theta, trips, since_last, tuned_at) on their own ``rows`` (key,
    x, y, weight): training starts from the given weights and is anchored at them; one row in ``share``, by a hash of its
    features, is held out, and its mean squared error before and after decides. A head that isn't due (see ``tuning_due``), has
    no rows to learn from or to judge by, or would get worse, comes back as it was, not accepted.

    Rows whose y is null or no number, or whose features are, don't count; negative weights count as 0. Of a key's rows the
    ``keep`` with the least hash are its sample, a bound of the training, so that no key is gathered whole."""
    sound = F.col("y").isNotNull() & ~F.isnan("y") & (F.size("x") == FEATURES) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    w = Window.partitionBy(key).orderBy(F.xxhash64("x"), "y", "weight")
    sample = rows.where(sound).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    sample = sample.select(key, "x", F.least(F.greatest(F.col("y").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("y"), F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)).cast("double").alias("weight"), (F.pmod(F.xxhash64("x"), F.lit(share)) == 0).alias("held"))
    due = heads.where(tuning_due(F.col("trips"), F.col("since_last"), F.col("tuned_at"))).select(key, "theta")

    def one(k: tuple, head: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(head) or not frame["held"].any() or frame["held"].all():
            return pd.DataFrame({key: pd.Series(dtype="int64"), "new": pd.Series(dtype=object), "before": pd.Series(dtype=float), "after": pd.Series(dtype=float), "n": pd.Series(dtype="int64")})
        frame = frame.sort_values(["y", "weight"], ignore_index=True)
        x, y, weight, held = np.stack(frame["x"].to_numpy()), frame["y"].to_numpy(float), frame["weight"].to_numpy(float), frame["held"].to_numpy(bool)
        theta = np.array(head["theta"].iloc[0], float)

        def error(t: np.ndarray) -> float:
            n = FEATURES * HIDDEN
            return float(((forward(t[:n].reshape(FEATURES, HIDDEN), t[n : n + HIDDEN], t[n + HIDDEN : n + 2 * HIDDEN], t[-1], x[held])[1] - y[held]) ** 2).mean())

        new = tuned(theta, x[~held], y[~held], weight[~held], epochs, rate, anchor)
        return pd.DataFrame({key: [k[0]], "new": [new], "before": [error(theta)], "after": [error(new)], "n": [int((~held).sum())]})

    found = due.groupBy(key).cogroup(sample.groupBy(key)).applyInPandas(one, f"{key} long, new array<double>, before double, after double, n long")
    better = F.coalesce(F.col("after") <= F.col("before"), F.lit(False)) & F.forall("new", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    both = heads.select(key, "theta").join(found, key, "left").withColumn("accepted", F.coalesce(better, F.lit(False)))
    return both.select(key, F.when(F.col("accepted"), F.col("new")).otherwise(F.col("theta")).alias("theta"), "accepted", "before", "after", F.coalesce("n", F.lit(0)).alias("n"))


def predict(theta: Column, x: Column) -> Column:
    """The head's answer for features ``x``, both arrays."""
    n = FEATURES * HIDDEN

    def unit(j: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(0), F.lit(FEATURES - 1)), F.get(theta, j + n), lambda s, i: s + F.get(x, i) * F.get(theta, i * HIDDEN + j))
        return F.greatest(total, F.lit(0.0)) * F.get(theta, j + n + HIDDEN)

    z = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(HIDDEN - 1)), unit), F.get(theta, F.lit(n + 2 * HIDDEN)), lambda s, u: s + u)
    return 1 / (1 + F.exp(-z))
