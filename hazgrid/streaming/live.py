"""Live operators on Structured Streaming: sessions, windows, decayed keyed statistics, incidents that expire."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION_GAP = "30 minutes"
HALF_LIFE_SECONDS = 120 * 86_400.0


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """The column as an instant: watermarks don't take times without a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = SESSION_GAP, delay: str = "1 day") -> DataFrame:
    """Sessions of a key, ended by a gap. Works on batches and streams; a stream emits a session when the watermark passes it."""
    events = event_time(events)
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    grouped = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def windows(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Tumbling or sliding windows by event type."""
    events = event_time(events)
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def decayed_state(events: DataFrame, key: str = "user_id", half_life: float = HALF_LIFE_SECONDS) -> DataFrame:
    """A decayed weight and mean for each key, brought up to each batch's latest event; state is three numbers a key.
    Values that come late count at the weight of the state's time."""

    def update(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, total, last = state.get if state.exists else (0.0, 0.0, 0.0)
        for frame in frames:
            frame = frame.sort_values("ts")
            for t, value in zip(frame["ts"].astype("int64") / 1e9, frame["value"], strict=True):
                if weight and t > last:
                    factor = 2.0 ** (-(t - last) / half_life)
                    weight, total = weight * factor, total * factor
                weight, total, last = weight + 1, total + value, max(last, t)
        state.update((weight, total, last))
        yield pd.DataFrame({key: [k[0]], "weight": [weight], "mean": [total / weight], "last": [last]})

    return event_time(events).select(key, "ts", "value").groupBy(key).applyInPandasWithState(update, f"{key} long, weight double, mean double, last double", "weight double, total double, last double", "update", GroupStateTimeout.NoTimeout)


def visible_incidents(incidents: DataFrame, now, lifetimes: dict[str, int], usual: int = 3600) -> DataFrame:
    """Incidents (kind, ts, ...) still within the lifetime of their kind at ``now``."""
    seconds = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in lifetimes.items() for x in kv]), F.col("kind")), F.lit(usual))
    return incidents.where(F.unix_timestamp(F.col("ts").cast("timestamp")) + seconds > F.unix_timestamp(F.lit(now).cast("timestamp")))
