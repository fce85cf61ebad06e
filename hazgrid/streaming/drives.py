"""Drives out of a stream of fixes: state by traveller, closed by gaps and by timers.

A traveller's state is of three kinds: habits (miles since the last fill, average speed, share of idling), which go on from
drive to drive; the drive that is open; and how often each kind of fix came in it. A drive ends with a fix that comes a gap
later, or when the watermark passes its end. State is a few numbers a traveller, however many fixes come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hazgrid.operators.shared import shared_dir
from hazgrid.streaming.live import event_time

# Weight of a fix in the averages, metres of a mile, miles an hour of a metre a second, and the speed up to which
# a traveller idles.
ALPHA, MILE, MPH, IDLE = 0.0003, 1609.344, 2.236936, 1.0
SCHEMA = "user_id long, start double, end double, fixes long, miles double, since_fill double, mph double, idle double, kinds string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def habits_after(habits: tuple[float, float, float], speed: float, metres: float, towing: bool, factor: float) -> tuple[float, float, float]:
    """(miles since the fill, average miles an hour, share of idling) after a fix."""
    miles, mph, idle = habits
    driven = max(metres, 0.0) / MILE
    now = max(speed, 0.0) * MPH
    return miles + (driven / factor if towing else driven), mph * (1 - ALPHA) + now * ALPHA if now > IDLE else mph, idle * (1 - ALPHA) + (ALPHA if now <= IDLE else 0.0)


class Drives(StatefulProcessor):
    """Fixes (user_id, ts, fix, kind, speed, metres, towing, filled) to closed drives."""

    def __init__(self, gap: float, factor: float, start: tuple[float, float, float]):
        self.gap, self.factor, self.first = gap, factor, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.habits = handle.getValueState("habits", "miles double, mph double, idle double")
        self.drive = handle.getValueState("drive", "start double, last double, fixes long, miles double")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    @staticmethod
    def _closed(user: int, drive: tuple, habits: tuple, kinds: dict[str, int]) -> tuple:
        return (user, *drive, *habits, ",".join(f"{k}:{n}" for k, n in sorted(kinds.items())))

    def _known(self) -> dict[str, int]:
        return {k[0]: v[0] for k, v in self.kinds.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """State is read once and written once a traveller and batch; the fixes between work on plain values."""
        fixes = pd.concat([*rows], ignore_index=True)
        fixes["t"] = fixes["ts"].astype("datetime64[us]").astype("int64") / 1e6
        fixes = fixes.sort_values(["t", "fix"], ignore_index=True)
        habits = self.habits.get() if self.habits.exists() else self.first
        drive = self.drive.get() if self.drive.exists() else None
        kinds = {} if drive is None else self._known()
        if drive is not None:
            self.handle.deleteTimer(self._end(drive))
            self.kinds.clear()
        out = []
        for t, kind, speed, metres, towing, filled in fixes[["t", "kind", "speed", "metres", "towing", "filled"]].itertuples(index=False, name=None):
            if drive is not None and t - drive[1] >= self.gap:
                out.append(self._closed(key[0], drive, habits, kinds))
                drive, kinds = None, {}
            before = 0.0 if filled else habits[0]
            habits = habits_after((before, *habits[1:]), speed, metres, towing, self.factor)
            driven = habits[0] - before
            drive = (t, t, 1, driven) if drive is None else (drive[0], max(drive[1], t), drive[2] + 1, drive[3] + driven)
            kinds[kind] = kinds.get(kind, 0) + 1
        self.habits.update(tuple(map(float, habits)))
        self.drive.update(drive)
        for kind, n in kinds.items():
            self.kinds.updateValue((kind,), (n,))
        self.handle.registerTimer(self._end(drive))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def _end(self, drive: tuple) -> int:
        return int((drive[1] + self.gap) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.drive.exists():
            row = self._closed(key[0], self.drive.get(), self.habits.get(), self._known())
            self.drive.clear()
            self.kinds.clear()
            yield pd.DataFrame([row], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def drives(fixes: DataFrame, gap: float, delay: str, factor: float = 0.7, start: tuple[float, float, float] = (0.0, 45.0, 0.1)) -> DataFrame:
    """The drives that a stream of ``fixes`` has closed: when (seconds since 1970), fixes, miles at the economy of towing where
    towed (``factor``), and after it the miles since the fill, average speed and share of idling, which ``start`` begins. Fixes
    of one traveller count in order of time within a batch; later ones count when they come. Needs the state store that keeps
    several states a key."""
    stream = event_time(fixes).withWatermark("ts", delay).select("user_id", "ts", "fix", "kind", "speed", "metres", "towing", "filled")
    return stream.groupBy("user_id").transformWithStateInPandas(Drives(gap, factor, start), SCHEMA, "Append", "EventTime")


def settled_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What ``stream`` emits for all that is there now, from a table in the shared folder that it writes before it ends."""
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
