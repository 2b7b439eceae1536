"""Streams with typed state and timers of their own, by ``transformWithStateInPandas``.

State is kept in RocksDB under the checkpoint, a column a value; rows come as frames of bounded size, and state is read and written once a key and batch; a timer or a time to live ends a
key, and a restart goes on from the checkpoint. A stream takes the store that the session has when it starts, so it is started within ``enabled``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def enabled(spark: SparkSession) -> Iterator[None]:
    """Streams that this session starts meanwhile keep state in RocksDB."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)


class LastPosition(StatefulProcessor):
    """The latest place of a vessel, given out when it changes, and as expired once event time is ``expire_ms`` past it."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, latitude double, longitude double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        best = max(self.latest(frame) for frame in rows)
        if before is not None and best <= before:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update(best)
        self.handle.registerTimer(max(best[0] // 1000 + self.expire_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.given(key, best, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        best = tuple(self.last.get())
        self.last.clear()
        yield self.given(key, best, True)

    @staticmethod
    def latest(frame: pd.DataFrame) -> tuple[int, float, float]:
        """The latest place of a frame, of several at one time the largest."""
        us, latitude, longitude = (frame[c].to_numpy() for c in ("us", "latitude", "longitude"))
        at = np.flatnonzero(us == us.max())
        return max((int(us[i]), float(latitude[i]), float(longitude[i])) for i in at.tolist())

    @staticmethod
    def given(key: Any, best: tuple[int, float, float], expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"vessel": [key[0]], "us": [best[0]], "latitude": [best[1]], "longitude": [best[2]], "expired": [expired]})

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Visits of one key: rows with no more than ``gap_ms`` between them, given out whole once event time is past their end."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "until long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # the open visits are read once a batch, not once a row; each frame of rows becomes visits before it meets them
        before = {start: (end, n) for (start,), (end, n) in self.open.iterator()}
        visits = [(start, end, n) for start, (end, n) in before.items()]
        for frame in rows:
            at = np.sort(frame["ms"].to_numpy(dtype=np.int64))
            first = np.flatnonzero(np.diff(at, prepend=at[0] - self.gap_ms - 1) > self.gap_ms)
            last = np.append(first[1:], len(at)) - 1
            visits = self.merged([*visits, *zip(at[first].tolist(), at[last].tolist(), (last - first + 1).tolist())])
        after = {start: (end, n) for start, end, n in visits}
        for start in before.keys() - after.keys():
            self.open.removeKey((start,))
        for start, visit in after.items():
            if before.get(start) != visit:
                self.open.updateValue((start,), visit)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(min(end for _, end, _ in visits) + self.gap_ms + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def merged(self, visits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, n) of visits, those within ``gap_ms`` of each other as one."""
        out: list[tuple[int, int, int]] = []
        for start, end, n in sorted(visits):
            if out and start - self.gap_ms <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
            else:
                out.append((start, end, n))
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, left, over = timerValues.getCurrentWatermarkInMs(), [], []
        for (start,), (end, n) in list(self.open.iterator()):
            if end + self.gap_ms < now:
                self.open.removeKey((start,))
                over.append((key[0], start, end, n))
            else:
                left.append(end)
        if left:
            self.handle.registerTimer(max(min(left) + self.gap_ms + 1, now + 1))
        if over:
            yield pd.DataFrame(over, columns=["key", "start_ms", "end_ms", "n"])

    def close(self) -> None:
        pass


def last_positions(df: DataFrame, expire_minutes: int = 10, late: str = "10 minutes", box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)) -> DataFrame:
    """Each vessel's latest place (vessel, ts, latitude, longitude, expired), like ``stream.latest_positions`` but without pandas frames and only when it changes."""
    low, high, west, east = box
    good = df.where(F.col("vessel").isNotNull() & F.col("ts").isNotNull() & F.col("latitude").between(low, high) & F.col("longitude").between(west, east))
    rows = good.withWatermark("ts", late).select("vessel", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "latitude", "longitude")
    out = rows.groupBy("vessel").transformWithStateInPandas(LastPosition(expire_minutes * 60_000), "vessel string, us long, latitude double, longitude double, expired boolean", "Update", "EventTime")
    return out.select("vessel", F.timestamp_micros("us").alias("ts"), "latitude", "longitude", "expired")


def sessions(df: DataFrame, key: str, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of the visits of each key. A key's state is its open visits, not its rows."""
    rows = df.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    out = rows.groupBy("key").transformWithStateInPandas(Sessions(gap_minutes * 60_000), "key string, start_ms long, end_ms long, n long", "Append", "EventTime")
    return out.select("key", F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"), "n")
