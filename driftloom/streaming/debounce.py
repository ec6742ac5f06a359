"""Debounced batches as state of a stream: open batches of each key, which event-time timers close.

What is kept of a key is its open batches alone. A batch is closed, given out and forgotten once the watermark has
passed its last event by the quiet time; events that come later than the watermark are dropped, as everywhere in a
stream. An event may join two open batches to one. State has no time to live of its own: Spark allows one only in
processing time, and a key without open batches has no state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

Batch = tuple[int, int, int, list[str]]  # first and last event in microseconds, number of events, paths

#: The store that keeps value state and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(batches: list[Batch], time: int, path: str | None, gap: int) -> list[Batch]:
    """The open batches with an event: it joins those that it is closer to than the quiet time."""
    near = [b for b in batches if b[0] - gap < time < b[1] + gap]
    others = [b for b in batches if not b[0] - gap < time < b[1] + gap]
    first, last = min([time, *(b[0] for b in near)]), max([time, *(b[1] for b in near)])
    paths = {p for b in near for p in b[3]} | ({path} if path is not None else set())
    return sorted([*others, (first, last, 1 + sum(b[2] for b in near), sorted(paths))])


class Debounce(StatefulProcessor):
    """Rows of (key, time in microseconds, path) to closed batches."""

    def __init__(self, key: str, gap: int) -> None:
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType([StructField("batches", StringType())]))

    def _held(self) -> tuple[list[Batch], int | None]:
        """The open batches, and the time that the key's timer is set to."""
        value = self.open.get()
        if not value:
            return [], None
        batches, due = json.loads(value[0])
        return [tuple(b) for b in batches], due

    def _keep(self, batches: list[Batch], due: int | None) -> None:
        """Keeps the open batches, with one timer for the first of them that closes. due: the time that the timer is set to."""
        following = min(map(self._closes, batches), default=None)
        if following != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if following is not None:
                self.handle.registerTimer(following)
        if batches:
            self.open.update((json.dumps([batches, following]),))
        else:
            self.open.clear()

    def _closes(self, batch: Batch) -> int:
        """Milliseconds of event time from which on a batch is closed."""
        return (batch[1] + self.gap + 999) // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batches, due = self._held()
        for part in rows:
            for time, path in sorted(zip(part["time"].tolist(), part["path"].tolist(), strict=True), key=lambda x: x[0]):
                batches = joined(batches, time, path, self.gap)
        self._keep(batches, due)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held, _ = self._held()
        closed = [b for b in held if self._closes(b) <= now]
        self._keep([b for b in held if self._closes(b) > now], None)
        yield pd.DataFrame({self.key: [key[0]] * len(closed), "n": [b[2] for b in closed], "first_us": [b[0] for b in closed], "last_us": [b[1] for b in closed], "paths": [json.dumps(b[3]) for b in closed]})

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, key: str, time: str, path: str | None, gap_ms: int, late: str) -> DataFrame:
    """key, n, first_us, last_us, paths of the batches of a stream, each once it is closed.

    The stream's session needs STORE as ``spark.sql.streaming.stateStore.providerClass``. late: how far events may lie
    behind the latest one. Events without a time or key are left out. Two events belong to a batch if they are closer
    than the gap. paths is a JSON list of the distinct paths; without a path column it is empty.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    name = F.lit(None).cast("string") if path is None else F.col(path)
    rows = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col(time).cast("timestamp").alias("__at"), at.alias("time"), name.alias("path"))
    kind = next(f.dataType for f in events.schema.fields if f.name == key)
    out = StructType([StructField(key, kind), *[StructField(c, LongType()) for c in ("n", "first_us", "last_us")], StructField("paths", StringType())])
    return rows.withWatermark("__at", late).groupBy(key).transformWithStateInPandas(statefulProcessor=Debounce(key, gap_ms * 1000), outputStructType=out, outputMode="Append", timeMode="EventTime")
