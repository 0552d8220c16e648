"""Denial-success pairs of each actor in time order, on list state and timers in RocksDB: events that wait are appended as rows, and read once when the watermark passes them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import LATE, PAIRS, timed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pairs(StatefulProcessor):
    """waiting: events that the watermark had not passed when they came, times in microseconds; last: the last event that it has passed.

    One timer stands at the first waiting event of a batch or of what is left; another where the last event can pair no more. An actor without either holds nothing.
    """

    def __init__(self, seconds: float):
        self.most = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, action string")
        self.last = handle.getValueState("last", "action string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            times = [t.value // 1000 for t in batch["created_at"]]
            # what is later than the watermark was passed already
            some = [x for x in zip(times, batch["event_id"].tolist(), batch["action"].tolist(), strict=True) if x[0] // 1000 >= now]
            if some:
                self.waiting.appendList(some)
                self.handle.registerTimer(min(some)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        through = timerValues.getCurrentWatermarkInMs() * 1000
        action, when = self.last.get() if self.last.exists() else ("", 0)
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []  # one actor's within the watermark's delay, and a batch
        n = sum(at < through for at, *_ in held)
        out = []
        for at, _, what in held[:n]:
            if what == "query" and action == "query.denied" and at - when <= self.most:
                out.append((key[0], pd.Timestamp(at, unit="us"), (at - when) / 1e6))
            action, when = what, at
        if n:
            self.last.update((action, when))
            self.handle.registerTimer(max(when + self.most, through) // 1000 + 2)
            if n < len(held):
                self.waiting.put(held[n:])
                self.handle.registerTimer(held[n][0] // 1000 + 1)
            else:
                self.waiting.clear()
        elif self.last.exists() and when + self.most < through:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["actor_sub", "created_at", "seconds"])

    def close(self) -> None:
        pass


def boundary_stream(events: DataFrame, seconds: int, late: str = LATE) -> DataFrame:
    """The pairs of jobs.boundary_stream(); what comes later than the watermark is dropped. The session's state store is set to RocksDB, which these states need."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    asked = events.where(F.col("action").isin("query", "query.denied")).select("actor_sub", "action", "created_at", F.col("event_id").cast("long").alias("event_id"))
    return timed(asked, "created_at", late).groupBy("actor_sub").transformWithStateInPandas(Pairs(float(seconds)), PAIRS, "append", "EventTime")
