"""Streams that replay each key's events in event time, with timers and state that ends.

Events wait in a list until the watermark passes them, so rows that come in another order, within the allowed
lateness, give what a batch over all of them gives; later ones are dropped. A key holds its waiting events, one
small value and one timer, and nothing once its value has ended.
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Keep the state of this session's streams in the store that timers need."""
    spark.conf.set(STORE, ROCKS)


class InOrder(StatefulProcessor):
    """A key's value is a pair (us, n). Subclasses say how an event changes it and when it ends; times are microseconds."""

    #: Outcome of the row that tells of an ended value.
    ended = "ended"

    def __init__(self, width: int):
        self.width = width

    def step(self, value: tuple | None, us: int) -> tuple[tuple, str]:
        """The new value and the outcome of an event; value is None where there is none or the last has ended."""
        raise NotImplementedError

    def last_moment(self, value: tuple) -> int:
        """The last time at which an event still finds the value."""
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long")
        self.value = handle.getValueState("value", "us long, n long")
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, us: int) -> None:
        """One timer for each key, at the earliest time asked for."""
        ms = -(-us // 1000)
        if self.timer.exists():
            now = self.timer.get()[0]
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(us, event) for part in rows for us, event in zip(part["us"].tolist(), part["event_id"].tolist()) if us > mark]
        if new:
            self.waiting.appendList(new)
            self.wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        ready, rest = [], []
        for us, event in self.waiting.get() if self.waiting.exists() else ():
            (ready if us <= mark else rest).append((us, event))
        value, out = (tuple(self.value.get()) if self.value.exists() else None), []

        def end():
            out.append((key[0], None, self.ended, value[1], self.last_moment(value)))

        for us, event in sorted(ready):
            if value is not None and self.last_moment(value) < us:
                end()
                value = None
            value, outcome = self.step(value, us)
            out.append((key[0], event, outcome, value[1], us))
        if value is not None and self.last_moment(value) <= mark:
            end()
            value = None
        if value is None:
            self.value.clear()
        else:
            self.value.update(value)
            self.wake(self.last_moment(value))
        if rest:
            self.waiting.put(rest)
            self.wake(min(rest)[0])
        else:
            self.waiting.clear()
        if out:
            columns = dict(zip(("user_id", "event_id", "outcome", "n", "us"), zip(*out)))
            yield pd.DataFrame({**columns, "event_id": pd.array(columns["event_id"], "Int64")})

    def close(self) -> None:
        pass


class SlidingEntries(InOrder):
    """An entry ends when it is not read for longer than the width: value (last read, reads)."""

    ended = "evicted"

    def step(self, value, us):
        return (us, 1 if value is None else value[1] + 1), "miss" if value is None else "hit"

    def last_moment(self, value):
        return value[0] + self.width


class AnchoredWindows(InOrder):
    """A window starts with the first event at least a width after the last start: value (start, events)."""

    ended = "closed"

    def step(self, value, us):
        return ((us, 1), "opened") if value is None else ((value[0], value[1] + 1), "counted")

    def last_moment(self, value):
        return value[0] + self.width - 1


def _run(events: DataFrame, processor: InOrder, late: str) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(STORE, None) != ROCKS:
        raise ValueError("call use_timers(spark) before a stream with timers is built")
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    rows = events.filter("user_id is not null and ts is not null").withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(processor, "user_id long, event_id long, outcome string, n long, us long", "append", "eventTime")


def sliding_entries(events: DataFrame, ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, outcome, n, us): miss, or hit with the reads so far; a gap equal to the ttl is a hit.

    A row without event_id tells that an entry was evicted, after how many reads and at which time: the next
    read is a miss, as in a cache that removes what has expired. Events without key or time are passed over;
    those of one time go by event_id, nulls of it are not allowed; repeated rows are events of their own.
    """
    return _run(events, SlidingEntries(ttl_seconds * 1_000_000), late)


def anchored_windows(events: DataFrame, width_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, outcome, n, us): the event's number in its window (opened: 1), and a closed row with each window's total."""
    return _run(events, AnchoredWindows(width_seconds * 1_000_000), late)
