"""Streams of (user_id, event_id, ts) events with keyed state and event-time watermarks."""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files; times without zone are taken as UTC."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_ttl(events: DataFrame, ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, outcome): miss, hit or expired against the key's access before; a gap equal to the ttl is a hit.

    One number stays for every key ever seen: without it an expired key could not be told from a new one.
    """
    events.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    ttl = ttl_seconds * 1_000_000

    def step(key, frames: Iterator[pd.DataFrame], state):
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        last = state.get[0] if state.exists else None
        out = []
        for us in rows["us"].tolist():
            out.append("miss" if last is None else "hit" if us - last <= ttl else "expired")
            last = us if last is None else max(last, us)
        state.update((last,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "outcome": out})

    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, outcome string", "last long", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, width_seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, in_window): count in the anchored window, which restarts at the width.

    A key's state goes when its window has ended for the watermark: the next event starts a new one anyway.
    """
    events.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    width = width_seconds * 1_000_000

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        start, count = state.get if state.exists else (None, 0)
        out = []
        for us in rows["us"].tolist():
            start, count = (us, 1) if start is None or us - start >= width else (start, count + 1)
            out.append(count)
        state.update((start, count))
        state.setTimeoutTimestamp(max((start + width) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "in_window": out})

    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, in_window long", "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def first_requests(events: DataFrame, key: str, late: str = "1 minute") -> DataFrame:
    """One request of each key within the watermark: later ones in flight share its result."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def write_behind(events: DataFrame, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", now: bool = False):
    """Hand the last row of each key of a micro-batch to the sink; with `now`, drain what is there and stop."""

    def flush(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("row"))
        sink(last.select(key, "row.*"), number)

    writer = events.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer.trigger(processingTime=every)).start()
