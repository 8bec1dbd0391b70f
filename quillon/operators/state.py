"""Keyed state machines over event logs, as batch replays. Times are microseconds."""
from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
MINUTE = 60_000_000
DAY = 24 * 60 * MINUTE
TTL, HOT_TTL, WINDOW, FRESH = 60 * MINUTE, 30 * MINUTE, 30 * MINUTE, 7 * 24 * 60 * MINUTE


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def with_gap(events: DataFrame, *keys: str) -> DataFrame:
    """events with `day` and `gap`, the time since the key's event before; null for its first.

    Events are handled by key and day, so a busy key is spread over its days; a day's first event follows the
    last one of the key's day before, which a table of one row for each key and day tells.
    """
    days = events.withColumn("day", F.floor(F.col("us") / DAY))
    last = days.groupBy(*keys, "day").agg(F.max("us").alias("last"))
    last = last.withColumn("last", F.lag("last").over(Window.partitionBy(*keys).orderBy("day")))
    last = last.withColumnsRenamed({k: f"_{k}" for k in (*keys, "day")})
    rows = days.join(last, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "day")], "left").select(*days.columns, "last")
    before = F.lag("us").over(Window.partitionBy(*keys, "day").orderBy("us", "event_id"))
    return rows.withColumn("gap", F.col("us") - F.coalesce(before, "last")).drop("last")


def ttl_replay(events: DataFrame, ttl: Column, *keys: str) -> DataFrame:
    """Each access with its outcome: hit up to the ttl after the access before (which renews it), expired beyond, else miss."""
    gap = F.col("gap")
    rows = with_gap(events, *keys).withColumn("outcome", F.when(gap.isNull(), "miss").when(gap <= ttl, "hit").otherwise("expired"))
    return rows.drop("gap", "day")


def next_starts(events: DataFrame, key: str, width: int) -> DataFrame:
    """(key, event_id, us, next): the key's first event at least `width` after each; null where there is none.

    Time is cut into buckets of the width, so what is looked for stands in the next bucket, at or after the same
    offset, or is the first event of a later one. A bucket's events and those that look into it are one small
    sorted group; a busy key is spread over its buckets.
    """
    own = events.select(key, "event_id", "us", F.floor(F.col("us") / width).alias("bucket"))
    event = F.struct("us", "event_id")
    looking = own.select(key, "event_id", F.col("us") + width, (F.col("bucket") + 1).alias("bucket"), F.lit(1).alias("looks"), F.lit(None).cast("struct<us:bigint,event_id:bigint>").alias("found"))
    both = own.select(key, "event_id", "us", "bucket", F.lit(0).alias("looks"), event.alias("found")).union(looking)
    # From the latest to the earliest; of one time, who looks comes after all that are there.
    order = Window.partitionBy(key, "bucket").orderBy(F.col("us").desc(), "looks", F.col("event_id").desc())
    at_or_after = both.withColumn("found", F.last("found", ignorenulls=True).over(order)).filter("looks = 1")
    firsts = both.groupBy(key, "bucket").agg(F.min(F.when(F.col("looks") == 0, F.col("found"))).alias("first"))
    later = F.first("first", ignorenulls=True).over(Window.partitionBy(key).orderBy("bucket").rowsBetween(1, Window.unboundedFollowing))
    later = firsts.select(F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), later.alias("later"))
    met = at_or_after[key].eqNullSafe(later["_key"]) & (at_or_after["bucket"] == later["_bucket"])
    return at_or_after.join(later, met).select(key, "event_id", (F.col("us") - width).alias("us"), F.coalesce("found", "later").alias("next"))


def window_starts(events: DataFrame, key: str, width: int) -> DataFrame:
    """(event_id): the events that start a window: a key's first one, and from each start the first one at least `width` later.

    What follows a gap of the width starts one in any case. From those, starts are reached by doubling: each round
    squares the step, so a chain of n windows takes log n rounds over tables, whoever holds it.
    """
    gaps = with_gap(events.select(key, "event_id", "us"), key)
    sure = gaps.filter(F.col("gap").isNull() | (F.col("gap") >= width)).select("event_id")
    hop = next_starts(events, key, width).filter("next is not null").select("event_id", F.col("next")["event_id"].alias("next"))
    # Chains end where a sure start begins another one.
    hop = staged(hop.join(sure.select(F.col("event_id").alias("next")), "next", "left_anti"), "hops")
    reached = staged(sure, "starts")
    while True:
        new = staged(reached.join(hop, "event_id").select(F.col("next").alias("event_id")), "starts")
        if new.isEmpty():
            return reached
        reached = staged(reached.union(new), "starts")
        hop = staged(hop.join(hop.select(F.col("event_id").alias("next"), F.col("next").alias("after")), "next").select("event_id", F.col("after").alias("next")), "hops")


def anchored_windows(events: DataFrame, key: str, width: int) -> DataFrame:
    """(key, event_id, window, in_window, first): each event's anchored window among the key's, its place in it and the window's first event.

    Counts go on from bucket to bucket of a key through a table with one row for each bucket.
    """
    starts = window_starts(events, key, width).select("event_id", F.lit(1).alias("start"))
    rows = events.select(key, "event_id", "us", F.floor(F.col("us") / width).alias("bucket")).join(starts, "event_id", "left")
    rows = staged(rows.withColumn("start", F.coalesce("start", F.lit(0))), "windows")
    inside = Window.partitionBy(key, "bucket").orderBy("us", "event_id")
    rows = rows.select("*", F.row_number().over(inside).alias("n"), F.sum("start").over(inside).alias("starts"))
    rows = rows.withColumn("last", F.last(F.when(F.col("start") == 1, F.struct("n", "event_id")), ignorenulls=True).over(inside))
    rows = staged(rows, "windows")
    ends = rows.groupBy(key, "bucket").agg(F.max("n").alias("n"), F.max("starts").alias("starts"), F.max("last").alias("last"))
    so_far = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col(key).alias("_key"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n_before"), F.coalesce(F.sum("starts").over(so_far), F.lit(0)).alias("starts_before"),
        "last",
    )
    placed = F.when(F.col("last").isNotNull(), F.struct((F.col("n_before") + F.col("last")["n"]).alias("n"), F.col("last")["event_id"].alias("event_id")))
    carried = carried.withColumn("open", F.last(placed, ignorenulls=True).over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    rows = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("bucket") == F.col("_bucket")))
    number = F.col("n_before") + F.col("n")
    begun = F.when(F.col("last").isNotNull(), F.struct((F.col("n_before") + F.col("last")["n"]).alias("n"), F.col("last")["event_id"].alias("event_id"))).otherwise(F.col("open"))
    rows = rows.select(key, "event_id", (F.col("starts_before") + F.col("starts") - 1).alias("window"), number.alias("number"), begun.alias("begun"))
    return rows.select(key, "event_id", "window", (F.col("number") - F.col("begun")["n"] + 1).alias("in_window"), F.col("begun")["event_id"].alias("first"))


def access_windows(events: DataFrame, key: str = "user_id", width: int = WINDOW) -> DataFrame:
    """Events with the number of their anchored window among the key's and the count so far."""
    return anchored_windows(events, key, width).select(key, "event_id", "window", "in_window")


def in_flight(requests: DataFrame, key: str, busy: int) -> DataFrame:
    """(event_id, served_by): a request starts the work of its key, which takes `busy`; those that come before it ends share its result."""
    return anchored_windows(requests, key, busy).select("event_id", F.col("first").alias("served_by"))


def recent(events: DataFrame, most: int, *keys: str) -> DataFrame:
    """The last `most` events of each key, with their place from the newest, 1."""
    newest = Window.partitionBy(*keys).orderBy(F.col("us").desc(), F.col("event_id").desc())
    return events.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)


def expiry(age: Column, idle: Column, accesses: Column, most: int = FRESH) -> Column:
    """What a clean-up does: keep while young, defer where it is in use, else delete."""
    return F.when(age <= most, "keep").when((accesses > 2) & (idle < WINDOW), "defer").otherwise("delete")


def last_writes(writes: DataFrame, key: str, size: int = 50, batch: int = 10, flush: int = 5_000_000) -> DataFrame:
    """(key, slot, flush, value, batch): the last write of each key in each flush, in batches by key.

    Writes collect in a buffer that holds one entry for each key. It is flushed when the interval ends, and
    within it as soon as `size` keys are waiting. A slot is one interval of events, handled in order of time.
    """
    writes.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    rows = writes.select(key, "event_id", "us", "value", F.floor(F.col("us") / flush).alias("slot"))

    def solve(batches):
        # Slots come whole and in order; only the open buffer is carried from batch to batch.
        now, number, held = None, 0, set()
        for g in batches:
            found = []
            for k, slot in zip(g[key].tolist(), g["slot"].tolist()):
                if slot != now:
                    now, number, held = slot, 0, set()
                elif len(held) >= size:
                    number, held = number + 1, set()
                held.add(k)
                found.append(number)
            yield g.assign(flush=found)[[key, "event_id", "us", "value", "slot", "flush"]]

    runs = rows.repartition("slot").sortWithinPartitions("slot", "us", "event_id").mapInPandas(solve, f"{key} long, event_id long, us long, value double, slot long, flush long")
    last = runs.groupBy(key, "slot", "flush").agg(F.max_by("value", F.struct("us", "event_id")).alias("value"))
    place = F.row_number().over(Window.partitionBy("slot", "flush").orderBy(key)) - 1
    return last.select(key, "slot", "flush", "value", F.floor(place / batch).cast("long").alias("batch"))


def evict_victim(entries: DataFrame, group: str) -> DataFrame:
    """The entry to evict of each group: not hot first, then fewest accesses, then oldest."""
    order = F.struct("hot", "accesses", "us", "name")
    return entries.groupBy(group).agg(F.min(order).alias("v")).select(group, "v.name")


def tiered(names: DataFrame, *tiers: tuple[str, DataFrame]) -> DataFrame:
    """(name, content, tier): content from the first tier that has it."""
    out = names.select("name")
    for label, rows in tiers:
        out = out.join(rows.select("name", F.col("content").alias(f"_{label}")), "name", "left")
    tier = F.coalesce(*(F.when(F.col(f"_{t}").isNotNull(), t) for t, _ in tiers))
    return out.select("name", F.coalesce(*(F.col(f"_{t}") for t, _ in tiers)).alias("content"), tier.alias("tier"))
