"""Streams with timers against replays of all events at once."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillon.streaming import state as streams
from quillon.streaming import timers

SCHEMA = "user_id long, event_id long, ts timestamp"
LATE = 600_000_000


@pytest.fixture
def timed(spark):
    timers.use_timers(spark)
    yield spark
    spark.conf.unset(timers.STORE)


def events_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    return [(r.user_id % 40, r.event_id, r.us) for r in rows]


def write(spark, folder, rows):
    at = lambda us: datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc)
    spark.createDataFrame([(u, e, at(us)) for u, e, us in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, build, folder, top, name):
    """Run the stream until its input is used up; its rows so far, and the state rows of its last batch."""
    q = build(streams.read_events(spark, folder, SCHEMA, 1)).writeStream.format("parquet").option("path", f"{top}/{name}").option("checkpointLocation", f"{top}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    return [tuple(r) for r in spark.read.parquet(f"{top}/{name}").collect()], held[-1]


def replay(rows, width, sliding):
    out, held = [], {}
    for u, e, us in sorted(rows, key=lambda r: (r[2], r[1])):
        at, n = held.get(u, (None, 0))
        if at is not None and (us > at + width if sliding else us >= at + width):
            out.append((u, None, "evicted" if sliding else "closed", n, at + width - (not sliding)))
            at, n = None, 0
        out.append((u, e, ("miss" if sliding else "opened") if at is None else ("hit" if sliding else "counted"), n + 1, us))
        held[u] = (us if sliding or at is None else at, n + 1)
    return out + [(u, None, "evicted" if sliding else "closed", n, at + width - (not sliding)) for u, (at, n) in held.items()]


@pytest.mark.parametrize("build,width,sliding", [(timers.sliding_entries, 3_600_000_000, True), (timers.anchored_windows, 1_800_000_000, False)])
def test_late_rows_restart_and_expiry(timed, sf_dir, tmp_path, build, width, sliding):
    rng, rows, folder = random.Random(5), events_of(timed, sf_dir), str(tmp_path / "in")
    # Rows come up to the allowed lateness out of order, in five files; ties in time are among them.
    rows += [(u, e + 10**9, us) for u, e, us in rows[:50]]
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(LATE))
    cut = [shuffled[i * len(rows) // 5 : (i + 1) * len(rows) // 5] for i in range(5)]
    for part in cut[:2]:
        write(timed, folder, part)
    early, held = drain(timed, build, folder, tmp_path, "out")
    assert 0 < len(early) < len(rows) and held > 0
    # The stream starts again from its checkpoint; a last event far ahead lets everything before it end.
    for part in cut[2:]:
        write(timed, folder, part)
    end = max(us for *_, us in rows) + 10**12
    write(timed, folder, [(-1, 0, end)])
    write(timed, folder, [(rows[0][0], -5, rows[0][2]), (-1, 1, end)])
    got, left = drain(timed, build, folder, tmp_path, "out")
    assert sorted(map(repr, got)) == sorted(map(repr, replay(rows, width, sliding)))
    # Only the last key is held: its events, its timer in both orders of the store, and the time of it.
    assert left < held and left <= 6


def test_timers_need_their_store(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [(1, 1, 10**15)])
    with pytest.raises(ValueError):
        timers.sliding_entries(streams.read_events(spark, str(tmp_path / "in"), SCHEMA))
