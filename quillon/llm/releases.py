"""Quarantine and cascading release: deliveries of a conversation's turns, replayed by timing wheels.

A turn waits for its parent, an earlier turn of its conversation. Faulty turns fail until
they are repaired, and are tried again after growing pauses; four failures are final, and
what waits for a turn that is never delivered is blocked. The replay of a conversation is
a hierarchical timing wheel of hashed slots that hold arrivals and retries; a firing slot
wakes the turns parked under what it delivers.

No conversation has to fit into one task. Places in it come from ranges. A conversation is
cut wherever no later turn waits for an earlier one, which happens about every 160 turns,
whatever their number, and each piece is a wheel of its own; and places and sums in order
of delivery come from ranges again.

A null conv_id is a conversation of its own and a null turn comes first; both are written
as nothing where hashes are taken. Null text counts as empty. Rows that repeat a turn are
turns one after the other, in the order of their text's check sum; equal rows can stand for
each other. `state` beyond 64 bits goes on modulo 2^64. Empty tables give no rows, other
columns are never read, and texts enter only as check sums, however long they are.
"""
from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, partitions, staged

#: Seconds between arrivals, most failures, first pause after one, places that a parent can lie back.
ARRIVAL, FAILURES, PAUSE, REACH = 7, 4, 20, 6
#: Turns of a block in which cuts are looked for; the result does not depend on it.
BLOCK = 4096
#: Bits of a time that one level of a wheel tells apart.
BITS = 6
SLOTS = (1 << BITS) - 1


def drawn(k: int) -> Column:
    """The k-th number of a turn: check sum of `k:conv_id:turn`."""
    return F.crc32(F.concat_ws(":", F.lit(str(k)), F.col("conv"), F.coalesce(F.col("turn").cast("string"), F.lit(""))))


def turns(conversations: DataFrame) -> DataFrame:
    """What a replay needs of every turn: distance of the parent, seconds to repair (null: sound), attempts that fail by lot, check sum of the text."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    rows = conversations.select("conv_id", conv, "turn", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    lots = sum((F.when(drawn(a + 2) % 3 == 0, 1 << a).otherwise(0) for a in range(1, FAILURES + 1)), F.lit(0))
    faulty = drawn(1) % 101 < 20
    return rows.select("*", (drawn(0) % 7).alias("back"), F.when(faulty, drawn(2) % 101).alias("repair"), F.when(faulty, lots).otherwise(0).alias("lots"))


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows of all conversations, staged, with the number of the range of (conv, order) they were dealt to: however large a conversation, it is spread."""
    return staged(rows.repartitionByRange(partitions(rows.sparkSession), "conv", *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(sums: DataFrame, *columns: str) -> DataFrame:
    """Sums of a conversation's ranges before each: a conversation has at most as many ranges as there are tasks."""
    before = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv", "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in columns))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `p`, the place of each turn in its conversation from 0."""
    ranges = ranged(rows, "turn", "crc")
    before = running(ranges.groupBy("conv", "_part").agg(F.count("*").alias("n")), "n")
    within = F.row_number().over(Window.partitionBy("conv", "_part").orderBy("turn", "crc"))
    return ranges.join(before, ["conv", "_part"]).select(*rows.columns, (F.col("n") + within - 1).alias("p"))


def carried(lasts: DataFrame, size: int) -> DataFrame:
    """(conv, block, last): the last cut before each block that follows a full one, by doubling over blocks without any."""
    known, step = staged(lasts.select("conv", "block", "last", (F.col("n") == size).alias("full")), "cuts"), 1
    while not known.filter("last is null").isEmpty():
        far = known.select("conv", (F.col("block") + step).alias("block"), F.col("last").alias("far"))
        known, step = staged(known.join(far, ["conv", "block"], "left").select("conv", "block", F.coalesce("last", "far").alias("last"), "full"), "cuts"), 2 * step
    return known.filter("full").select("conv", (F.col("block") + 1).alias("block"), F.col("last").alias("carried"))


def pieces(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """rows with `piece`, the place from which no turn of its conversation waits for an earlier one.

    Blocks of a conversation are searched with the turns that follow each, as far as a parent can lie back.
    """
    block = F.floor(F.col("p") / size)
    parent = F.when((F.col("back") > 0) & (F.col("back") <= F.col("p")), F.col("p") - F.col("back"))
    both = F.array(block, F.when((F.col("p") % size < REACH - 1) & (block > 0), block - 1))
    spread = rows.withColumn("low", F.coalesce(parent, "p")).withColumn("block", F.explode(F.array_compact(both)))
    by_place = Window.partitionBy("conv", "block").orderBy("p")
    cut = F.when(F.min("low").over(by_place.rowsBetween(0, REACH - 1)) >= F.col("p"), F.col("p"))
    found = spread.withColumn("cut", cut).filter(F.col("block") == block)
    found = staged(found.withColumn("last", F.max("cut").over(by_place)), "pieces")
    lasts = found.groupBy("conv", "block").agg(F.max("last").alias("last"), F.count("*").alias("n"))
    return found.join(carried(lasts, size), ["conv", "block"], "left").select(*rows.columns, F.coalesce("last", "carried").alias("piece"))


class Wheel:
    """Hierarchical timing wheel: a time's slot is its digit at the highest level at which it differs from now."""

    def __init__(self, now: int):
        self.now, self.levels = now, []

    def put(self, at: int, what: int) -> None:
        level = max((at ^ self.now).bit_length() - 1, 0) // BITS
        while len(self.levels) <= level:
            self.levels.append({})
        self.levels[level].setdefault(at >> BITS * level & SLOTS, []).append((at, what))

    def fire(self) -> list[int] | None:
        """Go to the next second at which something is due, and what that is; None when nothing waits."""
        while True:
            for level, slots in enumerate(self.levels):
                if slots:
                    break
            else:
                return None
            due = slots.pop(digit := min(slots))
            if not level:
                self.now = self.now & ~SLOTS | digit
                return [what for _, what in due]
            self.now = (self.now >> BITS * (level + 1) << BITS | digit) << BITS * level
            for at, what in due:  # the slot's contents go to finer levels
                self.put(at, what)


def replay(start: int, back: list, repair: list, lots: list) -> list[tuple]:
    """(status, attempts, first_at, last_at) of a piece's turns, of which the first stands at place `start`."""
    n = len(back)
    wheel, status, tries, first, last, parked = Wheel(ARRIVAL * start), [None] * n, [0] * n, [None] * n, [None] * n, {}
    for i in range(n):
        wheel.put(ARRIVAL * (start + i), i)

    def lost(i: int, why: str) -> None:
        status[i], waiting = why, [i]
        while waiting:
            for child in parked.pop(waiting.pop(), ()):
                status[child] = "blocked"
                waiting.append(child)

    while (due := wheel.fire()) is not None:
        now = wheel.now
        heapq.heapify(due)
        while due:
            i = heapq.heappop(due)
            if not tries[i] and 0 < back[i] <= start + i and status[parent := i - back[i]] != "delivered":
                if status[parent] is None:
                    parked.setdefault(parent, []).append(i)
                else:
                    lost(i, "blocked")
                continue
            tries[i] += 1
            last[i] = now
            if first[i] is None:
                first[i] = now
            if repair[i] is not None and (now < ARRIVAL * (start + i) + repair[i] or lots[i] >> tries[i] & 1):
                if tries[i] == FAILURES:
                    lost(i, "dead")
                else:
                    wheel.put(now + PAUSE * 2 ** (tries[i] - 1), i)
            else:
                status[i] = "delivered"
                for child in parked.pop(i, ()):
                    heapq.heappush(due, child)
    return list(zip(status, tries, first, last))


def replayed(batches):
    """Outcomes of pieces that come whole and in order, one after the other."""
    kept = ["conv_id", "turn", "conv", "p", "crc"]
    held: list = []

    def outcome(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        columns = [t.column(c).to_pylist() for c in ("back", "repair", "lots")]
        found = list(zip(*replay(t.column("p")[0].as_py(), *columns)))
        made = [pa.array(x, k) for x, k in zip(found, (pa.string(), pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in kept), *made], [*kept, "status", "attempts", "first_at", "last_at"])

    for b in batches:
        keys = list(zip(b.column("conv").to_pylist(), b.column("piece").to_pylist()))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for at, to in zip(starts, starts[1:]):
            if held and held[0][0] != keys[at]:
                yield outcome([p for _, p in held])
                held = []
            held.append((keys[at], b.slice(at, to - at)))
    if held:
        yield outcome([p for _, p in held])


def delivered_in_order(rows: DataFrame) -> DataFrame:
    """Delivered turns with release_no and state, from 1 in each conversation by time and turn."""
    ranges = ranged(rows, "last_at", "p")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    within = Window.partitionBy("conv", "_part").orderBy("last_at", "p")
    own = ranges.withColumn("no", F.row_number().over(within)).withColumn("weight", big("no") * big("crc")).withColumn("sum", F.sum(big("crc")).over(within))
    own = staged(own.withColumn("weights", F.sum("weight").over(within)).drop("weight"), "releases")
    counts = own.groupBy("conv", "_part").agg(F.count("*").alias("n"), F.max("sum").alias("s"), F.max("weights").alias("w"))
    placed = counts.drop("n").join(running(counts, "n"), ["conv", "_part"])
    before = placed.select("conv", "_part", "n", (big("n") * big("s") + F.col("w")).alias("so_far"))
    before = before.select("conv", "_part", F.col("n").alias("earlier")).join(running(before, "so_far"), ["conv", "_part"])
    # A number of a range counts on from those before, so each check sum weighs that much more.
    state = F.col("so_far") + big("earlier") * F.col("sum") + F.col("weights")
    bound = F.lit(str(1 << 63)).cast("decimal(20,0)")
    state = (F.pmod(state + bound, bound * 2) - bound).cast("long")
    return own.join(before, ["conv", "_part"]).select(*rows.columns, (F.col("earlier") + F.col("no")).cast("long").alias("release_no"), state.alias("state"))


def releases(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no and state of every turn."""
    parts = pieces(numbered(turns(conversations)), block)
    order = ["conv", "piece", "p"]
    dealt = parts.repartition("conv", "piece").sortWithinPartitions(*order)
    schema = "conv_id long, turn long, conv string, p long, crc long, status string, attempts int, first_at long, last_at long"
    found = staged(map_arrow(dealt, replayed, schema), "replayed")
    open_ = found.filter("status <> 'delivered'").select("*", F.lit(None).cast("long").alias("release_no"), F.lit(None).cast("long").alias("state"))
    out = delivered_in_order(found.filter("status = 'delivered'")).unionByName(open_)
    return out.select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")
