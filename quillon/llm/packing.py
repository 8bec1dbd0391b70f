"""Best-fit packing of documents into token sequences of a fixed capacity.

Lengths are integers from 1 to the capacity, so a histogram of at most `capacity`
counts decides the whole packing. On it, pieces longer than a third of the capacity
are matched greedily, largest with the largest partner that still fits, at most two
to a sequence; shorter ones follow in falling order, each into the fullest sequence
that has room. Runs of equal sequences are handled as one entry. Each piece then
finds its place from its rank among the pieces of its length. Ranks are counted
within salted groups, so a length that a third of all pieces share is spread over
many tasks.

A null or empty text is one piece holding only the closing id. Repeated rows are
packed once each, and rows that repeat a doc_id are spread like others. Pieces of one
length can stand for each other; ties go by doc_id, piece and row. A text of any length
is cut into as many pieces as it needs. Other columns are never read, whatever their names.
"""
from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import loaded, vocabulary
from .common import doc_texts, map_arrow, partitions, staged

CAPACITY = 4096
END_ID = 1
#: Words of up to so many bytes are encoded by scanning; packing needs no more than their ids.
SCAN_WORDS = 48
#: Bytes of each generation of a worker's cache of encoded words: packing has to encode the whole corpus at the least cost.
CACHE_BYTES = 48 << 20


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of at most capacity tokens of each document and its closing id."""
    spec = vocabulary(docs.sparkSession, path)
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        bpe = loaded(spec.value, SCAN_WORDS, CACHE_BYTES)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = bpe.encode(text.as_py()) + end
                rows += [(doc, k, at // 4, len(p := ids[at : at + 4 * capacity]) // 4, zlib.crc32(p)) for k, at in enumerate(range(0, len(ids), 4 * capacity))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(doc_texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long", cached=True)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, copies in each sequence, offset) and the number of sequences."""
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def place(n: int, first: int, count: int, copies: int, offset: int) -> None:
        rows.append((n, used[n], first, copies, offset))
        used[n] += count * copies
        left[n] -= count * copies

    def room(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            # The largest partner that fits; a partner as long as n needs two of them.
            k = bisect_left(large, min(n, capacity - n) + 1) - 1
            while k >= 0 and left[large[k]] < 1 + (large[k] == n):
                k -= 1
            if k < 0:
                count = left[n]
                place(n, bins, count, 1, 0)
                room(capacity - n, bins, count)
            else:
                m = large[k]
                count = left[n] // 2 if m == n else min(left[n], left[m])
                if m == n:
                    place(n, bins, count, 2, 0)
                else:
                    place(n, bins, count, 1, 0)
                    place(m, bins, count, 1, n)
                room(capacity - n - m, bins, count)
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(order, n)
            if k == len(order):
                copies = min(capacity // n, left[n])
                count = left[n] // copies
                place(n, bins, count, copies, 0)
                room(capacity - copies * n, bins, count)
                bins += count
                continue
            gap = order[k]
            first, free = gaps[gap].pop()
            copies = min(gap // n, left[n])
            count = min(free, left[n] // copies)
            if free > count:
                gaps[gap].append((first + count, free - count))
            if not gaps[gap]:
                del gaps[gap], order[k]
            place(n, first, count, copies, capacity - gap)
            room(gap - copies * n, first, count)
    return np.array(sorted(rows), "i8").reshape(-1, 5), bins


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces with sequence_id and offset; see the module for the method."""
    spark = docs.sparkSession
    pieces = staged(cut_pieces(docs, capacity, path).withColumn("seed", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan, _ = packing_plan(histogram, capacity)
    # Salts keep every (length, salt) group to about half of an even share of a task.
    total, most = max(1, sum(histogram.values())), max([1, *histogram.values()])
    salts = max(1, math.ceil(2 * most * partitions(spark) / total))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("seed"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "seed")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    key = (plan[:, 0] << 44) | plan[:, 1]  # sorted by length, then first rank

    def run(batches):
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("length", "rank"))
            row = plan[np.searchsorted(key, (n << 44) | rank, "right") - 1] if len(plan) else np.zeros((0, 5), "i8")
            ahead = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 2] + ahead // np.maximum(row[:, 3], 1)), pa.array(row[:, 4] + ahead % np.maximum(row[:, 3], 1) * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
