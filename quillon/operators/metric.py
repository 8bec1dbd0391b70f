"""Exact search by a metric index: pivots, rings of distance round them, and triangle inequalities that skip rings.

Pivots are chosen far apart from a bounded sample. Every row belongs to its nearest pivot and
to a ring of distances from it; rows of a ring are packed into blocks of bounded size, and the
blocks are a table. A query knows from the sample how far its k-th neighbour can be at most.
A ring is skipped when its distances differ from the query's own distance to the pivot by more
than that, and a pivot when the query lies that much nearer to another one. Queries stand once
each, in blocks of neighbours with the rings that they visit; blocks of rows meet those that visit
their ring, and the queries that do not are left out there. What is left is compared exactly, so
no row is missed, and the result is that of comparing everything. Nothing grows with the rings
that a query visits but the comparing. Cosine is searched as the distance of unit vectors.
"""
from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged
from .search import BLOCK_BYTES, BROADCAST_BYTES, best, bound_batches, solve, solved

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Most rows of the sample that pivots and bounds come from, most pivots, and rings over the sample's largest distance.
SAMPLE, PIVOTS, RINGS = 4096, 64, 24
#: What rounding to six digits can hide.
SLACK = 1e-6


@dataclass
class Index:
    blocks: DataFrame  # pivot, ring, n, ids, rows
    pivots: np.ndarray
    sample: tuple[np.ndarray, np.ndarray]  # ids and vectors
    far: np.ndarray  # the largest distance from each pivot
    step: float
    metric: str


def points(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as points of the metric space; a zero vector stays one."""
    if metric != "cosine":
        return v
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - b) ** 2).sum(1) for x in a])) if len(a) else np.zeros((0, len(b)))


def far_apart(p: np.ndarray, most: int) -> np.ndarray:
    """Points of p chosen one after the other, each the farthest from those before."""
    chosen, near = [0], np.full(len(p), np.inf)
    while len(chosen) < min(most, len(p)):
        near = np.minimum(near, distances(p[chosen[-1:]], p)[0])
        if near.max() == 0:
            break
        chosen.append(int(near.argmax()))
    return p[chosen]


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def of_width(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).filter(F.size("v") == width)


def lists(values, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def packed(rows: DataFrame, width: int, names: tuple[str, str], block_bytes: int) -> DataFrame:
    """Blocks of the rows (pivot, ring, id, v) of each ring, dealt by range, so that a full ring is spread."""
    most = max(1, block_bytes // (8 * width))

    def run(batches):
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "ring")], 1)
            if not len(keys):
                continue
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            cut = [at for i, j in zip(cut, cut[1:]) for at in range(i, j, most)] + [len(keys)]
            sizes = np.diff(cut)
            found = [pa.array(keys[cut[:-1], i], pa.int32()) for i in (0, 1)] + [pa.array(sizes, pa.int64()), lists(b.column("id"), sizes), lists(b.column("v").flatten(), sizes * width)]
            yield pa.RecordBatch.from_arrays(found, ["pivot", "ring", "n", *names])

    tasks = rows.sparkSession.sparkContext.defaultParallelism * 2
    dealt = rows.repartitionByRange(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "pivot", "ring", "id").sortWithinPartitions("pivot", "ring", "id")
    return dealt.mapInArrow(run, f"pivot int, ring int, n long, {names[0]} array<long>, {names[1]} array<double>")


def build(vectors: DataFrame, width: int, metric: str = "euclidean", block_bytes: int = BLOCK_BYTES // 16) -> Index | None:
    """The index of all vectors of the width; None without any."""
    vectors.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    bound_batches(vectors.sparkSession)
    rows = of_width(vectors, width)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not some:
        return None
    sample = np.array([r["id"] for r in some]), np.array([r["v"] for r in some], "f8")
    p = points(sample[1], metric)
    pivots = far_apart(p, PIVOTS)
    step = float(distances(pivots, p).min(0).max()) / RINGS or 1.0

    def assign(batches):
        for b in batches:
            d = distances(points(matrix(b, width), metric), pivots)
            at = d.argmin(1) if len(d) else np.zeros(0, "i8")
            low = d[np.arange(len(d)), at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array((low / step).astype("i4")), pa.array(low), b.column("id"), b.column("v")], ["pivot", "ring", "d", "id", "v"])

    rows = staged(rows.mapInArrow(assign, "pivot int, ring int, d double, id long, v array<double>"), "assigned")
    far = np.full(len(pivots), -1.0)
    for r in rows.groupBy("pivot").agg(F.max("d").alias("d")).collect():  # one row for each pivot
        far[r["pivot"]] = r["d"]
    return Index(staged(packed(rows.drop("d"), width, ("ids", "rows"), block_bytes), "rings"), pivots, sample, far, step, metric)


def visits(index: Index, queries: DataFrame, width: int, k: int | None, radius: float | None, block_bytes: int = BLOCK_BYTES // 8) -> DataFrame:
    """Blocks of queries near one another: (query_ids, query, near, most), with each query's distance to its nearest pivot and how far
    away what it looks for can be; low and high are the first and last ring of each pivot that any query of the block visits."""
    ids, sample = index.sample
    pivots, far, step, metric = index.pivots, index.far, index.step, index.metric
    size = max(1, block_bytes // (8 * width))

    def reach(v: np.ndarray) -> np.ndarray:
        """How far away what a query looks for can be."""
        if radius is not None:
            return np.full(len(v), radius + SLACK)
        if k > len(ids):
            return np.full(len(v), np.inf)
        i, _, value = solve(v, sample, ids, k, metric, None)
        last = value.reshape(len(v), k)[:, -1]
        return np.sqrt(np.maximum(0, 2 - 2 * (last - SLACK))) + SLACK if metric == "cosine" else last + SLACK

    def assign(batches):
        for b in batches:
            d = distances(points(matrix(b, width), metric), pivots)
            at = d.argmin(1) if len(d) else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("id"), b.column("v")], ["pivot", "id", "v"])

    def blocks(batches):
        for b in batches:
            for begin in range(0, b.num_rows, size):
                part = b.slice(begin, size)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                d, most = distances(points(v, metric), pivots), reach(v)
                low, high, seen = rings(d, d.min(1)[:, None], most[:, None], far, step)
                low, high = np.where(seen, low, 1 << 30).min(0), np.where(seen, high, -1).max(0)
                found = [part.column("id"), part.column("v").flatten(), pa.array(d.min(1)), pa.array(most), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
                yield pa.RecordBatch.from_arrays([lists(x, [len(x)]) for x in found], ["query_ids", "query", "near", "most", "low", "high"])

    rows = of_width(queries, width).mapInArrow(assign, "pivot int, id long, v array<double>")
    dealt = rows.repartitionByRange("pivot", "id").sortWithinPartitions("pivot", "id").select("id", "v")
    asked = dealt.mapInArrow(blocks, "query_ids array<long>, query array<double>, near array<double>, most array<double>, low array<int>, high array<int>")
    return staged(asked, "visits")


def rings(d: np.ndarray, near: np.ndarray, most: np.ndarray, far: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last ring that a query visits, and whether it visits any, by its distances from pivots and from its nearest one."""
    low = np.minimum(np.maximum(0, d - most) / step, 1 << 29).astype("i8")
    high = (np.minimum(d + most, far + SLACK) / step).astype("i8")
    return low, high, ~((far < 0) | (d - near > 2 * most) | (d - most > far + SLACK))


def meetings(index: Index, asked: DataFrame, width: int):
    """Pairs of a block of rows and one of queries of which any visits its ring; and what reads of such a pair the queries that do, with the rows."""
    pivots, far, step, metric = index.pivots, index.far, index.step, index.metric
    small = asked.agg(F.sum(F.size("query"))).first()[0] or 0
    other = F.broadcast(asked) if 8 * small <= BROADCAST_BYTES else asked
    at = lambda c: F.get(c, F.col("pivot"))
    pairs = index.blocks.drop("n").join(other, (at("low") <= F.col("ring")) & (F.col("ring") <= at("high"))).drop("low", "high")

    def read(batches):
        for b in batches:
            for pivot, ring, *lists_ in zip(*(b.column(c) for c in ("pivot", "ring", "query_ids", "query", "near", "most", "ids", "rows"))):
                at, query, near, most, of, rows = (x.values.to_numpy() for x in lists_)
                query = query.reshape(-1, width)
                p = pivot.as_py()
                low, high, seen = rings(distances(points(query, metric), pivots[p : p + 1])[:, 0], near, most, far[p], step)
                seen &= (low <= ring.as_py()) & (ring.as_py() <= high)
                if seen.any():
                    yield at[seen], query[seen], of, rows.reshape(-1, width)

    return pairs, read


def width_of(queries: DataFrame) -> int:
    return queries.select(F.max(F.size("v"))).first()[0] or 0


def compared(index: Index, asked: DataFrame, width: int, k: int | None, radius: float | None) -> DataFrame:
    metric = index.metric
    pairs, read = meetings(index, asked, width)

    def run(batches):
        def found():
            for at, query, of, rows in read(batches):
                for i, j, value in solved(query, rows, of, k, metric, radius):
                    yield at[i], of[j], value

        yield from best(found(), k, metric)

    return pairs.mapInArrow(run, "query_id long, id long, value double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, value, rank): the k nearest rows of each query, as search.top_k gives them."""
    schema = "query_id long, id long, value double, rank int"
    width = width_of(queries)
    index = build(vectors, width, metric) if width > 0 else None
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    found = compared(index, visits(index, queries, width, max(k, 1), None), width, max(k, 1), None)
    order = F.col("value").desc() if metric == "cosine" else F.col("value")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).filter(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(query_id, id, value): all rows within the radius, as search.within gives them."""
    width = width_of(queries)
    index = build(vectors, width) if width > 0 else None
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, value double")
    return compared(index, visits(index, queries, width, None, radius), width, None, radius)


def share(index: Index, asked: DataFrame, rows: int, queries: int) -> float:
    """Distances that are computed, of all pairs of a query and a row."""
    pairs, read = meetings(index, asked, index.pivots.shape[1])

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(at) * len(of) for at, _, of, _ in read(batches))], pa.int64())], ["n"])

    return (pairs.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) / max(1, rows * queries)
