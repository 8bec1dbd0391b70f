"""Exact vector search of a stated query set against all rows, in blocks.

Both sides are packed into blocks of bounded size where they stand, without a shuffle, and each pair of
blocks is solved by one matrix product that returns only its best rows. The query set is whole and every
row is compared, so the work is queries times rows; queries are broadcast below a checked size, else
their blocks are written to a table that every task reads.
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of vectors in one block, and of all query vectors that are broadcast.
BLOCK_BYTES, BROADCAST_BYTES = 4 << 20, 8 << 20
#: Values of a pair of blocks that are worked out at once, and rows found that a task holds before only the best stay.
CELLS, PENDING = 1 << 19, 1 << 19


def bound_batches(spark) -> None:
    """A Python worker gets a pair of blocks at once, not thousands, where the session does not say otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str((1 << 63) - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))


def packed(vectors: DataFrame, width: int, names: tuple[str, str]) -> DataFrame:
    """Blocks of (id, v) rows of the width: ids and all their values in one row."""
    most = max(1, BLOCK_BYTES // (8 * width))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                ids, flat = part.column("id"), part.column("v").flatten()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, flat)], list(names))

    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).filter(F.size("v") == width)
    return rows.mapInArrow(run, f"{names[0]} array<long>, {names[1]} array<double>")


def scored(vectors: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", radius: float | None = None) -> DataFrame:
    """(query_id, id, value): the best k of each block of rows, or all within the radius.

    vectors and queries have (id, v); null vectors and those of another width than the widest query have no
    values. Values are rounded to six digits, and ties go to the smaller id.
    """
    vectors.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    bound_batches(vectors.sparkSession)
    width, n = queries.select(F.max(F.size("v")), F.count("*")).first()
    schema = "query_id long, id long, value double"
    if not width or width < 0:
        return vectors.sparkSession.createDataFrame([], schema)
    asked = packed(queries, width, ("query_ids", "query"))
    asked = F.broadcast(asked) if 8 * width * n <= BROADCAST_BYTES else staged(asked, "query-blocks")

    def run(batches):
        def found():
            for b in batches:
                for query_ids, query, ids, rows in zip(*(b.column(c) for c in ("query_ids", "query", "ids", "rows"))):
                    at, of = query_ids.values.to_numpy(), ids.values.to_numpy()
                    for i, j, value in solved(query.values.to_numpy().reshape(-1, width), rows.values.to_numpy().reshape(-1, width), of, k, metric, radius):
                        yield at[i], of[j], value

        yield from best(found(), k, metric)

    return packed(vectors, width, ("ids", "rows")).crossJoin(asked).mapInArrow(run, schema)


def solve(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int | None, metric: str, radius: float | None):
    """Query and row numbers of a pair of blocks, and their values."""
    parts = list(solved(q, v, ids, k, metric, radius))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))


def solved(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int | None, metric: str, radius: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """solve in slices of queries, so that memory follows CELLS and not the size of the blocks."""
    most = max(1, CELLS // max(1, len(v)))
    long = np.linalg.norm(v, axis=1)[None, :] if metric == "cosine" else None
    for begin in range(0, len(q), most):
        part = q[begin : begin + most]
        if metric == "cosine":
            length = long * np.linalg.norm(part, axis=1)[:, None]
            value = np.round(np.divide(part @ v.T, length, out=np.zeros((len(part), len(v))), where=length > 0), 6)
        else:
            value = np.stack([np.round(np.sqrt(((x - v) ** 2).sum(1)), 6) for x in part])
        if radius is not None:
            i, j = np.nonzero(value <= radius)
        else:
            cost = -value if metric == "cosine" else value
            # What is not behind the k-th value, ties with it included; only that is put in order.
            i, j = np.nonzero(~(cost > np.partition(cost, k - 1, axis=1)[:, k - 1 : k])) if 0 < k < len(v) else np.nonzero(np.ones(cost.shape, bool))
            order = np.lexsort((ids[j], cost[i, j], i))
            i, j = i[order], j[order]
            first = ranks(i) < k
            i, j = i[first], j[first]
        yield i + begin, j, value[i, j]


def ranks(keys: np.ndarray) -> np.ndarray:
    """The place of each row among those of its key; equal keys stand together."""
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return np.arange(len(keys)) - np.repeat(begin, np.diff(np.r_[begin, len(keys)]))


def best(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int | None, metric: str) -> Iterator[pa.RecordBatch]:
    """Batches of (query_id, id, value) of what a task finds: everything without k, else mostly the best k of each query."""
    held, n = [], 0

    def batches(query, of, value):
        for at in range(0, len(query), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (query, of, value)], ["query_id", "id", "value"])

    def merged():
        query, of, value = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((of, -value if metric == "cosine" else value, query))
        order = order[ranks(query[order]) < k]
        return query[order], of[order], value[order]

    for part in found:
        if k is None:
            yield from batches(*part)
            continue
        held.append(part)
        n += len(part[0])
        if n > PENDING:
            held = [merged()]
            n = len(held[0][0])
            if n > PENDING // 2:
                yield from batches(*held[0])
                held, n = [], 0
    if held:
        yield from batches(*merged())


def top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, value, rank): the k nearest rows of each query; none for k below 1."""
    best = F.col("value").desc() if metric == "cosine" else F.col("value")
    w = Window.partitionBy("query_id").orderBy(best, "id")
    return scored(vectors, queries, max(k, 1), metric).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(query_id, id, value): all rows within the radius; none for a negative one."""
    return scored(vectors, queries, None, "euclidean", radius)
