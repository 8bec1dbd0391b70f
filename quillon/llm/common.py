"""Helpers that every operator of this subpackage uses."""
from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Tables at or below this many bytes may be broadcast; beyond it the callers join by shuffle.
BROADCAST_BYTES = 8 << 20
#: Before the name of a column that a row key pushes aside.
ASIDE = "_given"
#: Bytes that a row key takes in a broadcast table.
ROW_BYTES = 64
#: Rows that an operator's function gets at once, and rows and bytes that Spark hands a worker at once.
SLICE_ROWS, BATCH_ROWS, BATCH_BYTES = 1024, 2048, 4 << 20
#: White space of the text contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a copy that outlives any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_scan(df: DataFrame) -> bool:
    """Whether df is columns and filters over one table, so that each of its rows stands at a place of its own."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a key of the row that every scan gives alike: its place in the Parquet files.

    What is not a plain scan of Parquet is staged first. A column of that name waits under another one until `without`.
    """
    docs = docs.withColumnsRenamed({c: ASIDE + c for c in docs.columns if c.lower() == "_row"})
    for source in (docs, None):
        try:
            source = source if source is not None else staged(docs, "keyed")
            if source is docs and not is_scan(docs):
                continue
            place = source.metadataColumn("_metadata")
            return source.withColumn("_row", F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at")))
        except AnalysisException:
            if source is not docs:
                raise


def without(source: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of source whose `_row` is not among the dropped ones, which are broadcast below a checked size."""
    dropped = staged(dropped.select("_row"), "dropped")
    small = dropped.count() * ROW_BYTES <= BROADCAST_BYTES
    return restored(source.join(F.broadcast(dropped) if small else dropped, "_row", "left_anti"))


def restored(rows: DataFrame) -> DataFrame:
    """rows without the key, with the given column of its name back in place."""
    left = rows.drop("_row")
    return left.withColumnsRenamed({c: c.removeprefix(ASIDE) for c in left.columns if c.startswith(ASIDE)})


_KEPT: dict[object, object] = {}


def worker_cache(key, make):
    """make()'s value, kept in the Python worker until another key is asked for: one operator's cache at a time."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop the worker's cache and hand free memory back: workers live on from stage to stage."""
    if _KEPT:
        _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def map_arrow(df: DataFrame, func, schema: str, cached: bool = False) -> DataFrame:
    """mapInArrow whose Python workers can import this package; without `cached`, a worker's cache goes first.

    Spark's batches are bounded in bytes where the session does not bound them: both sides hold a batch whole, and
    documents of megabytes would otherwise come by the thousand. Batches are handed on in slices, so that what a
    worker makes of one is small, and freed memory goes back.
    """
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    bound_batches(df.sparkSession)

    def sliced(batches):
        pool = pa.default_memory_pool()
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                yield b.slice(at, SLICE_ROWS)
            pool.release_unused()

    def run(batches):
        if not cached:
            release()
        yield from func(sliced(batches))

    return df.mapInArrow(run, schema)


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (and the row key, where there is one), null text as the empty string; other columns are never read."""
    return docs.select(*(["_row"] if "_row" in docs.columns else []), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
