"""Exact de-duplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, kept in a folder of its
own: a later session that opens the folder goes on with it. A batch is reduced to
one row per digest (partial aggregation first, so a text that a third of all rows
share costs one row per task), joined to the index by a sort-merge anti-join in
which the index side needs no shuffle, and what is new is appended.

Null text counts as empty; empty texts are equal to each other. Ties in length go to
the smallest doc_id, a null one first. Every row counts: of rows that repeat a doc_id
and its text one stays. group_size counts the rows of the batch that brought the digest
into the index; no row of a later batch stays. A batch that is run again under its name
finds its own digests and decides as before.
"""
from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, keyed, shared_dir, staged, without

#: Fewest buckets, and digests that one is made for: a bucket is what one task reads and sorts.
BUCKETS, BUCKET_ROWS = 32, 2_000_000


def digests(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """A row key, doc_id, length of the original text and digest of the text without white space."""
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(row.alias("row"), "doc_id", F.length(text).alias("n"), F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"))


class DigestIndex:
    """Table (text_sha256, keep_id, group_size, batch), one row per digest seen so far, in a folder.

    The folder's name holds the number of buckets, so that opening it needs no catalogue. The number follows from
    the rows: when they outgrow it, the table is written again in at least twice as many buckets, and takes its
    place by one renaming; of two such folders the one with more buckets is whole and counts.
    Without a path the index lives in the shared folder until it is closed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.lasting, self.bucket_rows = spark, path is not None, bucket_rows
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        held = self.held()
        self.buckets, self.table = max(held, default=buckets), None
        if self.buckets:
            self.table = self.opened(self.place(f"buckets-{self.buckets}"), self.buckets)

    def held(self) -> list[int]:
        """Numbers of buckets of the tables in the folder."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []
        return [int(n.removeprefix("buckets-")) for n in names if n.startswith("buckets-")]

    def place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def opened(self, place, buckets: int) -> str:
        name, at = f"digest_index_{uuid.uuid4().hex}", place.toString().replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} (text_sha256 STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{at}'")
        return name

    def make_room(self, more: int) -> None:
        """Buckets for the digests held and `more` of them."""
        rows = more + (self.read().count() if self.table else 0)
        if self.table and rows <= self.buckets * self.bucket_rows:
            return
        wanted = max(BUCKETS, 1 << math.ceil(math.log2(max(1, rows / self.bucket_rows)))) if not self.table else 2 * self.buckets
        while wanted * self.bucket_rows < rows:
            wanted *= 2
        if self.table is None:
            self.buckets, self.table = wanted, self.opened(self.place(f"buckets-{wanted}"), wanted)
            return
        made = self.place(f"making-{uuid.uuid4().hex}")
        new = self.opened(made, wanted)
        self.put(self.read(), new, wanted)
        self.spark.sql(f"DROP TABLE {new}")
        old, self.buckets = (self.table, self.place(f"buckets-{self.buckets}")), wanted
        if not self.fs.rename(made, self.place(f"buckets-{wanted}")):
            raise OSError(f"{made.toString()} could not take its place")
        self.table = self.opened(self.place(f"buckets-{wanted}"), wanted)
        self.spark.sql(f"DROP TABLE {old[0]}")
        self.fs.delete(old[1], True)

    @staticmethod
    def put(rows: DataFrame, table: str, buckets: int) -> None:
        rows.repartition(buckets, "text_sha256").write.bucketBy(buckets, "text_sha256").sortBy("text_sha256").mode("append").saveAsTable(table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, best: DataFrame, batch: str) -> None:
        """Add the digests that the index does not hold yet."""
        self.make_room(best.count())
        new = best.select("text_sha256", "keep_id", "group_size", F.lit(batch).alias("batch")).join(self.read().hint("merge"), "text_sha256", "left_anti")
        self.put(new, self.table, self.buckets)

    def resolve(self, found: DataFrame, best: DataFrame, batch: str) -> DataFrame:
        """Every row with the row that stays for its text.

        The index is first cut down to the digests at hand. Joining that table leaves both
        sides to a shuffle, so Spark can split a digest that many rows share.
        """
        mine = best.select("text_sha256", "keep_row")
        known = mine.join(self.read().hint("merge"), "text_sha256").select("text_sha256", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row"))
        out = found.join(staged(known, "known"), "text_sha256")
        return out.select("row", "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "text_sha256")

    def close(self) -> None:
        """Forget the session's table; the files stay where a path was given."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if not self.lasting:
            self.fs.delete(self.path, True)


def resolved(found: DataFrame, index: DigestIndex | None, batch: str | None) -> DataFrame:
    """Append the staged digests to the index (one of its own by default) and resolve every row."""
    used, batch = index or DigestIndex(found.sparkSession), batch or uuid.uuid4().hex
    first = F.min(F.struct((-F.col("n")).alias("n"), "doc_id", "row"))
    best = found.groupBy("text_sha256").agg(first["doc_id"].alias("keep_id"), F.count("*").alias("group_size"), first["row"].alias("keep_row"))
    best = staged(best, "best")
    used.append(best, batch)
    out = used.resolve(found, best, batch)
    if index is None:
        used.close()  # the rows are resolved through a staged table
    return out


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    return resolved(staged(digests(docs), "digests"), index, batch).drop("row")


def kept_rows(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    source = keyed(docs)
    found = staged(digests(source, F.col("_row")), "digests")
    return without(source, resolved(found, index, batch).filter("not kept").select(F.col("row").alias("_row")))
