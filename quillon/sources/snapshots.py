"""Document folders loaded again by reading only the files that are new or changed.

A store of versions keeps each file's size, time of change, digest and content; its manifests make a load one step
for readers. Listing reads no contents.
"""
from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import staged
from .versions import VersionStore

#: Files that one job reads; their paths are what the driver holds.
FILES_AT_ONCE = 10_000


def open_snapshot(spark: SparkSession, path: str) -> VersionStore:
    schema = "folder string, path string, created long, length long, modified long, digest string, content string"
    return VersionStore(spark, path, schema, ("folder", "path"))


def _files(spark: SparkSession, folder: str, *paths: str, pattern: str = "*") -> DataFrame:
    """(folder, path, length, modified, content) of files; contents are read only where they are used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    files = reader.load([re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths] or folder)
    return files.select(F.lit(folder).alias("folder"), "path", "length", F.unix_micros("modificationTime").alias("modified"), "content")


def refresh(store: VersionStore, *folders: str, pattern: str = "SKILL.md") -> dict[str, int]:
    """Bring a snapshot up to date with its folders; numbers of files listed, read, added, changed, same and removed.

    A file is read if its path is new or its size or time of change differs; `same` are those read whose content
    turned out equal. A change that keeps both is not seen. Other folders of the snapshot stay as they are.
    """
    spark, at = store.spark, store.state()[0] + 1
    old = store.read().filter(F.col("folder").isin(*folders)).select("folder", "path", "length", "modified", F.col("digest").alias("was"))
    listed = None
    for folder in dict.fromkeys(folders):
        rows = _files(spark, folder, pattern=pattern).drop("content")
        listed = rows if listed is None else listed.union(rows)
    listed = staged(listed, "listed")
    stale = staged(listed.join(old, ["folder", "path", "length", "modified"], "left_anti").select("folder", "path"), "stale")
    gone = staged(old.join(listed, ["folder", "path"], "left_anti").select("folder", "path"), "gone")
    old = staged(old.join(stale, ["folder", "path"]).select("folder", "path", "was"), "before")
    found = {"listed": listed.count(), "read": 0, "added": 0, "changed": 0, "same": 0, "removed": gone.count()}
    for folder in dict.fromkeys(folders):
        paths = (r[0] for r in stale.filter(F.col("folder") == folder).select("path").toLocalIterator())
        while chunk := list(islice(paths, FILES_AT_ONCE)):
            rows = _files(spark, folder, *chunk).withColumn("digest", F.sha2("content", 256)).withColumn("created", F.lit(at).cast("long"))
            rows = staged(rows.withColumn("content", F.col("content").cast("string")), "read")
            store.write(rows)
            kinds = rows.join(old, ["folder", "path"], "left").agg(
                F.count("*").alias("read"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("was") != F.col("digest")).alias("changed"),
                F.count_if(F.col("was") == F.col("digest")).alias("same"),
            )
            for kind, n in kinds.first().asDict().items():
                found[kind] += n
    if found["removed"]:
        store.remove(gone, at)
    return found


def documents(store: VersionStore, *folders: str) -> DataFrame:
    """(dir_rank, path, content) of a snapshot's files, by the order of folders given now."""
    rank = F.coalesce(*(F.when(F.col("folder") == f, i) for i, f in enumerate(folders)))
    return store.read().select(rank.alias("dir_rank"), "path", "content").filter("dir_rank is not null")
