"""Files and tables: documents by folder, vector indexes, caches and guarded text files."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import read_ndjson


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; temporary only in local mode where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_documents(spark: SparkSession, *folders: str) -> DataFrame:
    """(dir_rank, path, content) of every SKILL.md below the folders, in their order."""
    out = None
    for rank, folder in enumerate(folders):
        rows = spark.read.text(folder, wholetext=True, pathGlobFilter="SKILL.md", recursiveFileLookup=True)
        rows = rows.select(F.lit(rank).alias("dir_rank"), F.input_file_name().alias("path"), F.col("value").alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_vector_index(vectors: DataFrame, path: str | None = None) -> str:
    path = path or scratch(vectors.sparkSession, "vector-index")
    vectors.write.mode("overwrite").json(path)
    return path


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, category string, embedding array<double>").json(path)


def write_versions(versions: DataFrame, path: str) -> None:
    """Append compressed versions (domain, skill, version, content, ..., created) by domain and version."""
    versions.write.mode("append").partitionBy("domain", "version").parquet(path)


def read_versions(spark: SparkSession, path: str, schema: str, since=None) -> DataFrame:
    """The last written version of each document and style that has content, or of those written at `since` or later.

    schema names the columns of the files; domain and version come from the folders, so a filter on them reads no others.
    """
    rows = spark.read.schema(f"{schema}, domain string, version string").parquet(path).filter("content is not null and content <> ''")
    rows = rows if since is None else rows.filter(F.col("created") >= since)
    columns = [c for c in rows.columns if c not in ("domain", "skill", "version")]
    last = rows.groupBy("domain", "skill", "version").agg(F.max_by(F.struct(*columns), "created").alias("row"))
    return last.select("domain", "skill", "version", "row.*")


def save_cache(rows: DataFrame, path: str) -> None:
    """Append (key, written, ...) rows to a cache folder of JSON lines."""
    rows.write.mode("append").json(path)


def load_cache(spark: SparkSession, path: str, schema: str, needed: str) -> DataFrame:
    """The last written row of each key. Lines that do not parse, or lack the needed column, are passed over."""
    rows = read_ndjson(spark, path, schema).filter(F.col("key").isNotNull() & F.col(needed).isNotNull())
    last = rows.groupBy("key").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "key")), "written").alias("row"))
    return last.select("key", "row.*")


def write_results(rows: DataFrame, path: str) -> None:
    """Rows with their nested columns as JSON lines, in place of what is there."""
    rows.write.mode("overwrite").json(path)


def guarded(folder: str, name: str) -> str:
    """The path of name below folder; absolute names and parent steps are refused."""
    if name.startswith("/") or ".." in re.split(r"[/\\]", name) or "://" in name:
        raise PermissionError(f"{name} is outside {folder}")
    return f"{folder.rstrip('/')}/{name}"


def append_lines(lines: DataFrame, folder: str, name: str) -> None:
    lines.write.mode("append").text(guarded(folder, name))


def read_lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.text(guarded(folder, name)).withColumnRenamed("value", "line")


def _listed(spark: SparkSession, path: str) -> list[str] | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else None


def exists(spark: SparkSession, folder: str, name: str) -> bool:
    return _listed(spark, guarded(folder, name)) is not None


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    return _listed(spark, folder) or []
