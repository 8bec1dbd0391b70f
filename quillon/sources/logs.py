"""Line-oriented sources: logs, run streams, lists and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines folder; lines that do not parse are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("_bad", F.col("_corrupt_record").isNotNull()).filter("not _bad").drop("_bad", "_corrupt_record")


def tail(lines: DataFrame, order: str, pattern: str, n: int = 100) -> DataFrame:
    """The last n lines that match."""
    return lines.filter(F.col("line").rlike(pattern)).orderBy(F.col(order).desc()).limit(n)


def at_least(entries: DataFrame, level: str, levels: tuple[str, ...]) -> DataFrame:
    """Entries of the level or a graver one."""
    return entries.filter(F.col("level").isin(*levels[levels.index(level) :]))


def write_log(entries: DataFrame, path: str, level: str, levels: tuple[str, ...]) -> None:
    """Append entries of the level or a graver one as JSON lines."""
    at_least(entries, level, levels).write.mode("append").json(path)


def batch_tokens(batches: DataFrame) -> DataFrame:
    """Batches (id, n, total) with the tokens that each of n texts is told to have: the whole part of an even share."""
    return batches.withColumn("tokens", F.when(F.col("n") > 0, F.floor(F.col("total") / F.col("n"))).otherwise(0).cast("long"))


def folded(events: DataFrame, key: str, order: str, kind: Column, text: Column, tokens: Column, error: Column) -> DataFrame:
    """One row for each run: its text in order, its tokens and its errors."""
    e = events.select(key, F.struct(F.col(order).alias("o"), F.when(kind != "error", text).alias("t"), F.when(kind == "error", error).alias("e")).alias("s"), F.when(kind == "purchase", tokens).alias("n"))
    joined = lambda f, sep: F.nullif(F.array_join(F.filter(F.transform(F.col("s"), lambda x: x[f]), lambda x: x.isNotNull()), sep), F.lit(""))
    return e.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens")).select(key, joined("t", " ").alias("text"), "tokens", joined("e", "; ").alias("errors"))


def exercises(lines: DataFrame) -> DataFrame:
    """Exercises of JSON texts (value) that have a name and a task."""
    parsed = lines.select(F.from_json("value", "name string, task string, tier string").alias("x")).select("x.*")
    return parsed.filter("name is not null and task is not null").orderBy("name")


def stub_list(lines: DataFrame, below: int = 3000) -> DataFrame:
    """Paths and sizes of lines `path (N bytes)` below the size."""
    size = F.try_to_number(F.replace(F.regexp_extract("line", r"\(([\d,]+) bytes\)", 1), F.lit(","), F.lit("")), F.lit("999999999999")).cast("long")
    return lines.select("doc_id", F.regexp_extract("line", r"(skills/\S+)", 1).alias("path"), size.alias("bytes")).filter(F.col("bytes") < below)


def report_links(lines: DataFrame) -> DataFrame:
    """Links of a report with the section each stands in; sections fill forward over the lines."""
    heading = F.nullif(F.regexp_extract("line", "^## (.*)$", 1), F.lit(""))
    section = F.last(heading, ignorenulls=True).over(Window.partitionBy("report").orderBy("line_no"))
    link = r"`([^`]+)` -> `([^`]+)`"
    rows = lines.withColumn("section", section).filter(F.col("line").startswith("- "))
    return rows.select("report", "section", F.regexp_extract("line", link, 1).alias("src"), F.regexp_extract("line", link, 2).alias("dst"))
