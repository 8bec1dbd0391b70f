"""Bitmap postings: the ids of each tag as 64-bit words, kept as a table that answers boolean questions without the documents.

A tag's ids spread over rows (tag, word, bits), one for each 64 ids that hold any, so a tag on a third of all
documents is many small rows. Every id stands under EVERY too, against which a tag is negated.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = "*"


def bitmaps(rows: DataFrame, tags: str, number: str) -> DataFrame:
    """(tag, word, bits) of rows with an array of tags and a whole number as id.

    Rows without an id are left out; null tags are none, repeated tags and rows are one. A tag named EVERY
    is an error of the caller: it would be taken for all.
    """
    own = F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(F.lit(EVERY)))
    each = rows.filter(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("id"), F.explode(own).alias("tag"))
    word, bit = F.shiftright("id", 6), F.expr("shiftleft(1L, CAST(pmod(id, 64) AS INT))")
    return each.filter("tag is not null").groupBy("tag", word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def save(index: DataFrame, path: str) -> None:
    """Write an index by ranges of (tag, word), so that a question reads only the row groups of its tags."""
    index.repartitionByRange("tag", "word").sortWithinPartitions("tag", "word").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tag string, word long, bits long").parquet(path)


def extend(index: DataFrame, more: DataFrame) -> DataFrame:
    """The index with the bits of another one, of documents that came later."""
    return index.unionByName(more).groupBy("tag", "word").agg(F.bit_or("bits").alias("bits"))


def words_where(index: DataFrame, tags: list[str], rule: Callable[..., Column]) -> DataFrame:
    """(word, bits) that answer a rule: a function of one column of bits for each tag, then that of all ids.

    The rule joins them by bitwiseAND, bitwiseOR and bitwise_not; a complement is cut to the ids that exist.
    """
    asked = [*dict.fromkeys([*tags, EVERY])]
    own = {t: F.coalesce(F.bit_or(F.when(F.col("tag") == t, F.col("bits"))), F.lit(0).cast("long")) for t in asked}
    words = index.filter(F.col("tag").isin(asked)).groupBy("word").agg(*(own[t].alias(f"b{i}") for i, t in enumerate(asked)))
    column = {t: F.col(f"b{i}") for i, t in enumerate(asked)}
    bits = rule(*(column[t] for t in tags)).bitwiseAND(column[EVERY])
    return words.select("word", bits.alias("bits")).filter("bits <> 0")


def ids_where(index: DataFrame, tags: list[str], rule: Callable[..., Column]) -> DataFrame:
    """(id) of what answers the rule."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return words_where(index, tags, rule).select("word", F.explode(places).alias("place")).select((F.col("word") * 64 + F.col("place")).alias("id"))


def count_where(index: DataFrame, tags: list[str], rule: Callable[..., Column]) -> DataFrame:
    """(n): how many ids answer the rule, by counting bits."""
    return words_where(index, tags, rule).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("n"))
