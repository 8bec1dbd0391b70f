"""Corpus pipeline: toxicity, exact duplicates, near duplicates, personal data, packing.

Each stage takes what the one before it kept, written as Parquet and read again. All
but the last return the columns of documents; the last returns a row for each packed
piece. Every stage decides row by row, whatever a row's doc_id: a null or repeated
doc_id takes no other row with it. Rows with a null text pass as empty texts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact, near, packing, pii, toxicity
from quillon.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose score marks them as toxic."""
    return toxicity.clean_rows(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the longest row, then the smallest doc_id, then one of those."""
    return exact.kept_rows(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keep the row with the smallest doc_id."""
    return near.kept_rows(docs.select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    return pii.redacted(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all texts into token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]
#: The stages' models, signatures and packing are beyond SQL: tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
