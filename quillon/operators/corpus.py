"""Documents with front matter: parsing, defaults, checks, first-wins loading and reports."""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as M

# What marks a document as a stub.
STUB_PHRASE = "Implementing this specific pattern or feature"
STOCK_PHRASES = ("Identify the specific use case", "Apply the pattern or technique", "Validate and test the implementation", "Iterate based on results")
STUB_CHARS = 3000
METADATA_KEYS = ("version", "domain", "role", "scope", "output-format", "triggers")
SIZE_STEPS = (1000, 2000, 3000, 5000, 10000)


def with_metadata(docs: DataFrame) -> DataFrame:
    """Name, category, description, tags and version from front matter, with defaults from the path.

    docs has (path, content) and may have dir_rank, the place of its folder among several; the directory is the
    last but one part of the path.
    """
    f = F.col("f")
    folder = F.element_at(F.split("path", "/"), -2)
    name = F.coalesce(f["name"], folder)
    category = F.coalesce(f["domain"], F.when(name.contains("-"), F.substring_index(name, "-", 1)), F.lit("general"))
    triggers = F.coalesce(M.split_list(f["triggers"]), F.array().cast("array<string>"))
    tags = F.array_distinct(F.array_compact(F.concat(F.array(category), triggers, F.array(f["role"], f["scope"]))))
    return docs.withColumn("f", M.lenient_fields(M.frontmatter(F.col("content")))).select(
        *(c for c in ("dir_rank",) if c in docs.columns), "path", name.alias("name"), category.alias("category"),
        F.coalesce(f["description"], F.concat(F.lit("Skill: "), name)).alias("description"),
        tags.alias("tags"), F.coalesce(f["version"], F.lit("1.0.0")).alias("version"), f["role"].alias("role"), triggers.alias("triggers"),
        F.coalesce(M.split_list(f["related-skills"]), F.array().cast("array<string>")).alias("related"), "content",
    )


def is_valid() -> Column:
    return F.col("name").isNotNull() & F.col("category").isNotNull() & F.col("description").isNotNull() & (F.coalesce(F.size("tags"), F.lit(0)) > 0)


def first_by_name(docs: DataFrame, *order) -> DataFrame:
    """The earliest row of each name."""
    return docs.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy(*order))).filter("_k = 1").drop("_k")


def load(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid documents, first wins by name in the order of folders, then paths, and the rejected ones."""
    rows = with_metadata(docs)
    order = [c for c in ("dir_rank", "path") if c in rows.columns]
    return first_by_name(rows.filter(is_valid()), *order), rows.filter(~is_valid())


def yaml_fields(front: Column) -> Column:
    """Front matter as JSON text by a YAML parser; null where it does not parse to a mapping."""

    def run(texts: pd.Series) -> pd.Series:
        import yaml

        def one(text):
            try:
                found = yaml.safe_load(text or "")
                return json.dumps(found, default=str, sort_keys=True) if isinstance(found, dict) else None
            except yaml.YAMLError:
                return None

        return texts.map(one)

    return F.pandas_udf(run, "string")(front)


def merged_index(existing: DataFrame, new: DataFrame, *order) -> DataFrame:
    """Existing rows and the new ones whose names are unseen; of new ones with the same name the first in order."""
    unseen = new.join(existing.select("name"), "name", "left_anti")
    return existing.unionByName(first_by_name(unseen, *order or sorted(new.columns)).select(*existing.columns))


def resolved_content(candidates: DataFrame) -> DataFrame:
    """(name, content): of candidates (name, priority, content), the readable one with the lowest priority number."""
    return candidates.filter("content is not null").groupBy("name").agg(F.min_by("content", "priority").alias("content"))


def is_stub(content: Column) -> Column:
    return (content == "") | ((F.length(content) < STUB_CHARS) & content.contains(STUB_PHRASE))


def gate_reasons(content: Column, role: Column) -> Column:
    """Reasons for which a document does not pass."""
    fences = F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"^\s*```")))
    stock = sum((F.lower(content).contains(p.lower()).cast("int") for p in STOCK_PHRASES), F.lit(0))
    reasons = F.array(
        F.when(content.contains(STUB_PHRASE), "sentinel"),
        F.when(F.octet_length(content) < STUB_CHARS, "small"),
        F.when((role == "implementation") & (fences < 4), "few code blocks"),
        F.when(stock >= 2, "stock phrases"),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


def validation(content: Column) -> tuple[Column, Column]:
    """Errors and warnings of a document."""
    front = M.frontmatter(content)
    has = lambda key, pad="": front.rlike(rf"(?m)^{pad}{key}:")
    missing = lambda ok, text: F.when(~ok, F.lit(text))
    errors = F.when(~content.startswith("---"), F.array(F.lit("no front matter"))).when(front == "", F.array(F.lit("invalid front matter"))).otherwise(
        F.filter(F.array(*(missing(has(k), f"missing {k}") for k in ("name", "description", "metadata"))), lambda x: x.isNotNull())
    )
    triggers = F.size(F.split(F.regexp_extract(front, r"(?m)^\s+triggers:\s*(.*)$", 1), ","))
    warnings = F.array(
        *(missing(has(k, r"\s+"), f"missing metadata {k}") for k in METADATA_KEYS),
        F.when(has("triggers", r"\s+") & ((triggers < 3) | (triggers > 8)), "trigger count"),
        *(missing(content.contains(f"## {s}"), f"missing section {s}") for s in ("When to Use", "Core Workflow")),
        F.when(F.length(content) < STUB_CHARS, "short"),
    )
    return errors, F.filter(warnings, lambda x: x.isNotNull())


def size_bucket(size: Column) -> Column:
    """Number of the half-open size range."""
    return sum(((size >= s).cast("int") for s in SIZE_STEPS), F.lit(0))
