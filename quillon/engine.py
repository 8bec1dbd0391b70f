"""Session object: route requests, list and read documents, read metrics."""
from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown
from .functions.hashing import lcg_vector
from .operators import corpus, routing, safety, search
from .plans import planner
from .sources import snapshots, tables


#: Tasks that a session remembers.
TASK_LOG = 100


class Engine:
    """A corpus of documents with embeddings, and the operations on it.

    embed and compress are providers; the defaults are deterministic and local
    (a hash-seeded vector; truncation to a budget) and stand in for remote models.
    """

    def __init__(self, spark: SparkSession, skills: DataFrame, embed: Callable[[Column], Column] | None = None, size: int = 64):
        self.spark, self.skills = spark, skills
        self.embed = embed or (lambda text: lcg_vector(text, size))
        self.tools = planner.Tools()
        self.folders: tuple[str, ...] = ()
        self.snapshot, self.loaded = None, {}
        self.tasks: deque[dict] = deque(maxlen=TASK_LOG)

    @classmethod
    def from_folders(cls, spark: SparkSession, *folders: str, snapshot: str | None = None) -> Engine:
        """Documents of the folders, the first of each name in their order; with a snapshot, only new and changed files are read."""
        engine = cls(spark, spark.createDataFrame([], "name string"))
        engine.folders = folders
        engine.snapshot = snapshots.open_snapshot(spark, snapshot) if snapshot else None
        return engine.reload()

    def reload(self) -> Engine:
        """Read the folders again; with a snapshot, `loaded` tells how many files were read and why."""
        if not self.folders:
            raise ValueError("this corpus does not come from folders")
        if self.snapshot is None:
            raw = tables.scan_documents(self.spark, *self.folders)
        else:
            self.loaded = snapshots.refresh(self.snapshot, *self.folders)
            raw = snapshots.documents(self.snapshot, *self.folders)
        self.skills = corpus.load(raw)[0]
        return self

    def execute(self, task_id, steps: list[dict], mode: str = "sequential", context: dict | None = None, retries: int = planner.RETRIES) -> dict:
        """Run the steps of a task with the registered tools; the last tasks are kept in `tasks`."""
        began = time.monotonic()
        results = planner.run_steps(self.tools, steps, mode=mode, context=context, retries=retries)
        ok = all(r["status"] == "success" for r in results)
        done = {"task_id": task_id, "status": "success" if ok else "partial_failure", "results": results, "ms": int(1000 * (time.monotonic() - began))}
        self.tasks.append({k: done[k] for k in ("task_id", "status", "ms")} | {"steps": len(results)})
        return done

    def stats(self) -> dict:
        """Documents, categories and tags of the corpus, and the tools."""
        one = self.skills.agg(F.count("*"), F.countDistinct("category")).first()
        tags = self.skills.select(F.explode("tags")).distinct().count() if "tags" in self.skills.columns else 0
        return {"skills": one[0], "categories": one[1], "tags": tags, "tools": self.tools.stats()}

    def metrics(self) -> dict:
        """Tasks run so far among the last ones, failures, and their mean time."""
        n = len(self.tasks)
        return {"tasks": n, "failed": sum(t["status"] != "success" for t in self.tasks), "mean_ms": sum(t["ms"] for t in self.tasks) / n if n else 0.0}

    def health(self) -> dict:
        """Whether the corpus can be read and holds documents."""
        try:
            return {"status": "ok" if not self.skills.isEmpty() else "empty"}
        except Exception as e:  # an unreadable corpus is what this reports
            return {"status": "failed", "error": str(e).splitlines()[0]}

    def list(self) -> DataFrame:
        return self.skills.select("name", "category", "description")

    def get(self, name: str, level: int = 0) -> DataFrame:
        return self.skills.filter(F.col("name") == name).select("name", markdown.compressed(F.col("content"), level).alias("content"))

    def route(self, requests: DataFrame, most: int = 5, candidates: int = 20) -> dict[str, DataFrame]:
        """Selection, steps and confidence of requests (task_id, task); unsafe ones are left out.

        Scores are cosines rescaled to [0, 1], the stand-in for a model's ranking.
        """
        safe = requests.filter(safety.injection_scan(F.col("task"))["is_safe"] & (F.trim("task") != "") & (F.length("task") <= safety.LONGEST_TASK))
        names = self.skills.withColumn("id", F.xxhash64("name"))
        corpus_vectors = names.select("id", self.embed(F.concat_ws(" ", "name", "description")).alias("v"))
        hits = search.top_k(corpus_vectors, safe.select(F.col("task_id").alias("id"), self.embed(F.col("task")).alias("v")), candidates)
        scored = hits.join(names.select("id", "name", "category"), "id").select(F.col("query_id").alias("task_id"), "name", "category", ((F.col("value") + 1) / 2).alias("score"))
        drafts = self.skills.filter("draft") if "draft" in self.skills.columns else self.skills.limit(0)
        chosen = routing.selected(routing.capped(scored).drop("rank"), drafts, most).withColumn("role", routing.role_of(F.col("rank")))
        return {
            "selection": chosen,
            "steps": planner.steps(chosen),
            "strategy": planner.strategy(chosen, safe),
            "confidence": chosen.groupBy("task_id").agg(routing.confidence(F.col("score"), F.col("rank")).alias("confidence")),
        }

    def register_functions(self) -> None:
        """Scalar functions for SQL: cosine similarity and a budgeted summary."""
        self.spark.udf.register("text_summary", F.pandas_udf(_summaries, "string"))
        self.spark.udf.register("cosine_similarity", F.pandas_udf(_cosines, "double"))


def _summaries(text: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t[: max(0, int(n)) * 4] for t, n in zip(text, tokens)])


def _cosines(a: pd.Series, b: pd.Series) -> pd.Series:
    import numpy as np

    def one(x, y):
        n = float(np.linalg.norm(x) * np.linalg.norm(y)) if len(x) == len(y) else 0.0
        return float(np.dot(x, y)) / n if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def compressed_versions(docs: DataFrame) -> DataFrame:
    """(name, version, content, tokens, ratio): three styles by budget, the local stand-in for a model's summaries."""
    # Token budgets of the styles.
    styles = (("brief", 400), ("moderate", 800), ("detailed", 1500))
    cut = F.inline(F.array(*(F.struct(F.lit(s).alias("version"), F.substring("content", 1, 4 * n).alias("text")) for s, n in styles)))
    rows = docs.select("name", F.length("content").alias("n"), cut)
    return rows.select("name", "version", F.col("text").alias("content"), markdown.token_estimate_llm(F.col("text")).alias("tokens"), F.round(F.length("text") / F.greatest("n", F.lit(1)), 6).alias("ratio"))


__all__ = ["Engine", "compressed_versions"]
