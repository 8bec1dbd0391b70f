"""From scored candidates to a selection: requests are rows, and ranks stand for list positions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, DEFAULT_SKILLS, LEAST_SCORE = 10, 5, 0.5


def ranked(scores: DataFrame) -> DataFrame:
    """Rank from 0 within the task by score, then name."""
    w = Window.partitionBy("task_id").orderBy(F.col("score").desc(), "name")
    return scores.withColumn("rank", F.row_number().over(w) - 1)


def capped(scores: DataFrame, most: int = CANDIDATES) -> DataFrame:
    return ranked(scores).filter(F.col("rank") < most)


def known_only(rankings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rankings that name a candidate."""
    return rankings.join(candidates, "name", "left_semi")


def without_drafts(rankings: DataFrame, drafts: DataFrame) -> DataFrame:
    return rankings.join(drafts.select("name"), "name", "left_anti")


def role_of(rank: Column) -> Column:
    return F.when(rank == 0, "primary").otherwise("supporting")


def selected(rankings: DataFrame, drafts: DataFrame, most: int = 0, categories: list[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """Drafts go, then the limit applies (0: five), then categories and the score: so fewer may remain."""
    kept = ranked(without_drafts(rankings, drafts)).filter(F.col("rank") < (most or DEFAULT_SKILLS))
    if categories:
        kept = kept.filter(F.exists(F.array(*map(F.lit, categories)), lambda c: F.lower("name").contains(F.lower(c))))
    return kept.filter(F.col("score") >= least)


def confidence(scores: Column, rank: Column) -> Column:
    """Mean score, a tenth more where the first exceeds 0.8, at most 1; 0 without scores."""
    mean = F.avg(scores)
    return F.least(F.lit(1.0), F.coalesce(F.when(F.min_by(scores, rank) > 0.8, mean * 1.1).otherwise(mean), F.lit(0.0)))


#: Text around the candidates of a prompt; the reply it asks for is what parsed_ranking reads.
PROMPT = ('Task: "', '"\n\nCandidates:\n', '\n\nRank the candidates that fit the task, best first, and reply with JSON alone: {"rankings": [{"name": "...", "score": 0.0, "reason": "..."}]}')


def prompt_line(rank: Column, name: Column, description: Column) -> Column:
    return F.format_string("%d. %s: %s", (rank + 1).cast("int"), name, description)


def prompts(candidates: DataFrame, template: tuple[str, str, str] = PROMPT) -> DataFrame:
    """(task_id, prompt) of ranked candidates (task_id, task, rank, name, description), at most the cap of a task."""
    line = prompt_line(F.col("rank"), F.col("name"), F.col("description")).alias("line")
    g = candidates.groupBy("task_id", "task").agg(F.sort_array(F.collect_list(F.struct("rank", line))).alias("s"))
    lines = F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    before, between, after = map(F.lit, template)
    return g.select("task_id", F.concat(before, "task", between, lines, after).alias("prompt"))


def ranking_key(task: Column, names: Column) -> Column:
    """Key of a cached ranking: it does not depend on case, blanks around or the order of candidates."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(task)), F.array_join(F.array_sort(names), ",")), 256)


def cached_rankings(requests: DataFrame) -> DataFrame:
    """(id, key, served_by, hit) of requests (id, task, names): the first of a key is ranked, later ones read its result."""
    keyed = requests.select("id", ranking_key(F.col("task"), F.col("names")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("served_by"))
    return keyed.join(first, "key").select("id", "key", "served_by", (F.col("id") != F.col("served_by")).alias("hit"))


def parsed_ranking(reply: Column, names: Column) -> Column:
    """(name, score, reason) rows of a model's reply that rank one of the names.

    What stands from the first brace to the last is read as JSON; where there is none, or it does not
    parse, the lines `1. name score: 0.5 reason: text` are read, a score that is no number as 0.
    """
    json = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    entry = "struct<name:string,skillName:string,score:double,reason:string>"
    listed = F.transform(F.from_json(json, f"rankings array<{entry}>")["rankings"], lambda x: F.struct(F.coalesce(x["name"], x["skillName"]).alias("name"), x["score"].alias("score"), x["reason"].alias("reason")))
    line = r"(?i)(\d+)\.\s+(\S+)\s+score:\s*([\d.]+)\s*reason:\s*(.+)"
    score = lambda x: F.coalesce(F.regexp_extract(x, line, 3).try_cast("double"), F.lit(0.0))
    told = F.transform(F.filter(F.split(reply, "\n"), lambda x: x.rlike(line)), lambda x: F.struct(F.regexp_extract(x, line, 2).alias("name"), score(x).alias("score"), F.trim(F.regexp_extract(x, line, 4)).alias("reason")))
    none = F.array().cast("array<struct<name:string,score:double,reason:string>>")
    rows = F.when(F.try_parse_json(json).isNotNull(), F.coalesce(listed, none)).otherwise(told)
    return F.filter(rows, lambda x: F.array_contains(names, x["name"]))
