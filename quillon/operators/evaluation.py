"""Metrics of caches and compression, latency summaries, comparisons of runs and quality scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def compression_metrics(events: DataFrame) -> DataFrame:
    """Totals of (event, before, after, cache_size) events; the mean ratio is 1 without any."""
    kind = F.col("event")
    ok = kind == "compression"
    return events.agg(
        F.count_if(kind.isin("compression", "compression_error")).alias("total"), F.count_if(ok).alias("ok"), F.count_if(kind == "compression_error").alias("failed"),
        F.count_if(kind == "cache_hit").alias("hits"), F.count_if(kind == "cache_miss").alias("misses"), F.count_if(kind == "cache_eviction").alias("evictions"),
        F.coalesce(F.sum(F.when(ok, F.col("before") - F.col("after"))), F.lit(0)).cast("long").alias("saved"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("after") / F.col("before"))), F.lit(1.0)), 6).alias("mean_ratio"),
        F.max_by("cache_size", F.struct("us", "event_id")).alias("cache_size"),
    )


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank percentiles and the element in the middle.

    Equal values are counted first, then dealt by range, so that a group of any size is spread over many tasks:
    a value's rank is its rank in its range and the numbers of the ranges before.
    """
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    ranges = staged(counted.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(group, "part").agg(F.sum("n").alias("m"))
    of = Window.partitionBy(group)
    before = sums.select(group, "part", (F.sum("m").over(of.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(of).alias("c"))
    upto = F.sum("n").over(Window.partitionBy(group, "part").orderBy(value)) + F.col("before")
    placed = ranges.join(before, [group, "part"]).select(group, value, "c", "n", upto.alias("upto"))
    at = lambda k: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k), F.col(value)))
    share = lambda p: at(F.ceil(F.lit(p) * F.col("c")))
    return placed.groupBy(group).agg(at(F.floor(F.col("c") / 2) + 1).alias("median"), share(0.5).alias("p50"), share(0.95).alias("p95"), share(0.99).alias("p99"))


def summary(rows: DataFrame, group: str, value: str, tokens: str, price: float) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(tokens).alias("tokens"), F.round(F.sum(tokens) * price, 6).alias("cost"))


def compared(runs: DataFrame) -> DataFrame:
    """With against without, over exercises that have both arms; lower values win."""
    arms = runs.groupBy("exercise").pivot("arm", ["with", "without"]).agg(F.avg("value")).filter("`with` is not null and `without` is not null")
    a, b = F.col("with"), F.col("without")
    return arms.agg(F.count("*").alias("compared"), F.round(F.avg(a), 4).alias("mean_with"), F.round(F.avg(b), 4).alias("mean_without"), F.round(F.avg(a) - F.avg(b), 4).alias("delta"), F.count_if(a < b).alias("wins"), F.count_if(a > b).alias("losses"), F.count_if(a == b).alias("ties"))


def maintainability(correct: Column, complexity: Column, has_try: Column, sloc: Column) -> Column:
    """Up to 40 points for correctness, 30 for low complexity, 20 for error handling, 10 for length."""
    simple = F.when(complexity <= 5, 30).when(complexity <= 10, 20).when(complexity <= 15, 10).otherwise(0)
    return 40.0 * correct / 100 + simple + F.when(has_try, 20).otherwise(0) + F.when(sloc.between(10, 100), 10).when(sloc.between(1, 200), 5).otherwise(0)


def health() -> Column:
    """Quality score from 0 to 100 of counts total, non_english, with_examples, with_patterns and undersized."""
    share = lambda c: 100.0 * F.col(c) / F.col("total")
    zero = F.lit(0.0)
    score = 100 - F.least(F.col("non_english") * 2, F.lit(20)) - F.greatest(zero, (100 - share("with_examples")) * 0.2) - F.greatest(zero, (95 - share("with_patterns")) * 0.1) - F.least(F.col("undersized") * 0.3, F.lit(10.0))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(score))).cast("long")


def alerts(scores: DataFrame) -> DataFrame:
    """(category, kind, message) rows; 'all good' where nothing else applies."""
    low, missing = F.col("health"), F.col("total") - F.col("with_examples")
    row = lambda kind, message: F.struct(F.lit(kind).alias("kind"), message.alias("message"))
    found = F.filter(F.array(
        F.when(F.col("non_english") > 0, row("critical", F.concat("non_english", F.lit(" not in English")))),
        F.when(low < 65, row("critical", F.concat(F.lit("score "), low))).when(low < 85, row("warning", F.concat(F.lit("score "), low))),
        F.when(missing > 0, row("warning", F.concat(missing, F.lit(" without examples")))),
    ), lambda x: x.isNotNull())
    good = F.array(row("info", F.lit("all good")))
    return scores.select("category", F.inline(F.when(F.size(found) == 0, good).otherwise(found)))
