"""Metrics and evaluation queries."""
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..registry import query, source
from .state import _E, _events

_KIND = "CASE event_type WHEN 'click' THEN 'cache_hit' WHEN 'view' THEN 'cache_miss' WHEN 'purchase' THEN 'compression' WHEN 'error' THEN 'compression_error' ELSE 'cache_eviction' END"


@query(f"""{_E}, c AS (SELECT *, {_KIND} AS kind FROM e) SELECT count(*) FILTER (kind IN ('compression', 'compression_error')) AS total, count(*) FILTER (kind = 'compression') AS ok, count(*) FILTER (kind = 'compression_error') AS failed,
count(*) FILTER (kind = 'cache_hit') AS hits, count(*) FILTER (kind = 'cache_miss') AS misses, count(*) FILTER (kind = 'cache_eviction') AS evictions, CAST(coalesce(sum(1000 - k) FILTER (kind = 'compression'), 0) AS BIGINT) AS saved,
round(coalesce(avg(k / 1000) FILTER (kind = 'compression'), 1), 6) AS mean_ratio, max_by(k, (us, event_id)) AS cache_size FROM c""")
def compression_metrics(spark, d):
    kind = F.when(F.col("event_type") == "click", "cache_hit").when(F.col("event_type") == "view", "cache_miss").when(F.col("event_type") == "purchase", "compression").when(F.col("event_type") == "error", "compression_error").otherwise("cache_eviction")
    e = _events(spark, d).select("us", "event_id", kind.alias("event"), F.lit(1000).alias("before"), F.col("k").alias("after"), F.col("k").alias("cache_size"))
    return V.compression_metrics(e)


@query(f"{_E} SELECT user_id % 5 AS part, CAST(sum(k) FILTER (k >= 0) AS BIGINT) AS input, round(coalesce(sum(value) FILTER (value >= 0 AND NOT isnan(value)), 0), 4) AS output FROM (SELECT user_id, k - 20 AS k, value FROM e) GROUP BY part")
def token_totals(spark, d):
    e = _events(spark, d).select((F.col("user_id") % 5).alias("part"), (F.col("k") - 20).alias("k"), "value")
    ok = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(F.col(c)), F.col(c))
    return e.groupBy("part").agg(F.sum(F.when(F.col("k") >= 0, F.col("k"))).alias("input"), F.round(F.coalesce(F.sum(ok("value")), F.lit(0.0)), 4).alias("output"))


_RANK = "r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM e)"


@query(f"{_E}, {_RANK} SELECT event_type, max(value) FILTER (n = c // 2 + 1) AS median, max(value) FILTER (n = ceil(0.5 * c)) AS p50, max(value) FILTER (n = ceil(0.95 * c)) AS p95, max(value) FILTER (n = ceil(0.99 * c)) AS p99 FROM r GROUP BY event_type")
def latency_percentiles(spark, d):
    return V.percentiles(_events(spark, d), "event_type", "value")


@query(f"{_E} SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, CAST(sum(k) AS BIGINT) AS tokens, round(CAST(sum(k) AS DOUBLE) * 0.00002, 6) AS cost FROM e GROUP BY event_type")
def bench_summary(spark, d):
    return V.summary(_events(spark, d), "event_type", "value", "k", 0.00002)


@query(f"""{_E}, x AS (SELECT user_id AS exercise, avg(value) FILTER (event_type = 'click') AS w, avg(value) FILTER (event_type = 'view') AS o FROM e GROUP BY user_id)
SELECT count(*) AS compared, round(avg(w), 4) AS mean_with, round(avg(o), 4) AS mean_without, round(avg(w) - avg(o), 4) AS delta, count(*) FILTER (w < o) AS wins, count(*) FILTER (w > o) AS losses, count(*) FILTER (w = o) AS ties FROM x WHERE w IS NOT NULL AND o IS NOT NULL""")
def ab_compare(spark, d):
    e = _events(spark, d).filter("event_type in ('click', 'view')").select(F.col("user_id").alias("exercise"), F.when(F.col("event_type") == "click", "with").otherwise("without").alias("arm"), "value")
    return V.compared(e)


@query("""WITH x AS (SELECT page_id, page_id % 101 AS correct, page_id % 20 AS complexity, page_id % 2 = 0 AS has_try, page_id % 250 AS sloc FROM pages)
SELECT page_id, round(40.0 * correct / 100 + CASE WHEN complexity <= 5 THEN 30 WHEN complexity <= 10 THEN 20 WHEN complexity <= 15 THEN 10 ELSE 0 END + CASE WHEN has_try THEN 20 ELSE 0 END + CASE WHEN sloc BETWEEN 10 AND 100 THEN 10 WHEN sloc BETWEEN 1 AND 200 THEN 5 ELSE 0 END, 4) AS score FROM x""")
def maintainability(spark, d):
    i = F.col("page_id")
    return source(spark, d, "pages").select("page_id", F.round(V.maintainability(i % 101, i % 20, i % 2 == 0, i % 250), 4).alias("score"))


_HEALTH = """h AS (SELECT category, count(*) AS total, count(*) FILTER (role <> 'en' AND doc_id % 9 = 0) AS non_english, count(*) FILTER (doc_id % 4 <> 0) AS with_examples, count(*) FILTER (doc_id % 10 <> 0) AS with_patterns, count(*) FILTER (length(content) < 3000) AS undersized FROM skills GROUP BY category),
s AS (SELECT *, CAST(greatest(0, least(100, round(100 - least(non_english * 2, 20) - greatest(0, (100 - 100.0 * with_examples / total) * 0.2) - greatest(0, (95 - 100.0 * with_patterns / total) * 0.1) - least(undersized * 0.3, 10)))) AS BIGINT) AS health FROM h)"""


def _health(spark, d):
    i = F.col("doc_id")
    h = source(spark, d, "skills").groupBy("category").agg(F.count("*").alias("total"), F.count_if((F.col("role") != "en") & (i % 9 == 0)).alias("non_english"), F.count_if(i % 4 != 0).alias("with_examples"), F.count_if(i % 10 != 0).alias("with_patterns"), F.count_if(F.length("content") < 3000).alias("undersized"))
    return h.withColumn("health", V.health())


@query(f"WITH @skills, {_HEALTH} SELECT category, health FROM s")
def health_score(spark, d):
    return _health(spark, d).select("category", "health")


@query(f"""WITH @skills, {_HEALTH}, a AS (SELECT category, 'critical' AS kind, non_english || ' not in English' AS message FROM s WHERE non_english > 0 UNION ALL SELECT category, 'critical', 'score ' || health FROM s WHERE health < 65
UNION ALL SELECT category, 'warning', 'score ' || health FROM s WHERE health BETWEEN 65 AND 84 UNION ALL SELECT category, 'warning', (total - with_examples) || ' without examples' FROM s WHERE total > with_examples)
SELECT * FROM a UNION ALL SELECT category, 'info', 'all good' FROM s WHERE category NOT IN (SELECT category FROM a)""")
def quality_alerts(spark, d):
    return V.alerts(_health(spark, d))
