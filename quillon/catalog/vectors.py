"""Vector queries: every twentieth vector searches all vectors."""
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import LCG, lcg_jumps, lcg_vector, signed_hex, text_hash as java_hash
from ..operators import metric
from ..operators.search import top_k, within
from ..registry import SQL, query, source

_PAIRS = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, e.id, list_dot_product(q.v, e.v) AS d, sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)) AS n, list_distance(q.v, e.v) AS far FROM e q, e WHERE q.id % 20 = 0)"""


def _vectors(spark, d):
    return source(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"), "label")


def _search(spark, d, k, by="cosine"):
    v = _vectors(spark, d)
    return top_k(v, v.filter("id % 20 = 0"), k, by)


@query(_PAIRS + " SELECT query_id, id, round(d / n, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d / n, 6) DESC, id) AS rank FROM s) WHERE rank <= 5")
def vector_topk(spark, d):
    return _search(spark, d, 5).withColumnRenamed("value", "score")


@query(_PAIRS + " SELECT query_id, id, round(d / n, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d / n, 6) DESC, id) AS rank FROM s) WHERE rank <= 20 AND round(d / n, 6) >= 0.3")
def vector_topk_linear(spark, d):
    """The limit comes first, then the threshold."""
    return _search(spark, d, 20).filter("value >= 0.3").withColumnRenamed("value", "score")


@query(_PAIRS + " SELECT query_id, id, round(far, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(far, 6), id) AS rank FROM s) WHERE rank <= 10")
def knn(spark, d):
    return _search(spark, d, 10, "euclidean").withColumnRenamed("value", "distance")


@query(_PAIRS + " SELECT query_id, id, round(far, 6) AS distance FROM s WHERE round(far, 6) <= 1.1")
def radius_search(spark, d):
    v = _vectors(spark, d)
    return within(v, v.filter("id % 20 = 0"), 1.1).withColumnRenamed("value", "distance")


@query(SQL["vector_topk"])
def pivot_topk(spark, d):
    """vector_topk through the metric index."""
    v = _vectors(spark, d)
    return metric.top_k(v, v.filter("id % 20 = 0"), 5).withColumnRenamed("value", "score")


@query(SQL["knn"])
def pivot_knn(spark, d):
    """knn through the metric index."""
    v = _vectors(spark, d)
    return metric.top_k(v, v.filter("id % 20 = 0"), 10, "euclidean").withColumnRenamed("value", "distance")


@query(SQL["radius_search"])
def pivot_radius(spark, d):
    """radius_search through the metric index."""
    v = _vectors(spark, d)
    return metric.within(v, v.filter("id % 20 = 0"), 1.1).withColumnRenamed("value", "distance")


_NEXT = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.id = a.id + 1)"""


def _next(spark, d):
    v = _vectors(spark, d).drop("label")
    return v.select("id", F.col("v").alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("b")), "id")


@query(_NEXT + " SELECT id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS score FROM p")
def cosine(spark, d):
    return _next(spark, d).select("id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query(_NEXT + " SELECT id, round(list_distance(a, b), 6) AS distance FROM p")
def euclidean(spark, d):
    return _next(spark, d).select("id", F.round(V.euclidean(F.col("a"), F.col("b")), 6).alias("distance"))


@query("SELECT vec_id AS id, CAST(pos AS INTEGER) AS pos, round(v[pos + 1] / n, 6) AS x FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, unnest(range(len(v))) AS pos FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
def l2_normalize(spark, d):
    v = _vectors(spark, d).select("id", F.posexplode(V.normalised(F.col("v"))).alias("pos", "x"))
    return v.select("id", "pos", F.round("x", 6).alias("x"))


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) = 64 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0) AS n_valid FROM embeddings GROUP BY label")
def valid_vectors(spark, d):
    return _vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.valid(F.col("v"), 64)).alias("n_valid"))


_HASHED = """WITH @requests, u AS (SELECT task_id, list_reduce([0::HUGEINT] || list_transform(string_split(task, ''), lambda c: CAST(unicode(c) AS HUGEINT)), lambda a, x: (a * 31 + x) % 4294967296) AS u FROM requests),
s AS (SELECT task_id, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS BIGINT) AS h FROM u)"""
_JUMPS = "(VALUES " + ", ".join(f"({k}, {f}, {s})" for k, (f, s) in enumerate(zip(*lcg_jumps(16)))) + ") j(pos, f, s)"


@query(f"""{_HASHED}, v AS (SELECT task_id, pos, ((f * (abs(h) % {LCG[2]}) + s) % {LCG[2]}) / {LCG[2]}.0::DOUBLE * 2 - 1 AS x FROM s, {_JUMPS})
SELECT task_id, CAST(pos AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY task_id)), 6) AS x FROM v""".replace("FROM s, ", "FROM s CROSS JOIN "))
def placeholder_embedding(spark, d):
    v = source(spark, d, "requests").select("task_id", F.posexplode(lcg_vector(F.col("task"), 16)).alias("pos", "x"))
    return v.select("task_id", "pos", F.round("x", 6).alias("x"))


@query(_HASHED + " SELECT task_id, lpad(CASE WHEN h < 0 THEN '-' ELSE '' END || lower(to_hex(abs(h))), 8, '0') AS hash FROM s")
def text_hash(spark, d):
    return source(spark, d, "requests").select("task_id", signed_hex(java_hash(F.col("task"))).alias("hash"))
