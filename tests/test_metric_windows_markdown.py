"""Metric index, anchored windows of busy keys and long workflow lists against plain versions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import markdown as M
from quillon.operators import metric, search
from quillon.operators import state as S


def clustered(spark, n=3000, width=8, seed=1):
    """Clusters with repeated and zero vectors, nulls and another width."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 20
    rows = [(i, [float(x) for x in centres[i % 12 if i % 3 else 0] + rng.normal(size=width)]) for i in range(n)]
    rows[5], rows[7], rows[9] = (5, rows[20][1]), (7, [0.0] * width), (9, None)
    rows += [(n, [1.0, 2.0]), (n + 1, [0.0] * width)]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4).cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("by", ["cosine", "euclidean"])
@pytest.mark.parametrize("k", [1, 7])
def test_metric_top_k_equals_comparing_all(spark, by, k):
    v = clustered(spark)
    queries = v.filter("id % 20 = 0").union(spark.createDataFrame([(90_001, [0.0] * 8), (90_002, [500.0] * 8)], v.schema))
    assert rows_of(metric.top_k(v, queries, k, by)) == rows_of(search.top_k(v, queries, k, by))


def test_metric_radius_and_few_rows(spark):
    v = clustered(spark)
    queries = v.filter("id % 20 = 0")
    for radius in (0.0, 2.5, 40.0, -1.0):
        assert rows_of(metric.within(v, queries, radius)) == rows_of(search.within(v, queries, radius))
    few = v.filter("id < 6")
    assert rows_of(metric.top_k(few, few, 10)) == rows_of(search.top_k(few, few, 10))
    assert metric.top_k(v.limit(0), queries, 3).count() == 0 and metric.within(v, v.limit(0), 1.0).count() == 0


def test_metric_index_skips_most_distances(spark):
    v = clustered(spark, 6000)
    queries = v.filter("id % 20 = 0")
    index = metric.build(v, 8)
    asked = metric.visits(index, queries, 8, 5, None)
    share = metric.share(index, asked, 6000, 300)
    assert 0 < share < 0.25
    assert index.blocks.agg(F.sum("n")).first()[0] == 6000  # one null and one of another width are out, one zero is added


def brute_windows(events, width):
    out, at = [], {}
    for key, event, us in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        start, number, count, first = at.get(key, (None, -1, 0, None))
        at[key] = (us, number + 1, 1, event) if start is None or us - start >= width else (start, number, count + 1, first)
        out.append((key, event, at[key][1], at[key][2], at[key][3]))
    return sorted(out)


def test_windows_of_a_key_without_gaps(spark):
    """A third of all rows on one key without a gap, ties in time, events exactly a width apart, negative times."""
    rng, width = random.Random(6), 1000
    events = [(0, i, 50 * i + rng.randint(0, 40)) for i in range(3000)]
    events += [(1, 10_000 + i, rng.choice([-5000, 0, 1000, 2000, 2999, 3000, 9000])) for i in range(60)]
    events += [(2, 20_000 + i, 1000 * i) for i in range(200)] + [(3 + i % 900, 30_000 + i, rng.randint(0, 400_000)) for i in range(5000)]
    df = spark.createDataFrame(events, "user_id long, event_id long, us long")
    assert sorted(tuple(r) for r in S.anchored_windows(df, "user_id", width).collect()) == brute_windows(events, width)


def test_windows_spread_a_busy_key(spark):
    """What looks for its next start is dealt by bucket: no group holds more than a bucket's events and those that look into it."""
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 50).alias("us"))
    plan = S.anchored_windows(df, "user_id", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
    assert df.groupBy(F.floor(F.col("us") / 1000)).count().agg(F.max("count")).first()[0] <= 20
    assert S.window_starts(df, "user_id", 1000).count() == 1000


def test_workflow_of_any_length(spark):
    """Two hundred thousand steps, and a text that holds U+0000."""
    long = "# T\n## Core Workflow\n" + "".join(f"{i}. **step {i}** — go\n" for i in range(200_000)) + "\n## Next\n"
    odd = "a\0b\n## Core Workflow\n1. x\n2. y y\n\0rest"
    got = [r[0] for r in spark.createDataFrame([(long,), (odd,), ("no ## Core Workflow here",), (None,)], "c string").select(M.collapse_workflow(F.col("c"))).collect()]
    assert got[0].startswith("# T\n## Core Workflow\nstep 0: go; step 1: go; ") and got[0].endswith("step 199999: go\n## Next\n")
    assert got[1:] == ["a\0b\n## Core Workflow\nx; y y\0rest", "no ## Core Workflow here", None]
    assert spark.createDataFrame([(long,)], "c string").select(F.length(M.compressed(F.col("c"), 10))).first()[0] > 10**6


@pytest.mark.parametrize("by", ["cosine", "euclidean"])
def test_block_pairs_are_solved_in_bounded_memory(by):
    import tracemalloc

    rng = np.random.default_rng(2)
    q, v = rng.integers(-3, 4, (1500, 8)).astype("f8"), rng.integers(-3, 4, (4096, 8)).astype("f8")
    ids = rng.permutation(4096)
    tracemalloc.start()
    i, j, value = search.solve(q, v, ids, 7, by, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the values alone took 49 MB before, their order as much again
    for x in (0, 700, 1499):
        far = np.round(np.sqrt(((q[x] - v) ** 2).sum(1)), 6)
        if by == "cosine":
            n = np.linalg.norm(q[x]) * np.linalg.norm(v, axis=1)
            far = -np.round(np.divide(v @ q[x], n, out=np.zeros(4096), where=n > 0), 6)
        want = np.lexsort((ids, far))[:7]
        assert j[i == x].tolist() == want.tolist() and np.allclose(value[i == x], np.abs(far[want]) if by == "euclidean" else -far[want])


def test_a_task_keeps_the_best_of_each_query(monkeypatch):
    monkeypatch.setattr(search, "PENDING", 40)
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 5, 600), rng.permutation(600), rng.integers(0, 9, 600))]
    parts = [tuple(np.array(x) for x in zip(*rows[at : at + 30])) for at in range(0, 600, 30)]
    out = [tuple(r.values()) for b in search.best(iter(parts), 3, "euclidean") for r in b.to_pylist()]
    top = lambda found: sorted(x for q in range(5) for x in sorted((r for r in found if r[0] == q), key=lambda r: (r[2], r[1]))[:3])
    assert top(out) == top(rows) and len(out) < 100


def test_queries_of_a_metric_search_stand_once_however_many_rings_they_visit(spark):
    v = clustered(spark)
    queries = v.filter("id % 20 = 0")
    index = metric.build(v, 8)
    for k, radius in ((None, 1e9), (3, None)):
        asked = metric.visits(index, queries, 8, k, radius)
        assert asked.agg(F.sum(F.size("query_ids"))).first()[0] == 150  # each query stood there once for each ring that it visits
    assert metric.share(index, metric.visits(index, queries, 8, None, 1e9), 3000, 150) > 0.99
