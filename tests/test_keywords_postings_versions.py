"""Keyword automata, bitmap postings and the forgetting version store against plain versions."""
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import keywords as AC
from quillon.operators import postings as P
from quillon.sources.versions import VersionStore


def plain_matches(docs, words):
    words = {w.lower() for w in words if w}
    return sorted((n, w) for n, t in docs if t for w in words if w in t.lower())


def test_automaton_equals_plain_search(spark, monkeypatch):
    """Nested, overlapping and repeated keywords, several parts, texts across lanes, other scripts, nulls, repeated names."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé ß𝒳") for _ in range(n))
    words = [word(rng.randint(1, 9)) for _ in range(700)] + ["a", "ab", "bab", "x" * 1500, "Zebra", "zebra", None, "", "never there"]
    docs = [(f"d{i}", word(rng.randint(0, 400))) for i in range(120)]
    docs += [("null", None), ("empty", ""), ("long", word(6000) + "x" * 1500 + "zebrA"), ("run", "ab" * 3000), ("edge", "-" * (AC.LANE - 2) + "zebra")]
    monkeypatch.setattr(AC, "PART_BYTES", 2000)
    df = spark.createDataFrame([(n, t, "q") for n, t in docs], "name string, text string, keyword string")
    table = spark.createDataFrame([(w, 1) for w in words], "keyword string, text int")
    assert sorted(tuple(r) for r in AC.matches(df, table).collect()) == plain_matches(docs, words)
    assert AC.matches(df, table.limit(0)).count() == 0 and AC.matches(df.limit(0), table).count() == 0


def test_automaton_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(AC, "GROUP_BYTES", 50)
    monkeypatch.setattr(AC, "PENDING", 3)
    a = AC.Automaton(["he", "she", "his", "hers"])
    text, found = a.search([b"ushers", b"", b"his his", b"xyz"])
    assert sorted(zip(text.tolist(), found.tolist())) == [(0, 0), (0, 1), (0, 3), (2, 2)]
    assert list(AC._groups([20, 40, 5, 100, 0])) == [(0, 1), (1, 3), (3, 4), (4, 5)]


def test_keyword_groups_ties_and_default(spark):
    docs = spark.createDataFrame([("a", "one TWO"), ("b", "three"), ("c", None), ("a", "four one")], "name string, text string")
    table = spark.createDataFrame([("x", 1, "one"), ("y", 0, "two"), ("y", 0, "TWO"), ("x", 1, "four"), ("z", 2, "thre"), ("w", 2, "hree")], "grp string, ord int, keyword string")
    assert sorted(tuple(r) for r in AC.groups(docs, table).collect()) == [("a", "x", 1, 3), ("a", "y", 0, 1), ("b", "w", 2, 1), ("b", "z", 2, 1)]
    assert sorted(tuple(r) for r in AC.classified(docs, table, "none").collect()) == [("a", "x"), ("a", "x"), ("b", "w"), ("c", "none")]
    with pytest.raises(ValueError):
        AC.matches(docs, spark.createDataFrame([("k" * 5000,)], "keyword string"))


def test_plan_does_not_grow_with_keywords(spark):
    docs = spark.createDataFrame([("a", "k1 k2")], "name string, text string")
    table = lambda n: spark.range(n).select(F.concat(F.lit("k"), "id").alias("keyword"), F.lit("g").alias("grp"), F.lit(0).alias("ord"))
    nodes = [AC.groups(docs, table(n))._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (10, 5000)]
    assert nodes[0] == nodes[1]


def test_postings_of_many_ids(spark):
    """Negative, large and repeated ids, null ids and tags, the sign bit of a word, an empty index."""
    rng = random.Random(3)
    rows = [(i, [t for t in "abc" if rng.random() < 0.4] + [None]) for i in [*range(-130, 400), 63, 2**40, 2**40 + 63, 2**62]]
    df = spark.createDataFrame([*rows, (None, ["a"]), (7_000, None)], "id long, tags array<string>")
    index = P.bitmaps(df, "tags", "id")
    has = {t: {i for i, ts in rows if t in ts} for t in "abc"}
    every = {i for i, _ in rows} | {7_000}
    ask = lambda tags, rule: sorted(r[0] for r in P.ids_where(index, tags, rule).collect())
    assert ask(["a", "b"], lambda a, b: a.bitwiseAND(b)) == sorted(has["a"] & has["b"])
    assert ask(["a", "b", "c"], lambda a, b, c: a.bitwiseOR(b).bitwiseAND(F.bitwise_not(c))) == sorted((has["a"] | has["b"]) - has["c"])
    assert ask(["a"], F.bitwise_not) == sorted(every - has["a"]) and ask(["x"], lambda x: x) == []
    assert P.count_where(index, ["c"], lambda c: c).first()[0] == len(has["c"])
    assert P.count_where(P.bitmaps(df.limit(0), "tags", "id"), ["c"], lambda c: c).first()[0] == 0
    halves = P.extend(P.bitmaps(df.filter("id % 2 = 0"), "tags", "id"), P.bitmaps(df.filter("id % 2 <> 0"), "tags", "id"))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, index.collect()))


def store_of(spark, folder):
    return VersionStore(spark, f"file://{folder}/store", "skill string, version string, created long, content string", ("skill", "version"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_store_forgets_and_keeps(spark, tmp_path):
    s = store_of(spark, tmp_path)
    put = lambda *rows: s.write(spark.createDataFrame(rows, "skill string, version string, created long, content string"))
    gone = lambda at, *keys: s.remove(spark.createDataFrame(keys, "skill string, version string"), at)
    assert s.read().count() == 0 and s.size() == 0
    put(("a", "brief", 1, "old" * 500), ("b", "brief", 1, "b"), (None, "brief", 1, "null"), ("c", "full", 5, "c"))
    put(("a", "brief", 2, "new"), ("a", "brief", 2, "new"))
    gone(3, ("b", "brief"), ("c", "full"), (None, "brief"))
    want = [("a", "brief", 2, "new"), ("c", "full", 5, "c")]
    assert rows_of(s.read()) == want  # c was written after its removal
    before, size = s.read(), s.size()
    s.compact()
    assert rows_of(before) == want == rows_of(s.read()) and s.size() < size  # who reads the old state goes on with it
    assert s.vacuum() > 0 and len(s.manifests()) == 1 and rows_of(s.read()) == want
    put(("b", "brief", 2, "late"), ("b", "full", 9, "b"))
    assert rows_of(s.read()) == [("a", "brief", 2, "new"), ("b", "brief", 2, "late"), ("b", "full", 9, "b"), ("c", "full", 5, "c")]
    s.compact()
    assert len(s.state()[1]) == 1


def test_store_with_two_writers_and_a_lost_one(spark, tmp_path):
    s, other = store_of(spark, tmp_path), store_of(spark, tmp_path)
    row = lambda k, at=1: spark.createDataFrame([(k, "v", at, k)], "skill string, version string, created long, content string")
    s.write(row("a"))
    (tmp_path / "store" / "_manifests" / ".new-lost").write_text("rows-lost")  # a writer that was lost half-way
    assert rows_of(s.read()) == [("a", "v", 1, "a")]
    put = s._put

    def slow(rows, kind):
        folder = put(rows, kind)
        other.write(row("b"))  # arrives while the compaction is at work
        return folder

    s._put = slow
    s.compact()
    assert rows_of(s.read()) == [("a", "v", 1, "a"), ("b", "v", 1, "b")] and s.manifests() == [1, 2, 3]
    s._put = put
    first, state = s.state, s.state()
    taken = iter([(2, state[1])])  # a writer that has seen an older state loses the race and tries again
    s.state = lambda: next(taken, None) or first()
    s._publish(lambda folders: [*folders, "rows-none"] if len(folders) > 5 else folders)
    s.state = first
    assert s.manifests() == [1, 2, 3, 4] and s.state()[1] == state[1]
    s.vacuum()
    assert rows_of(other.read()) == [("a", "v", 1, "a"), ("b", "v", 1, "b")] and s.manifests() == [4]


def test_a_group_of_texts_is_scanned_in_bounded_memory():
    import tracemalloc

    from quillon.operators import keywords as K

    words = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    text = " ".join(words) + " "
    texts = [(text * 30).encode()] * 1500  # 9 MB
    automaton = K.Automaton(words)
    found, groups = 0, list(K._groups([len(t) for t in texts]))
    tracemalloc.start()
    for begin, end in groups:
        found += len(automaton.search(texts[begin:end])[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1500 * len(words) and peak < 24 << 20, peak
