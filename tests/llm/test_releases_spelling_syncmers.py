"""Cascading release, spelling variants and fingerprints against brute-force versions, with edge cases."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from quillon.llm import releases, spelling, syncmers

# releases: a turn's outcome from its parent's, one after the other

CONV = "conv_id long, turn long, role string, text string, p string, piece int"


def drawn(k, conv, turn):
    return zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode())


def brute_releases(rows):
    convs = defaultdict(list)
    for conv, turn, text in rows:
        convs[conv].append((turn, zlib.crc32((text or "").encode())))
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        done = []
        for p, (turn, crc) in enumerate(found):
            back = drawn(0, conv, turn) % 7
            parent = done[p - back] if 0 < back <= p else None
            if parent and parent[0] != "delivered":
                done.append(("blocked", 0, None, None))
                continue
            at = first = max(7 * p, parent[3] if parent else 0)
            status, tries, faulty = "dead", 0, drawn(1, conv, turn) % 101 < 20
            for a in range(1, 5):
                tries, last = a, at
                if not faulty or not (at < 7 * p + drawn(2, conv, turn) % 101 or drawn(a + 2, conv, turn) % 3 == 0):
                    status = "delivered"
                    break
                at += 20 * 2 ** (a - 1)
            done.append((status, tries, first, last))
        order = sorted((d[3], p) for p, d in enumerate(done) if d[0] == "delivered")
        place, state = {}, 0
        for k, (_, p) in enumerate(order, 1):
            state += k * found[p][1]
            place[p] = (k, (state + 2**63) % 2**64 - 2**63)
        out += [(conv, found[p][0], *done[p], *place.get(p, (None, None))) for p in range(len(found))]
    return Counter(out)


def replay(spark, rows, **kw):
    df = spark.createDataFrame([(c, t, "user", x, "q", 3) for c, t, x in rows], CONV)
    return Counter(tuple(r) for r in releases.releases(df, **kw).collect())


def test_release_of_hot_and_broken_conversations(spark):
    """A conversation of three thousand turns in blocks of 16 and 64, null ids and turns, repeated and equal turns, gaps."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice([None, "", "a", "é" * 5000, f"text {t}"])) for t in range(0, 6000, 2)]
    rows += [(c, t, f"{c} {t}") for c in range(40) if c != 7 for t in range(rng.randint(1, 30))]
    rows += [(None, t, "n") for t in range(12)] + [(50, None, "x"), (50, None, "y"), (50, 0, "z"), (50, 1, None), (50, 1, None), (50, 1, "other"), (51, -5, "m"), (51, 9, "m")]
    rng.shuffle(rows)
    want = brute_releases(rows)
    for block in (16, 64, 4096):
        assert replay(spark, rows, block=block) == want
    assert {r[2] for r in want} == {"delivered", "dead", "blocked"}


def test_release_of_nothing(spark):
    assert replay(spark, []) == Counter()


def test_state_goes_on_beyond_64_bits(spark):
    texts = {zlib.crc32(f"{i}".encode()): f"{i}" for i in range(5000)}
    got = releases.releases(spark.range(150_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit(texts[max(texts)]).alias("text")))
    last = got.filter("release_no is not null").orderBy(F.col("release_no").desc()).first()
    n = last["release_no"]
    assert n * (n + 1) // 2 * max(texts) > 2**63
    assert last["state"] == (n * (n + 1) // 2 * max(texts) + 2**63) % 2**64 - 2**63


def test_a_conversation_is_spread(spark):
    """A conversation with all rows is cut into pieces of hundreds of turns, whatever its length."""
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("x").alias("text"))
    parts = releases.pieces(releases.numbered(releases.turns(df))).groupBy("piece").count()
    most, n = parts.agg(F.max("count"), F.count("*")).first()
    assert n > 60 and most < 2500
    assert releases.ranged(df.withColumn("conv", F.lit("1")), "turn").select("_part").distinct().count() == 4


def test_wheel_keeps_time():
    rng = random.Random(1)
    wheel, due, got = releases.Wheel(10_000), [], []
    for i in range(500):
        at = 10_000 + rng.choice([0, 1, 63, 64, 65, 4095, 4096, rng.randrange(10**6), rng.randrange(10**10)])
        wheel.put(at, i)
        due.append((at, i))
    while (found := wheel.fire()) is not None:
        got += [(wheel.now, i) for i in found]
        if rng.random() < 0.2:
            due.append((wheel.now + 70, len(due)))
            wheel.put(*due[-1])
    assert sorted(got) == sorted(due) and [t for t, _ in got] == sorted(t for t, _ in got)


# spelling: every pair of words

DOCS = "doc_id long, text string, word string, n int, size int"


def brute_words(rows, letters=6, occurrences=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= letters:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= occurrences}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    around = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return out


def edited(rng, w, letters="abeÉ÷"):
    at = rng.randrange(len(w) + 1)
    return rng.choice([w[:at] + rng.choice(letters) + w[at:], w[: max(at - 1, 0)] + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])


def test_spelling_variants(spark):
    """Clusters of edits around words that share halves, repeated letters, capitals, a very long word, nulls and repeated rows."""
    rng = random.Random(8)
    words = ["aaaaaa", "aaaaaaa", "internal", "interval", "interest", "Übergrößen", "x×÷yzzz", "q" * 3000, "q" * 2999 + "r"]
    words += ["".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(120)]
    words += [edited(rng, rng.choice(words[:7])) for _ in range(80)]
    texts = []
    for i, w in enumerate(words):
        texts += [w if k % 3 else w.capitalize() for k in range(rng.choice([3, 5, 6, 30, 40, 200]))]
    rng.shuffle(texts)
    rows = [(i, "1 ".join(texts[at : at + 50])) for i, at in enumerate(range(0, len(texts), 50))]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (1, rows[1][1]), (90, None), (91, ""), (92, "short words only"), (93, "b" * 100_000)]
    want = brute_variants(rows)
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], DOCS)
    for most in (2, 64):
        assert {tuple(r) for r in spelling.variants(df, most=most).collect()} == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []


# fingerprints: plain Python over the same pieces


def signed_hash(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_sketch(text):
    p = [""] * 5 + re.findall(r"[^\x20\x09-\x0D]{1,4}", text)
    h = [signed_hash(p[i : i + 2]) for i in range(len(p) - 1)]
    best = {}
    for i in range(len(p) - 5):
        if min(h[i : i + 5]) in (h[i], h[i + 4]):
            x = (signed_hash(p[i : i + 6]) % 2**64) >> 24
            best[x >> 33] = min(best.get(x >> 33, (x, i)), (x, i))
    return sorted(best.values()) if len(p) > 5 else []


def brute_likeness(a, b):
    slots = {x >> 33 for x, _ in a} | {x >> 33 for x, _ in b}
    at = dict(b)
    shifts = sorted(i - at[x] for x, i in a if x in at)
    kept = sum(abs(s - shifts[len(shifts) // 2]) <= 16 for s in shifts)
    return kept / len(slots) if slots else 1.0


def brute_fingerprints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash([r[1]])))
    out, text = [], lambda e: " ".join(f"{x:010x}@{i}" for x, i in e)
    for k, (i, t) in enumerate(rows):
        following, third = rows[(k + 1) % len(rows)][1], len(t) // 3
        edit = t[: len(t) - third] + following[:third]
        a, b, c = brute_sketch(t), brute_sketch(edit), brute_sketch(following)
        out.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), text(a), text(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    return Counter(out)


def test_fingerprints(spark):
    """Short, empty, blank, unbroken, astral and long texts, copies, repeated and null ids, in one block and in several."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + rng.choice(["", "s", "ing"]) for _ in range(n))
    long = prose(8000)
    texts = [None, "", " \n\t ", "a", "ab c", "😀" * 50, "x" * 3000, long, long + " tail", *(prose(rng.randint(1, 300)) for _ in range(40))]
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)] + [(None, "n one"), (None, None), (1, texts[12]), (1, texts[12]), (1, "other"), (-(2**63), "low"), (2**63 - 1, "high")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, True, "o") for i, t in rows], "doc_id long, text string, block int, halo boolean, `order` string")
    want = brute_fingerprints(rows)
    for blocks in (1, 3, 40):
        got = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in syncmers.fingerprints(df, blocks).collect())
        assert got == want
    alike = [r for r in want if r[1] > 200]
    assert all(r[5] > 0.25 for r in alike) and sum(r[6] < 0.1 for r in alike) > 25


def test_fingerprints_of_one_and_none(spark):
    schema = "doc_id long, text string"
    one = syncmers.fingerprints(spark.createDataFrame([(4, "abcdef")], schema)).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    assert syncmers.fingerprints(spark.createDataFrame([], schema)).collect() == []


def test_fingerprints_use_no_python(spark, sf_dir):
    plan = syncmers.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|MapIn|Pandas", plan)
