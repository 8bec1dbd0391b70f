"""Operators on directed links (src, dst) between named documents. Order is by name."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import let
from ..sources.tables import staged


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dangling(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Links to names that do not exist."""
    return edges.join(names.select(F.col("name").alias("dst")), "dst", "left_anti").select("src", "dst")


def alive(edges: DataFrame, names: DataFrame) -> DataFrame:
    return edges.join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")


def one_way(edges: DataFrame) -> DataFrame:
    """Links without their opposite."""
    return edges.select("src", "dst").join(reverse(edges), ["src", "dst"], "left_anti")


def degrees(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, degree) of every name, counting links to anything."""
    n = edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))
    return names.select("name").join(n, "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"))


def added_opposites(edges: DataFrame, most: int = 4) -> DataFrame:
    """Opposites of one-way links that fit: a target takes them in order of name while it has fewer than `most` links."""
    missing = reverse(one_way(edges))
    held = edges.groupBy("src").agg(F.count("*").alias("held"))
    order = Window.partitionBy("src").orderBy("dst")
    ranked = missing.join(held, "src", "left").withColumn("k", F.row_number().over(order))
    # The bound without the links held lets Spark drop the rest of a busy target's rows before the shuffle.
    return ranked.filter((F.col("k") <= most) & (F.col("k") <= most - F.coalesce("held", F.lit(0)))).select("src", "dst")


def enforce_reciprocal(edges: DataFrame, names: DataFrame, most: int = 4) -> DataFrame:
    """Links to existing names, and the opposites that fit.

    Dead links go first: the slots that they held are free for opposites at once.
    """
    live = alive(edges, names)
    return live.union(added_opposites(live, most))


def first_links(edges: DataFrame, most: int) -> DataFrame:
    """The first `most` links of each source by name."""
    return edges.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("k") <= most).drop("k")


def symmetrised(edges: DataFrame, most: int = 5) -> DataFrame:
    both = edges.select("src", "dst").union(reverse(edges)).filter("src <> dst").distinct()
    return first_links(both, most)


def repaired(edges: DataFrame, names: DataFrame, suggestions: DataFrame, most: int = 4) -> DataFrame:
    """Live links, missing opposites and suggestions; first `most` by name, then self-links go."""
    live = alive(edges, names)
    every = live.union(alive(reverse(one_way(live)), names)).union(alive(suggestions.select("src", "dst"), names)).distinct()
    return first_links(every, most).filter("src <> dst")


def problems(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, problem): missing targets, self-links, one-way links, links that stand more than once."""
    once = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = once.select("src", "dst")
    live = alive(links, names)
    found = ((dangling(links, names), "missing"), (links.filter("src = dst"), "self"), (one_way(live), "one way"), (once.filter("n > 1").select("src", "dst"), "duplicate"))
    return reduce(DataFrame.union, [rows.withColumn("problem", F.lit(kind)) for rows, kind in found])


#: Similarity whose prefixes a first search for suggestions uses; what it finds sets the bound of the second.
PROBE = 0.9
#: Similarity below which the first search keeps nothing.
FAINT = 0.7
#: Words are counted by this many places of a table, so that the order of words is a table of fixed size.
PLACES = 1 << 16


def _word_sets(docs: DataFrame, *parts: str) -> DataFrame:
    """(name, category, n, h1, h2) of the documents with words, a class being its category and two hashes of its sorted words; parts adds their `words` or `hashes`."""
    words = F.sort_array(F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda w: w != "")))
    made = {"words": lambda w: w, "hashes": lambda w: F.transform(w, lambda x: F.xxhash64(x))}
    marked = let(words, lambda w: F.struct(F.size(w).alias("n"), *(F.xxhash64(F.lit(s), w).alias(f"h{s}") for s in (1, 2)), *(made[x](w).alias(x) for x in parts)))
    return docs.filter("category is not null").select("name", "category", marked.alias("m")).select("name", "category", "m.*").filter("n > 0")


def _equal_sets(sets: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(category, src, dst) of equal sets without a link: of each class at least its first `most` pairs by name, and not many more.

    The first `most` + linked pairs of a class hold `most` without a link, and they need only so many of its names.
    """
    own = ["category", "h1", "h2"]
    copies = staged(sets.join(sets.groupBy(*own).count().filter("count > 1").select(*own), own, "left_semi").select("name", *own), "copies")
    inside = links.join(copies.withColumnRenamed("name", "src"), "src").join(copies.withColumnRenamed("name", "dst"), ["dst", *own])
    linked = inside.groupBy(*own).count().agg(F.max("count")).first()[0] or 0
    ranked = copies.withColumn("k", F.row_number().over(Window.partitionBy(*own).orderBy("name"))).filter(F.col("k") <= most + linked + 1)
    x, y = ranked.select(*own, F.col("name").alias("src"), F.col("k").alias("i")), ranked.select(*own, F.col("name").alias("dst"), F.col("k").alias("j"))
    # From the first name on, each has fewer names behind it: the i-th is needed only while those before it leave room.
    size = ranked.groupBy(*own).agg(F.max("k").alias("m"))
    before = (F.col("i") - 1) * (2 * F.col("m") - F.col("i")) / 2 + F.col("j") - F.col("i") - 1
    pairs = x.join(size, own).filter((F.col("i") - 1) * (2 * F.col("m") - F.col("i")) / 2 < most + linked).join(y, own)
    return pairs.filter((F.col("src") < F.col("dst")) & (F.col("i") < F.col("j")) & (before < most + linked)).select("category", "src", "dst").join(links, ["src", "dst"], "left_anti")


def _parity(hashes: Column) -> list[Column]:
    """256 bits of a set: each word turns one over. As many words at least are in only one of two sets as bits differ."""
    quarter = lambda i: F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(3) == i)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    return [F.aggregate(quarter(i), F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(bit(h))) for i in range(4)]


def _ordered(sets: DataFrame) -> DataFrame:
    """(category, name, n, h1, h2, s0 to s3, hashes): sets by hashes of their words, rare ones first, and the bits of their parity.

    Documents with a word are counted by the place of its hash, and a place keeps one byte on a log scale. Any
    order that hangs on the hash alone keeps the prefixes of two sets comparable, so words that share a place
    cost time and never a pair.
    """
    place = lambda h: F.pmod(h, F.lit(PLACES)).cast("int")
    counts = bytearray(PLACES)
    for at, n in sets.select(F.explode("hashes").alias("h")).groupBy(place(F.col("h")).alias("at")).count().collect():
        counts[at] = min(255, int(8 * math.log2(n + 1)))
    rare = F.sort_array(F.transform("hashes", lambda h: F.struct(F.substring(F.lit(counts), place(h) + 1, F.lit(1)).alias("c"), h.alias("h"))))["h"]
    return sets.select("category", "name", "n", "h1", "h2", *(s.alias(f"s{i}") for i, s in enumerate(_parity(F.col("hashes")))), rare.alias("hashes"))


def _likely(ordered: DataFrame, level: float, least: float) -> DataFrame:
    """(a, b): different sets whose prefixes for a similarity of `level` meet, if sizes, places and parity let them be as similar as `least`.

    Two sets as similar share a word among the first of both; the words behind the first shared one must suffice
    for the rest. What meets carries 32 bytes of parity and no words.
    """
    level, need = level - 1e-6, (least - 1e-6) / (1 + least - 1e-6)
    # Two different sets have a word outside both, so a similarity near 1 takes large ones.
    large = ordered.filter(F.col("n") >= level / max(1 - level, 1e-9) * (1 - 1e-9))
    prefix = (F.col("n") - F.ceil(level * F.col("n") - 1e-9) + 1).cast("int")
    bits = [f"s{i}" for i in range(4)]
    first = large.select("category", F.col("name").alias("id"), "n", "h1", "h2", *bits, F.posexplode(F.slice("hashes", F.lit(1), prefix)).alias("p", "h"))
    a, b = (first.select("category", "h", *(F.col(c).alias(c + x) for c in ("id", "n", "h1", "h2", *bits)), (F.col("n") - F.col("p")).alias(f"rest{x}")) for x in "ab")
    both = need * (F.col("na") + F.col("nb")) - 1e-9
    apart = sum((F.bit_count(F.col(s + "a").bitwiseXOR(F.col(s + "b"))) for s in bits), F.lit(0))
    other = (F.col("h1a") != F.col("h1b")) | (F.col("h2a") != F.col("h2b"))
    enough = (F.least("na", "nb") >= both) & (F.least("resta", "restb") >= both) & ((F.col("na") + F.col("nb") - apart) / 2 >= both)
    return a.join(b, ["category", "h"]).filter((F.col("ida") < F.col("idb")) & other & enough).select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def _near_sets(docs: DataFrame, ordered: DataFrame, level: float, least: float) -> DataFrame:
    """(category, src, dst, score): pairs of `_likely` with their similarity where it is `least` or more, from their words. With level = least that is every such pair."""
    met = staged(_likely(ordered, level, least).distinct(), "met")
    asked = met.select(F.col("a").alias("name")).union(met.select("b")).distinct()
    words = staged(_word_sets(docs.join(asked, "name", "left_semi"), "words"), "words")
    left, right = (words.select(F.col("name").alias(x), F.col("category").alias(f"c{x}"), F.col("words").alias(f"w{x}")) for x in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    score = F.round(both / (F.size("wa") + F.size("wb") - both), 6)
    pairs = met.join(left, "a").join(right, "b").filter("ca = cb")
    return pairs.select(F.col("ca").alias("category"), F.col("a").alias("src"), F.col("b").alias("dst"), score.alias("score")).filter(F.col("score") >= round(least, 6))


def suggested(docs: DataFrame, edges: DataFrame, least: float = 0.3, most: int = 50) -> DataFrame:
    """The most similar pairs of a category that the first does not link to yet: docs has (name, category, text).

    Equal word sets come first, as nothing is more alike; where they fill the answer, no words are compared. Else
    two searches over different sets, however few pairs there are: the first looks at the short prefixes of very
    similar sets and keeps what it happens on; the last of the best `most` so far is the bound of the second, which
    misses no pair at it or above.
    """
    links = edges.select("src", "dst").distinct()
    sets = staged(_word_sets(docs), "word-sets")
    same = _equal_sets(sets, links, most).withColumn("score", F.lit(1.0)).filter(F.col("score") > least)

    def best(*pairs: DataFrame) -> DataFrame:
        return staged(reduce(DataFrame.unionByName, pairs).orderBy(F.col("score").desc(), "src", "dst").limit(most), "suggested")

    def bound(found: DataFrame) -> float:
        n, last = found.agg(F.count("*"), F.min("score")).first()
        return last if n == most else least

    equal = found = best(same)
    # Rounded to six digits, only sets of a million words can be as alike as equal ones.
    if bound(found) < 1 or (sets.agg(F.max("n")).first()[0] or 0) > 900_000:
        hashed = _ordered(staged(_word_sets(docs, "hashes"), "hashed"))

        def near(level: float, lowest: float) -> DataFrame:
            return _near_sets(docs, hashed, level, lowest).filter(F.col("score") > least).join(links, ["src", "dst"], "left_anti").select("category", "src", "dst", "score")

        probe = max(PROBE, least)
        found = best(equal, near(probe, max(min(FAINT, probe), least)))
        if (last := bound(found)) < probe:
            found = best(equal, near(last, last))
    return found.select("category", "src", "dst", "score").orderBy(F.col("score").desc(), "src", "dst")


def keyword_hits(text: Column, keywords) -> Column:
    """Array of (grp, ord, hits): groups of which any keyword stands in the text; keywords are rows (grp, ord, keyword)."""
    low, groups = F.lower(text), {}
    for grp, rank, keyword in keywords:
        groups.setdefault((grp, rank), set()).add(keyword)
    hits = [F.struct(F.lit(g).alias("grp"), F.lit(o).alias("ord"), sum((low.contains(k).cast("int") for k in sorted(ks)), F.lit(0)).cast("long").alias("hits")) for (g, o), ks in groups.items()]
    return F.filter(F.array(*hits), lambda x: x["hits"] > 0)


def keyword_groups(docs: DataFrame, keywords) -> DataFrame:
    """(name, grp, ord, hits) of every document, row by row."""
    return docs.select("name", F.inline(keyword_hits(F.col("text"), keywords)))


def classified(docs: DataFrame, keywords, default: str) -> DataFrame:
    """(name, grp): the group with most keywords, the first in order on a tie, the default without any."""
    best = F.array_min(F.transform(keyword_hits(F.col("text"), keywords), lambda x: F.struct((-x["hits"]).alias("few"), x["ord"].alias("ord"), x["grp"].alias("grp"))))
    return docs.select("name", F.coalesce(best["grp"], F.lit(default)).alias("grp"))


def group_links(members: DataFrame, flow: DataFrame, own: int = 2, most: int = 4) -> DataFrame:
    """First links inside the group, then the first of each group that the flow maps it to."""
    ranked = members.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("name")))
    first = ranked.filter(F.col("k") <= own + 1).select("grp", F.col("name").alias("dst"), F.col("k").alias("k"))
    inside = ranked.select(F.col("name").alias("src"), "grp").join(first, "grp").filter("src <> dst").select("src", "dst", F.lit(0).alias("step"), "k")
    inside = inside.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("k"))).filter(F.col("r") <= own).drop("r")
    heads = ranked.filter("k = 1").select(F.col("grp").alias("to_grp"), F.col("name").alias("dst"))
    across = members.select(F.col("name").alias("src"), "grp").join(F.broadcast(flow), "grp").join(heads, "to_grp").select("src", "dst", F.lit(1).alias("step"), F.col("pos").alias("k"))
    order = Window.partitionBy("src").orderBy("step", "k", "dst")
    return inside.union(across).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("src", "dst")


def shared_groups(groups: DataFrame) -> DataFrame:
    """(src, dst) of documents that share any group."""
    a, b = groups.select("grp", F.col("name").alias("src")), groups.select("grp", F.col("name").alias("dst"))
    return a.join(b, "grp").filter("src <> dst").select("src", "dst").distinct()


def shared_group_sets(groups: DataFrame) -> DataFrame:
    """(kind, src, dst): the links of shared_groups without their pairs, which grow with the square of the documents.

    Rows of kind 'member' give each document the set of its groups; rows of kind 'link' join
    sets that share a group, a set with itself too. Two different documents share a group
    exactly if their sets are linked, so nothing is left out.
    """
    pairs = groups.filter("grp is not null").select("name", "grp").distinct()
    members = pairs.groupBy("name").agg(F.sort_array(F.collect_list("grp")).alias("grps"))
    sets = members.select("grps").distinct().withColumn("set", F.array_join("grps", "+"))
    of = sets.select("set", F.explode("grps").alias("grp"))
    links = of.withColumnRenamed("set", "src").join(of.withColumnRenamed("set", "dst"), "grp").select("src", "dst").distinct()
    return members.select(F.lit("member").alias("kind"), F.col("name").alias("src"), F.array_join("grps", "+").alias("dst")).union(links.select(F.lit("link"), "src", "dst"))


def curated(members: DataFrame, listed: DataFrame, flow: DataFrame, own: DataFrame | None = None, two: int = 2) -> DataFrame:
    """(src, dst): all pairs of each listed group, and from every member to `two` of each group that the flow maps its own to.

    Those are the group's first by name, or of its members the first that `own` (name, dst, pos) gives the document.
    Lists, flow and own choices are literal tables, small by definition.
    """
    found = listed.join(members.select("name").distinct(), "name", "left_semi").select("grp", "name").distinct()
    heads = found.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("name"))).filter(F.col("k") <= two).select(F.col("grp").alias("to_grp"), F.col("name").alias("dst"))
    mapped = members.select("name", "grp").join(F.broadcast(flow.select("grp", "to_grp")), "grp").select("name", "to_grp")
    if own is None:
        across = mapped.join(F.broadcast(heads), "to_grp")
    else:
        inside = own.join(found.select(F.col("name").alias("dst"), F.col("grp").alias("to_grp")), "dst")
        chosen = mapped.join(F.broadcast(inside), ["name", "to_grp"]).withColumn("k", F.row_number().over(Window.partitionBy("name", "to_grp").orderBy("pos")))
        plain = mapped.join(F.broadcast(inside.select("name", "to_grp").distinct()), ["name", "to_grp"], "left_anti").join(F.broadcast(heads), "to_grp")
        across = plain.select("name", "dst").union(chosen.filter(F.col("k") <= two).select("name", "dst"))
    return shared_groups(found).union(across.filter("name <> dst").select(F.col("name").alias("src"), "dst")).distinct()
