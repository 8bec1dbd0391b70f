"""Spelling variants: words of a corpus, those one edit away, and the common form each stands for.

Words that differ by one inserted, deleted or replaced code point share their first or
their last half. So a forward dictionary (words by their first half) and a reversed one
(by their last half) hold each such pair in one block, a range of the sorted dictionary.
A block of more than `BLOCK_WORDS` words is divided: the part in which the edit may lie is
halved, and each half is a finer block whose words share more on either side, until blocks
are small or the edit's place is known, where a block holds at most as many words of a
length as there are letters. A block is scanned in order and its pairs are verified; a pair
counts only in the block that covers the place of its edit, so never twice. A block gives
one row per word, not its pairs.

Null text has no words; a null doc_id is written as nothing where the edits of the data are
drawn. Rows that repeat each count. Texts are read whole. Ties go to the smallest word in
code-point order. Empty tables give no rows, and other columns are never read.
"""
from __future__ import annotations

import string
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged

#: Fewest code points and occurrences of a word, and how many times more often its form has to occur.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: Words of a block beyond which it is divided.
BLOCK_WORDS = 64
RUN = "[A-Za-zÀ-ÿ]"
KEY = ["size", "low", "high", "head", "tail"]


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): letter runs of the texts in lower case, of which every 199th by check sum loses a code point."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{letters},}}"), 0)).alias("run"))
    runs = found.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    drawn = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = drawn.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def member(size: Column, low: Column, high: Column) -> Column:
    """The block of a word, for edits at places low to high of a pair whose shorter word has `size` code points."""
    tail = F.greatest(size - high - 1, F.lit(0))
    return F.struct(size.alias("size"), low.alias("low"), high.alias("high"), F.substring("word", F.lit(1), low).alias("head"), F.right("word", tail).alias("tail"))


def divided(members: DataFrame) -> DataFrame:
    """Members of each half of their blocks."""
    size, low, high = F.col("size"), F.col("low"), F.col("high")
    middle = F.floor((low + high + 1) / 2).cast("int")
    return members.select("word", "n", F.inline(F.array(member(size, low, middle - 1), member(size, middle, high))))


def dictionaries(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """Members of the forward and the reversed dictionary: each word as the shorter or equal one of a pair, and as the longer one."""
    size = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= letters)).alias("size")
    whole = words.select("word", "n", size)
    half = F.floor(F.col("size") / 2).cast("int")
    return whole.select("word", "n", F.inline(F.array(member(F.col("size"), half, F.col("size")), member(F.col("size"), F.lit(0), half - 1))))


def scanned(batches):
    """(word, n_near, most, form) of each word of a block that has near words there; blocks come whole and in order."""

    def near(a: str, b: str, low: int, high: int) -> bool:
        i, n = low, len(a)
        while i < n and a[i] == b[i]:
            i += 1
        return i <= high and (a[i + 1 :] == b[i + 1 :] if len(b) == n else a[i:] == b[i + 1 :])

    def solve(block, words):
        size, low, high = block[:3]
        found: dict[int, list] = {}
        for i, (a, n) in enumerate(words):
            if len(a) != size:
                continue
            for j, (b, m) in enumerate(words):
                if (len(b) > size or j > i) and near(a, b, low, high):
                    found.setdefault(i, []).append((-m, b))
                    found.setdefault(j, []).append((-n, a))
        return [(words[i][0], len(x), -min(x)[0], min(x)[1]) for i, x in found.items()]

    def packed(out):
        c = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "most", "form"])

    block, words = None, []
    for b in batches:
        out = []
        rows = zip(zip(*(b.column(c).to_pylist() for c in KEY)), zip(b.column("word").to_pylist(), b.column("n").to_pylist()))
        for key, part in groupby(rows, lambda r: r[0]):
            if key != block:
                out += solve(block, words) if len(words) > 1 else []
                block, words = key, []
            words += [w for _, w in part]
        if out:
            yield packed(out)
    if len(words) > 1:
        yield packed(solve(block, words))


def near_words(words: DataFrame, letters: int = LETTERS, most: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and of those the one of largest n as (-n, word)."""
    found, members = None, staged(dictionaries(words, letters), "dictionaries")
    while True:
        sizes = staged(members.groupBy(*KEY).agg(F.count("*").alias("m"), F.count_if(F.length("word") == F.col("size")).alias("short")), "blocks")
        # Without a word of the block's own size there is no pair in it.
        large = sizes.filter((F.col("m") > most) & (F.col("short") > 0) & (F.col("low") < F.col("high")))
        small = sizes.filter((F.col("m") > 1) & (F.col("short") > 0) & ((F.col("m") <= most) | (F.col("low") >= F.col("high"))))
        blocks = members.join(small.select(*KEY), KEY).repartition(*KEY).sortWithinPartitions(*KEY, "word")
        pairs = map_arrow(blocks, scanned, "word string, n_near long, most long, form string")
        found = pairs if found is None else found.unionByName(pairs)
        if large.isEmpty():
            break
        members = staged(divided(members.join(large.select(*KEY), KEY)), "dictionaries")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("most")).alias("n"), "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form); a form occurs more often than its word, so chains end."""
    known = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, most: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus."""
    words = staged(vocabulary(docs, letters, occurrences), "words")
    near = words.join(near_words(words, letters, most), "word", "left")
    often = -F.col("best")["n"]
    known = staged(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often >= times * F.col("n"), F.struct(F.col("best")["form"].alias("form"), often.alias("n"))).alias("f")), "forms")
    known = known.select("word", "n", "n_near", F.col("f")["form"].alias("form"), F.col("f")["n"].alias("form_n"))
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
