"""Repeated passages by content-defined chunking with a gear rolling hash.

A cut falls where the rolling hash of the last 32 characters has enough zero bits,
so an insertion moves the cuts near it and no others. Chunks are compared by a
64-bit digest over all documents; a passage counts as repeated where two or more
chunks in a row, of MIN_CHARS characters together, also stand in another document
(with `inside`, also elsewhere in the same one). The ends of a passage lie inside the
chunks beside the run: with those it has to span MIN_WORDS words, unless the run alone
has LONG_CHARS characters (text without spaces). Single digests may collide; runs of
chunks that all collide do not occur.

Null and empty texts have no chunks. Offsets are code points, ends exclusive. Every
row is a document of its own, whatever its doc_id: rows that repeat a doc_id, or have
none, share passages like any others.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, keyed, map_arrow, restored, staged

#: Chunk sizes in characters: none below LEAST but the last; from USUAL on, cuts come more easily; none above MOST,
#: where the lowest hash decides.
LEAST, USUAL, MOST = 16, 32, 128
#: Zero bits that a cut needs before and after USUAL.
HARD_BITS, EASY_BITS = 6, 3
#: What a run of repeated chunks needs, for passages of over 50 words: characters, words with the chunks beside it,
#: and the characters that do without those words.
MIN_CHARS, MIN_WORDS, LONG_CHARS = 60, 40, 320
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 1 << 16, "u4")


def rolling(points: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 characters that end at each position, by doubling the window."""
    h = GEAR[(points ^ (points >> np.uint32(16))) & np.uint32(0xFFFF)]
    for k in (1, 2, 4, 8, 16):
        wide = h.copy()
        wide[k:] += h[:-k] << np.uint32(k)
        h = wide
    return h


def forced(h: np.ndarray, last: int) -> int:
    """The cut where no hash has enough zero bits: at the lowest hash, so periodic text is cut in phase."""
    return last + LEAST + int(h[last + LEAST - 1 : last + MOST].argmin())


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(text)
    if not n:
        return []
    h = rolling(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    at = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    hard = (h[at] >> np.uint32(32 - HARD_BITS) == 0).tolist()
    out, last = [], 0
    for p, sure in zip((at + 1).tolist(), hard):
        while p - last > MOST:
            last = forced(h, last)
            out.append(last)
        if p - last >= USUAL or sure and p - last >= LEAST:
            out.append(p)
            last = p
    while n - last > MOST:
        last = forced(h, last)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def words_before(text: str, ends: list[int]) -> np.ndarray:
    """Words that begin before each of the ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = np.append(True, (points == 32) | (points - np.uint32(9) < 5))
    return np.cumsum(blank[:-1] & ~blank[1:], dtype="i4")[np.array(ends, "i8") - 1]


def chunk_table(docs: DataFrame) -> DataFrame:
    """_row, doc_id, ends array<int>, words array<int> (those that begin before each end), digests array<long>."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            ends, words, found = [], [], []
            for text in b.column("text"):
                text = text.as_py()
                e = cuts(text)
                ends.append(e)
                words.append(words_before(text, e))
                found.append(np.fromiter((digest(text[i:j]) for i, j in zip([0, *e], e)), "u8", len(e)).view("i8"))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), pa.array(ends, ints), pa.array(words, ints), pa.array(found, pa.list_(pa.int64()))], ["_row", "doc_id", "ends", "words", "digests"])

    return map_arrow(doc_texts(docs), run, "_row struct<file:long,at:long>, doc_id long, ends array<int>, words array<int>, digests array<long>")


def chunked(source: DataFrame) -> DataFrame:
    """The chunk table of keyed docs, staged, with a short number for each row."""
    return staged(chunk_table(source).withColumn("row", F.monotonically_increasing_id()), "chunks")


def passages(table: DataFrame, min_chars: int, min_words: int, inside: bool) -> DataFrame:
    """Repeated passages of a staged chunk table: row, doc_id, start, end, n_chunks, first_doc_id, stays and the parts that stood before."""
    k = F.col("k")
    # Places as one number: the character, then the words up to the chunk before or after; both rise along a text.
    place = lambda at, words: F.shiftleft(F.coalesce(at, F.lit(0)).cast("long"), 32) + F.coalesce(words, F.lit(0))
    start, end = place(F.get("ends", k - 1), F.get("words", k - 2)), place(F.get("ends", k), F.get("words", F.least(k + 1, F.size("words") - 1)))
    one = table.select("row", "doc_id", F.posexplode("digests").alias("k", "digest"), "ends", "words").select("row", "doc_id", "k", "digest", start.alias("start"), end.alias("end"))
    places = table.select("row", "doc_id", F.posexplode("digests").alias("k", "digest")).groupBy("digest")
    # The first place is that of the smallest doc_id, then row, then place in the text.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "k")).alias("first")
    shared = places.agg(first, F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("places"))
    shared = shared.filter("places > 1" if inside else "low < high").select("digest", "first")
    shared = staged(shared, "shared")  # as a table, so that the join shuffles both sides and Spark can split a common digest
    own = (F.col("first")["row"] == F.col("row")) & (F.col("first")["k"] == k)
    again = one.join(shared, "digest").select("row", "doc_id", "k", "start", "end", F.col("first")["doc_id"].alias("first_doc_id"), own.alias("own"))
    by_row = Window.partitionBy("row").orderBy("k")
    runs = again.withColumn("run", k - F.row_number().over(by_row))
    char, word = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    copied = F.sort_array(F.collect_list(F.when(~F.col("own"), F.struct(char(F.col("start")).alias("start"), char(F.col("end")).alias("end")))))
    runs = runs.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"), copied.alias("copied"))
    runs = runs.withColumn("words", word("end") - word("start") + 1).withColumns({"start": char(F.col("start")), "end": char(F.col("end"))})
    long = F.col("end") - F.col("start")
    found = runs.filter((F.col("n_chunks") > 1) & (long >= min_chars) & ((F.col("words") >= min_words) | (long >= LONG_CHARS)))
    return found.select("row", "doc_id", "start", "end", "n_chunks", "first_doc_id", (F.size("copied") == 0).alias("stays"), "copied")


def repeated_passages(docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, inside: bool = False) -> DataFrame:
    """doc_id, start, end, n_chunks, first_doc_id (the smallest that has a chunk of it) and stays: one row for each repeated passage of each row.

    stays: all of the passage stands here for the first time. With inside, passages that stand twice within one
    text count as well.
    """
    return passages(chunked(keyed(docs)), min_chars, min_words, inside).drop("row", "copied")


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, inside: bool = True) -> DataFrame:
    """docs without what repeated passages copy: of each chunk of them the first place stays, by doc_id, row and place.

    The other columns stay as they are, as do texts without repeats. What is left of a text keeps its order.
    """
    source = keyed(docs)
    table = chunked(source)
    found = passages(table, min_chars, min_words, inside).filter("not stays").groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("copied"))).alias("_cuts"))
    cuts_of = staged(table.select("row", "_row").join(found, "row").drop("row"), "cuts")
    kept = F.transform(  # from each cut's end to the next one's start
        F.sequence(F.lit(0), F.size("_cuts")),
        lambda i: F.substring("text", F.coalesce(F.get("_cuts", i - 1)["end"], F.lit(0)) + 1, F.coalesce(F.get("_cuts", i)["start"], F.length("text")) - F.coalesce(F.get("_cuts", i - 1)["end"], F.lit(0))),
    )
    text = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    return restored(source.join(cuts_of, "_row", "left").select("_row", *(text.alias(c) if c == "text" else c for c in source.columns if c != "_row")))
