"""Document fingerprints of closed syncmers, by DataFrame functions alone.

A text is read as pieces of up to four code points that begin anew at each word. A k-mer is
K pieces in a row; it is an anchor where the smallest hash of its runs of S pieces is that of
its first or its last one. That depends on nothing outside it, so texts that share a passage
share its anchors, wherever it stands. The text's begin counts as K - 1 pieces of its own, so
that short texts have anchors too. A fingerprint keeps the smallest anchor of each of 128
slots of the hash with its place, `hash@place`; its size is bounded and, below about a
hundred anchors, it holds nearly all of them.

The likeness of two fingerprints is the share of slots, of those that either uses, in which
both hold the same anchor at about the same place: within 16 pieces of the middle one of all
such shifts. Two without any anchor are alike (1).

The next document is the one before in order of doc_id; a null doc_id comes last, rows that
repeat one follow in the order of their text's hash, and equal rows can stand for each other.
The order comes from ranges, so neither a table nor a hot doc_id passes through one task:
each block of rows also holds the first row of the next block. Null text counts as empty,
texts are read whole, an empty table gives no rows, and other columns are never read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, keyed, partitions

#: Pieces of a k-mer and of its inner runs; code points of a piece.
K, S, PIECE = 6, 2, 4
#: Bits of an anchor's hash, of which the first ones are its slot; pieces by which shifts may differ.
HASH_BITS, SLOT_BITS, SHIFT = 40, 7, 16


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def pieces(text: Column) -> Column:
    """The text's begin and its pieces."""
    return F.concat(F.array_repeat(F.lit(""), K - 1), F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), 0))


def run_hash(p: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(p, at + j) for j in range(n)))


def closed(h: Column, at: Column) -> Column:
    """Whether the smallest of a k-mer's inner hashes is the first or the last one."""
    first, last, inner = F.get(h, at), F.get(h, at + (K - S)), [F.get(h, at + j) for j in range(1, K - S)]
    least = lambda edge: reduce(Column.__and__, (edge <= x for x in inner))
    return F.when(first <= last, least(first)).otherwise(least(last))


def anchors(text: Column) -> Column:
    """Array of (hash, at) of the text's closed syncmers; at counts pieces from the first k-mer."""
    def of(p: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(p) - S), lambda i: run_hash(p, i, S))
        at = let(inner, lambda h: F.filter(F.sequence(F.lit(0), F.size(p) - K), lambda i: closed(h, i)))
        some = F.transform(at, lambda i: F.struct(F.shiftrightunsigned(run_hash(p, i, K), 64 - HASH_BITS).alias("hash"), i.alias("at")))
        return F.when(F.size(p) >= K, some)

    return let(pieces(text), of)


def slot(entry: Column) -> Column:
    return F.shiftright(entry["hash"], HASH_BITS - SLOT_BITS)


def sketch(text: Column) -> Column:
    """The smallest anchor of each slot, in order; none for a text without pieces."""
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (slot(x) != slot(F.get(s, i - 1))))
    found = let(F.sort_array(anchors(text)), first)
    return F.coalesce(found, F.array().cast("array<struct<hash:bigint,at:int>>"))


def written(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), HASH_BITS // 4, "0"), F.lit("@"), x["at"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of slots with the same anchor at about the same shift."""
    hashes = lambda e: F.transform(e, lambda x: x["hash"])
    slots = lambda e: F.transform(e, slot)
    places = lambda e, both: F.transform(F.filter(e, lambda x: F.array_contains(both, x["hash"])), lambda x: x["at"])
    # Both are in order of their hash, so the places of what they share stand side by side.
    shifts = let(F.array_intersect(hashes(a), hashes(b)), lambda both: F.sort_array(F.zip_with(places(a, both), places(b, both), lambda x, y: x - y)))
    kept = let(shifts, lambda s: F.size(F.filter(s, lambda x: F.abs(x - F.get(s, F.floor(F.size(s) / 2).cast("int"))) <= SHIFT)))
    either = F.size(F.array_union(slots(a), slots(b)))
    return F.when(either == 0, 1.0).otherwise(kept / either)


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows of (block, order, halo, doc_id, text, next): every document with the text of the next one, and halo rows that only lend theirs."""
    rows = doc_texts(keyed(docs))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.bitwise_not("doc_id").alias("down"), F.xxhash64("text").alias("h"), "_row")
    n = blocks or 3 * partitions(docs.sparkSession)
    dealt = rows.select(order.alias("o")).select("o.*").repartitionByRange(n, "unnamed", "down", "h", "_row")
    heads = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("unnamed", "down", "h", "_row")).alias("head"))
    # One row for each block, whatever the size of the table.
    rows = rows.withColumn("order", order).withColumn("heads", heads.agg(F.sort_array(F.collect_list("head"))).scalar())
    rows = rows.withColumn("block", let(F.col("heads"), lambda hs: let(F.struct(order.alias("o")), lambda x: F.size(F.filter(hs, lambda h: h <= x["o"])) - 1)))
    count, is_head = F.size("heads"), F.get("heads", F.col("block")) == F.col("order")
    lent = F.when(is_head, F.struct(F.pmod(F.col("block") - 1, count).alias("block"), F.lit(True).alias("halo")))
    rows = rows.select("order", "doc_id", "text", F.inline(F.array_compact(F.array(F.struct(F.col("block"), F.lit(False).alias("halo")), lent))))
    return rows.withColumn("next", F.lead("text").over(Window.partitionBy("block").orderBy("halo", "order")))


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    The edited text has its last third replaced by as much of the begin of the next document.
    """
    rows = with_next(docs, blocks)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    both = let(F.struct(edited.alias("t")), lambda x: F.struct(F.sha2(x["t"], 256).alias("sha"), sketch(x["t"]).alias("marks")))
    # Halo rows need no edited text; the next document's marks come with them.
    rows = rows.select("block", "order", "halo", "doc_id", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text")).alias("marks"), F.when(~F.col("halo"), both).alias("edited"))
    rows = rows.withColumn("following", F.lead("marks").over(Window.partitionBy("block").orderBy("halo", "order"))).filter("not halo")
    return rows.select(
        "doc_id", "n_chars", F.col("edited")["sha"].alias("edited_sha256"), written(F.col("marks")).alias("fingerprint"), written(F.col("edited")["marks"]).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited")["marks"]).alias("near_edited"), likeness(F.col("marks"), F.col("following")).alias("near_next"),
    )
