"""N-gram Jaccard join by MinHash banding.

Documents with equal sets of word n-grams are one node. A node's MinHash signature
is cut into bands; nodes that agree on a band's hash share a bucket. Band and row
counts follow from the threshold and a target recall. Buckets with equal members are
tested once, large ones in blocks of bounded size, and each pair only in the bucket
of the first band it agrees on. The test compares full n-gram sets inside the block;
a block returns one row per linked node (its number of links, its root), never the
pairs. Roots are joined to components by label propagation in tables.

Words are runs of characters other than space and \\t to \\r, compared as they are.
A text of fewer words than n has one n-gram, all its words. Texts without words
(null and empty ones too) have no n-grams and no links. A document is a doc_id with
an n-gram set: rows that repeat both count once, rows that repeat a doc_id with another
text are documents of their own, and so is every row with a null doc_id. Such a row gets
the class of the others in its component; a component of null ids only has a null class.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_BYTES, doc_texts, keyed, map_arrow, staged, without, worker_cache

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Most signature values; more rows in a band mean fewer false candidates and more values.
SIGNATURE = 112
#: Bounds of a block: nodes, and n-grams over all its nodes.
BLOCK_NODES, BLOCK_GRAMS = 256, 500_000
#: Words whose hashes a worker keeps.
HASHED_WORDS = 100_000
WORD = re.compile(r"[^ \t-\r]+")
ROW = "_row struct<file:long,at:long>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, most: int = SIGNATURE) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands reach the recall at the threshold within `most` values."""
    best = (1, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= HASHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def grams(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    words = WORD.findall(text)
    w = np.fromiter(map(worker_cache("words", _Hashes).__getitem__, words), "u8", len(words))
    if not len(w):
        return w
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, k, "u8")
    for i in range(k):
        out = (out ^ w[i : len(w) - k + 1 + i]) * ODD
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, "u8") * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, "u8")
        self.c = rng.integers(1, 1 << 63, rows, "u8") * np.uint64(2) + np.uint64(1)
        self.band = mixed(np.arange(1, bands + 1, dtype="u8"))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key per band."""
        low = np.full(len(self.a), (1 << 64) - 1, "u8")
        for at in range(0, len(hashes), 2048):
            part = mixed(hashes[at : at + 2048, None] * self.a + self.b)
            low = np.minimum(low, part.min(0))
        return mixed((mixed(low).reshape(self.bands, self.rows) * self.c).sum(1) ^ self.band).view("i8")


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Row key, doc_id, digest and size of the n-gram set and band keys of every row of keyed docs."""

    def run(batches):
        sign = Signer(bands, rows)
        for b in batches:
            sets, sizes, keys = [], [], []
            for text in b.column("text"):
                g = grams(text.as_py(), n)
                sets.append(xxhash.xxh3_128_digest(g.tobytes()))
                sizes.append(len(g))
                keys.append(sign(g) if len(g) else None)
            cols = [b.column("_row"), b.column("doc_id"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["_row", "doc_id", "set_id", "n", "keys"])

    return map_arrow(doc_texts(docs), run, f"{ROW}, doc_id long, set_id binary, n int, keys array<long>", cached=True)


def linked(sets: list[np.ndarray], keys: np.ndarray, key: int, side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Symmetric matrix of the pairs of a block that reach the threshold and are this bucket's to test."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    test = np.zeros((m, m), bool)
    for a in range(m):  # a row at a time keeps the comparison of keys small
        same = keys[a + 1 :] == keys[a]
        test[a, a + 1 :] = keys[a][same.argmax(1)] == key
        test[a, a + 1 :] &= same.any(1)
    if side is not None:  # a block of two parts: pairs inside a part belong to that part's own block
        test &= side[:, None] != side[None, :]
    test &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes) - 1e-9
    at, to = np.nonzero(test)
    out = np.zeros((m, m), bool)
    if not len(at):
        return out
    if len(at) <= 64:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(at, to)])
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), sizes)
        often = count[column] > 1
        row, column = row[often], column[often]
        column = (np.cumsum(count > 1) - 1)[column]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((m, m), "f4")
        width = 4096
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, [low, low + width])
            x = np.zeros((m, width), "f4")
            x[row[i:j], column[i:j] - low] = 1
            both += x @ x.T
        shared = both[at, to]
    out[at, to] = shared >= threshold * (sizes[at] + sizes[to] - shared) - 1e-9
    return out | out.T


def block_rows(batches, threshold: float):
    """Links of each block; rows come sorted by (key, i, j, sub, node), so one block is held at a time."""
    columns = ["key", "i", "j", "sub", "node", "mult", "keys", "grams"]

    def solve(block, rows):
        nodes = np.array([r[1] for r in rows])
        links = linked([np.frombuffer(r[4], "u8") for r in rows], np.array([r[3] for r in rows]), block[0], np.array([r[0] for r in rows]) if block[1] != block[2] else None, threshold)
        mult = np.array([r[2] for r in rows])
        root = nodes.copy()
        while len(rows) > 1:
            low = np.minimum(root, np.where(links, root[None, :], np.iinfo("i8").max).min(1))
            if (low == root).all():
                break
            root = low
        some = links.any(1)
        return list(zip(nodes[some].tolist(), root[some].tolist(), (links * mult).sum(1)[some].tolist()))

    def packed(out):
        c = list(zip(*out)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], ["node", "root", "n_links"])

    block, rows, out = None, [], []
    for b in batches:
        for key, i, j, *row in zip(*(b.column(c).to_pylist() for c in columns)):
            if (key, i, j) != block:
                if len(rows) > 1:
                    out += solve(block, rows)
                block, rows = (key, i, j), []
            rows.append(row)
        if out:
            yield packed(out)
            out = []
    if len(rows) > 1:
        yield packed(solve(block, rows))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component of the edges (a, b)."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        step = labels.join(near, "id").select("id", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("to"))
        new = staged(step.join(hop, "label", "left").select("id", F.least("label", F.coalesce("to", "label")).alias("label"), "old"), "labels")
        if new.filter("label < old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def multiplicity(sig: DataFrame) -> DataFrame:
    """(set_id, extra): rows of a set that repeat a doc_id."""
    again = sig.filter("n > 0 and doc_id is not null").groupBy("set_id", "doc_id").agg(F.count("*").alias("c")).filter("c > 1")
    return again.groupBy("set_id").agg(F.sum(F.col("c") - 1).alias("extra"))


def classes(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """_row, doc_id, class_id, n_links and kept (one row of each component) of keyed docs."""
    bands, rows = bands_for(threshold, recall)
    sig = staged(signatures(docs, n, bands, rows), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    nodes = sig.filter("n > 0").groupBy("set_id").agg(first.alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = nodes.join(multiplicity(sig), "set_id", "left").withColumn("mult", F.col("rows") - F.coalesce("extra", F.lit(0))).drop("rows", "extra")
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed_by = nodes.select("node", "set_id", F.col("rep")["_row"].alias("_row"), "n", F.posexplode("keys").alias("band", "key"))
    mark = [F.bit_xor(F.xxhash64("set_id", F.lit(s))).alias(f"x{s}") for s in (1, 2)]
    buckets = keyed_by.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("band").alias("band"), *mark).filter("m > 1")
    buckets = buckets.withColumn("split", F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int"))
    # Of buckets with the same members, that of the first band stays: no other can be the first to hold a pair.
    buckets = buckets.groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("first"), F.first("split").alias("split")).select("first.key", "split")
    tested = staged(keyed_by.select("key", "node", "_row").join(buckets, "key"), "members")
    chosen = staged(tested.select("_row", "node").distinct(), "chosen")
    small = chosen.count() * ROW_BYTES <= BROADCAST_BYTES
    texts = doc_texts(docs).select("_row", "text").join(F.broadcast(chosen) if small else chosen, "_row").select("node", "text")

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([grams(t.as_py(), n).tobytes() for t in b.column("text")], pa.binary())], ["node", "grams"])

    full = map_arrow(texts, sets, "node long, grams binary", cached=True).join(nodes.select("node", "mult", "keys"), "node")
    sub = F.pmod(F.xxhash64("node"), F.col("split")).cast("int")
    blocks = (
        tested.withColumn("sub", sub).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
        .select("key", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "node")
        .join(full, "node").select("key", "i", "j", "sub", "node", "mult", "keys", "grams")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "sub", "node")
    )
    links = staged(map_arrow(blocks, lambda batches: block_rows(batches, threshold), "node long, root long, n_links long"), "links")
    labels = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    best = labels.join(nodes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("best"))
    best = labels.join(best, "label").select("node", "best")
    degree = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = nodes.select("node", "set_id", "rep", "mult").join(degree.join(best, "node"), "node", "left").withColumn("rep", F.coalesce("best", "rep"))
    # As a table, so that the join shuffles both sides and Spark can split a set that many rows share.
    known = staged(known.select("set_id", F.col("rep")["doc_id"].alias("class_id"), F.col("rep")["_row"].alias("keeper"), (F.col("mult") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")), "known")
    found = sig.select("_row", "doc_id", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(known, "set_id", "left")
    alone = F.col("keeper").isNull()
    return found.select(
        "_row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("keeper") == F.col("_row"))).alias("kept"),
    )


def jaccard_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the component) and n_links (other documents at the threshold or above) of every row."""
    return classes(keyed(docs), n, threshold, recall).select("doc_id", "class_id", "n_links")


def kept_rows(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays, with all its columns."""
    source = keyed(docs)
    return without(source, classes(source, n, threshold, recall).filter("not kept"))
