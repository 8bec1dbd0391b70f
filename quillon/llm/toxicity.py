"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over hashed
features of its words (the word and its beginnings); the document's score is the
noisy-or of its sentences, 1 - prod(1 - p). Only document labels are needed: the
gradient of their likelihood through the noisy-or finds the sentences that carry
them, and scoring locates those sentences again.

Labels, language, source and doc_id are never inputs of a score. The weights are
fitted on a bounded sample of labelled rows (TOXIC_ROWS and CLEAN_ROWS, in the order
of a hash, of together at most SAMPLE_CHARS characters); every document is scored, over
its whole text. Null and empty texts get the score of an empty bag, 0. Labels that are
null are not used; of repeated labels of a document the highest counts. Rows that repeat
a doc_id and a text are one row of the sample, and are scored alike.
"""
from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, map_arrow

#: Bounds of the sample that the weights are fitted on.
TOXIC_ROWS, CLEAN_ROWS = 2000, 4000
#: Characters of the sample that the driver reads at most: the rest of the sample's rows are left out.
SAMPLE_CHARS = 64_000_000
#: Of the fit; steps, shrinking, and how often and how much likelier in toxic documents a feature has to be were chosen by
#: cross-validation on labels for learning.
BITS, STEPS, RATE, SHRINK, LEAST_DOCS, LEAST_LIFT = 18, 400, 0.2, 0.001, 6, 5.0
CUT = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
EDGE = " \t\r\x0b\x0c\"'()[]{},;:|*%$#&-_"


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings of 4 to 6 characters."""
    word = word.strip(EDGE).lower()
    if not word:
        return []
    found = [f"={word}", *(f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in found]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(texts: list[str], labels: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Feature weights and bias; share is the share of toxic rows among all labelled rows."""
    vocab: dict[str, int] = {}
    words, sentence, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for part in SENTENCE.findall(text):
            found = [vocab.setdefault(w, len(vocab)) for w in set(part.split())]
            if found:
                sentence.extend([len(doc)] * len(found))
                words.extend(found)
                doc.append(d)
    if not doc:
        return np.zeros(1 << BITS, "f4"), -30.0
    words, sentence, doc = (np.frombuffer(x, "i4") for x in (words, sentence, doc))
    features = np.full((len(vocab), 4), 1 << BITS, "i4")  # padded with a value beyond the last feature
    for w, i in vocab.items():
        features[i, : len(f)] = (f := word_features(w))
    del vocab
    y = labels.astype(bool)
    docs_with = np.zeros((2, (1 << BITS) + 1), "i4")
    ends = np.searchsorted(doc[sentence], np.arange(len(y) + 1))
    for d, (i, j) in enumerate(zip(ends, ends[1:])):
        docs_with[int(y[d]), np.unique(features[words[i:j]])] += 1
    # Features of fewer than LEAST_DOCS documents would only be learnt by heart. Weights are not
    # negative: a feature that clean documents have as often could only end at 0.
    useful = (docs_with.sum(0) >= LEAST_DOCS) & (docs_with[1] * max(1, (~y).sum()) > LEAST_LIFT * docs_with[0] * max(1, y.sum()))
    useful[-1] = False
    n_words = len(features)
    owner, slot = np.nonzero(useful[features])
    feature = features[owner, slot]
    del features
    used, feature = np.unique(feature, return_inverse=True)
    told = np.isin(words, owner)
    words, sentence = words[told], sentence[told]
    seen = max(1e-6, y.mean())
    weight = np.where(y, share / seen, (1 - share) / max(1e-6, 1 - seen)) / len(y)
    w, bias = np.zeros(len(used)), np.full(1, -9.0)
    moments = [np.zeros((2, len(used))), np.zeros((2, 1))]
    for step in range(1, STEPS + 1):
        by_word = np.bincount(owner, w[feature], n_words)
        z = bias[0] + np.bincount(sentence, by_word[words], len(doc))
        total = np.bincount(doc, softplus(z), len(y))
        slope = np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * weight
        gz = slope[doc] / (1 + np.exp(-np.clip(z, -50, 50)))
        gw = np.bincount(words, gz[sentence], n_words)
        for x, g, m in ((w, np.bincount(feature, gw[owner], len(used)), moments[0]), (bias, np.array([gz.sum()]), moments[1])):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        # Words only ever add evidence, and faint ones none, so that many ordinary words do not add up.
        np.maximum(w - SHRINK, 0, out=w)
    weights = np.zeros(1 << BITS, "f4")
    weights[used] = w
    return weights, float(bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of the bounded sample, and the share of toxic rows among all labels for learning.

    What reaches the driver is bounded in rows and characters, however often a doc_id repeats.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    n = {bool(r[0]): r[1] for r in known.groupBy(F.col("toxic") > 0).count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = known.filter("toxic > 0").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.filter("toxic <= 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = doc_texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text", F.length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    keys = rows.select("doc_id", "toxic", "size", "sha").distinct()
    order += ["size", "sha"]
    chosen = keys.filter("toxic > 0").orderBy(*order).limit(TOXIC_ROWS).collect() + keys.filter("toxic <= 0").orderBy(*order).limit(CLEAN_ROWS).collect()
    # Sums of lengths keep what reaches the driver below SAMPLE_CHARS; rows that do not fit are passed over.
    total, kept = 0, []
    for r in sorted(chosen, key=lambda r: (r["doc_id"] * 0x9E3779B1 % (1 << 32), r["doc_id"], r["size"], r["sha"])):
        if total + r["size"] <= SAMPLE_CHARS:
            total += r["size"]
            kept.append((r["doc_id"], r["sha"]))
    if not kept:
        return [], np.zeros(0, bool), 0.0
    wanted = docs.sparkSession.createDataFrame(kept, "doc_id long, sha string")
    got = rows.join(F.broadcast(wanted), ["doc_id", "sha"]).groupBy("doc_id", "sha").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in got.collect())
    return [t for _, t, _ in got], np.array([y > 0 for _, _, y in got], bool), n.get(True, 0) / max(1, sum(n.values()))


#: Words whose weights a worker keeps, twice: when full, the cache becomes the older half.
CACHED_WORDS = 80_000


class _Weights(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.older = weights, {}

    def __missing__(self, word: str) -> float:
        found = self.older.get(word)
        if found is None:
            found = float(self.weights[word_features(word)].sum())
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.bias, self.words = bias, _Weights(weights)

    def __call__(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the text and its sentences (start, end, score) at 0.5 or more."""
        get, spans, z = self.words.__getitem__, [], []
        for m in SENTENCE.finditer(text):
            if found := set(m[0].split()):
                z.append(self.bias + sum(map(get, found)))
                if z[-1] >= 0:
                    spans.append((m.start(), m.end(), float(1 / (1 + np.exp(-z[-1])))))
        return float(-np.expm1(-softplus(np.array(z)).sum())) if z else 0.0, spans


def fitted(docs: DataFrame, labels: DataFrame):
    """Broadcast weights and bias of the bounded sample, 1 MB."""
    texts, y, share = labelled_sample(docs, labels)
    return docs.sparkSession.sparkContext.broadcast(fit(texts, y, share) if len(y) else (np.zeros(1 << BITS, "f4"), -30.0))


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that toxicity_scores marks; each row is judged by its own text, whatever its doc_id."""
    model = fitted(docs, labels)

    def run(batches):
        score = Scorer(*model.value)
        for b in batches:
            yield b.filter(pa.array([score(t.as_py() or "")[0] < CUT for t in b.column("text")], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document."""
    model = fitted(docs, labels)

    def run(batches):
        score = Scorer(*model.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            found = [score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([[{"start": i, "end": j, "score": p} for i, j, p in x] for _, x in found], kind)], ["doc_id", "score", "offending"])

    out = map_arrow(doc_texts(docs), run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "offending")
