"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Each word is a row of symbols. Leaf i of the tree holds the rank of the merge of
symbol i with its right neighbour; every inner node holds the minimum of its
children, so the root is the lowest rank, and going down to the left child
whenever it holds that minimum finds the leftmost place. A merge changes at most
three leaves, each in logarithmic time, until no mergeable pair is left.

Null and empty texts give no ids, and rows that repeat are encoded once each. A word of
any length takes time in proportion to it and the logarithm of its length, a text of any
length is encoded word by word. Control characters, texts beyond Latin-1 and
the vocabulary's special tokens inside a text are handled as the tokenizers
library handles them.
"""
from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_texts, map_arrow, worker_cache

#: Bytes of words kept encoded, twice for each of two kinds, in a Python worker: when full, a cache becomes the older half.
#: An entry counts with what Python's objects take besides its letters and ids.
CACHE_BYTES, ENTRY_BYTES = 20 << 20, 190
NO_RANK = 1 << 60
UINT32 = "I"
MAX_VOCABULARY_BYTES = 64 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTree:
    """Minimum segment tree over the ranks of adjacent pairs of one word."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        self.node = [NO_RANK] * size + ranks + [NO_RANK] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a <= b else b

    def lowest(self) -> int:
        """Position of the leftmost lowest rank, or -1."""
        node, low, i = self.node, self.node[1], 1
        if low == NO_RANK:
            return -1
        while i < self.size:
            i *= 2
            if node[i] != low:
                i += 1
        return i - self.size

    def put(self, i: int, rank: int) -> None:
        node = self.node
        i += self.size
        node[i] = rank
        while i > 1:
            i //= 2
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a <= b else b
            if node[i] == low:
                return
            node[i] = low


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges, lowest rank first and leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = (NO_RANK, 0)
    right, left = [*range(1, n), -1], [-1, *range(n - 1)]
    tree = PairTree([ranks.get((symbols[i], symbols[i + 1]), none)[0] for i in range(n - 1)])
    while (i := tree.lowest()) >= 0:
        j = right[i]
        symbols[i] = ranks[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after = right[j]
        right[i] = after
        if j < n - 1:
            tree.put(j, NO_RANK)
        if after >= 0:
            left[after] = i
            tree.put(i, ranks.get((symbols[i], symbols[after]), none)[0])
        else:
            tree.put(i, NO_RANK)
        if (before := left[i]) >= 0:
            tree.put(before, ranks.get((symbols[before], symbols[i]), none)[0])
    return [s for s in symbols if s >= 0]


def merge_scanning(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same merges by scanning the ranks, for callers that only need the ids of short words fast."""
    none = (NO_RANK, 0)
    found = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
    while found:
        low = min(found)
        if low is none or low[0] == NO_RANK:
            break
        i = found.index(low)
        symbols[i : i + 2] = [low[1]]
        del found[i]
        if i:
            found[i - 1] = ranks.get((symbols[i - 1], low[1]), none)
        if i < len(found):
            found[i] = ranks.get((low[1], symbols[i + 1]), none)
    return symbols


class _Words(dict):
    """Ids of words as little-endian bytes; computed at first use, bounded in bytes."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.held, self.older = encode, limit, 0, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.encode(word)
        if len(word) <= 64:
            if self.held >= self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self.held += ENTRY_BYTES + len(word) + len(out)
            self[word] = out
        return out


class WordBpe:
    """Encoder and decoder of a word-level BPE vocabulary (tokenizers JSON).

    Words of up to scan_words symbols are merged by scanning, longer ones by the segment tree.
    """

    def __init__(self, spec: bytes, cache_bytes: int = CACHE_BYTES, scan_words: int = 0):
        self.spec, self.scan_words = spec, scan_words
        data = json.loads(spec)
        model = data["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.stand = byte_symbols()
        self.inner, self.last = [vocab[c] for c in self.stand], [vocab[c + self.end] for c in self.stand]
        self.byte = {c: b for b, c in enumerate(self.stand)}
        kind = lambda k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k)
        blank = re.escape("".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0])))
        letters, digits = kind("L"), kind("N")
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{blank}{letters}{digits}]+")
        self.words = _Words(lambda w: self.word(w.encode()), cache_bytes)
        self.mapped = _Words(lambda w: self.word(bytes([self.byte[c] for c in w])), cache_bytes)
        self.library = None

    def word(self, word: bytes) -> bytes:
        symbols = [self.inner[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        ids = array(UINT32, (merge if len(word) > self.scan_words else merge_scanning)(symbols, self.pairs))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._wide(text)
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower())))

    def _wide(self, text: str) -> bytes:
        # The library's own Unicode tables normalise and split what is beyond Latin-1.
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec.decode())
        text = self.library.normalizer.normalize_str(text)
        return b"".join([self.mapped[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)])

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if "<|" not in text or not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(spec: bytes, scan_words: int = 0, cache_bytes: int = CACHE_BYTES) -> WordBpe:
    """One encoder per Python worker, for one vocabulary at a time."""
    return worker_cache(("bpe", zlib.crc32(spec), scan_words), lambda: WordBpe(spec, cache_bytes, scan_words))


def vocabulary(spark, path: str | None = None):
    """The vocabulary file, read once by the driver and sent to the executors (its size is checked)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        spec = f.read()
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: {len(spec)} bytes are too many to broadcast")
    return spark.sparkContext.broadcast(spec)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<long> and the decoded text of every document."""
    spec = vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = loaded(spec.value)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([np.frombuffer(x, "<u4").astype("i8") for x in ids], pa.list_(pa.int64())), pa.array([bpe.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return map_arrow(doc_texts(docs), run, "doc_id long, ids array<long>, decoded string", cached=True)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, without shipping either."""
    spec = vocabulary(docs.sparkSession, path)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        bpe = loaded(spec.value)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column("text"):
                ids = bpe.encode(text.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids))
                text_sha.append(sha(bpe.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(doc_texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", cached=True)
