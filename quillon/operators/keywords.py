"""Many keywords at once: an Aho-Corasick automaton built from a keyword table, run over each text in one pass.

The plan's size does not depend on the number of keywords. The table is split by hash into parts of about
PART_BYTES; a part's automaton is broadcast (at most 257 cells of four bytes for each byte of its keywords),
and a table of any size takes as many passes over the texts as it has parts.
"""
from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import bound_batches

#: Bytes of keywords in one automaton, about.
PART_BYTES = 131_072
#: Longest keyword in bytes; a longer one is an error.
KEYWORD_BYTES = 4096
#: Texts are cut into lanes of so many bytes, each with the bytes before it that a keyword can reach back.
LANE = 512
#: Bytes of text scanned side by side, and matches held before repeated ones go.
GROUP_BYTES, PENDING = 1 << 21, 1 << 18


class Automaton:
    """Transitions between prefixes of the keywords, over the bytes of UTF-8."""

    def __init__(self, keywords: list[str]):
        coded = [k.encode() for k in keywords]
        used = sorted(set(b"".join(coded)))
        self.byte_class = np.zeros(256, np.uint16)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends = {}
        for number, word in enumerate(coded):
            at = 0
            for c in self.byte_class[list(word)].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                at = children[at][c]
            ends[at] = number
        size = len(children)
        self.next = np.zeros((size, len(used) + 1), np.int32)
        self.word = np.full(size, -1, np.int32)  # the keyword that ends at a state
        self.shorter = np.zeros(size, np.int32)  # the longest proper suffix at which one ends, 0 for none
        suffix = [0] * size
        queue = deque([0])
        while queue:
            at = queue.popleft()
            back = suffix[at]
            self.word[at] = ends.get(at, -1)
            if at:
                self.next[at] = self.next[back]
                self.shorter[at] = back if self.word[back] >= 0 else self.shorter[back]
            for c, child in children[at].items():
                suffix[child] = int(self.next[back, c]) if at else 0
                self.next[at, c] = child
                queue.append(child)
        self.emits = (self.word >= 0) | (self.shorter > 0)
        self.reach = max(map(len, coded), default=1) - 1

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, keyword number) of each keyword that stands in each text, once."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        classes = self.byte_class[np.frombuffer(b"".join(texts), np.uint8)]  # two bytes for one of text
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        offset = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        start = (ends - sizes)[text]
        begin = start + np.maximum(offset - self.reach, 0)
        length = np.minimum(start + offset + LANE, ends[text]) - begin
        order = np.argsort(-length, kind="stable")  # lanes that go on longest come first
        text, begin, length = text[order], begin[order], length[order]
        still = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        state = np.zeros(len(text), np.int32)
        width, found, pending = len(self.word), [], 0
        for step, active in enumerate(still.tolist()):
            now = self.next[state[:active], classes[begin[:active] + step]]
            state[:active] = now
            hit = np.flatnonzero(self.emits[now])
            if len(hit):
                found.append(text[hit] * width + now[hit])
                pending += len(hit)
                if pending > PENDING:
                    found = [np.unique(np.concatenate(found))]
                    pending = 0
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        text, state, out = pairs // width, pairs % width, []
        while len(state):
            ended = self.word[state] >= 0
            out.append(text[ended] * width + self.word[state[ended]])
            state = self.shorter[state]
            text, state = text[state > 0], state[state > 0]
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pairs // width, pairs % width


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about GROUP_BYTES together."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > GROUP_BYTES:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _parts(table: DataFrame) -> Iterator[tuple[Automaton, list]]:
    """Automata of the keywords of a table (keyword, ...) of distinct rows, each with its rows in order; all rows of a keyword are in one part."""
    weight = F.octet_length("keyword") + sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns if c != "keyword"), F.lit(0))
    total, longest = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(F.octet_length("keyword")), F.lit(0))).first()
    if longest > KEYWORD_BYTES:
        raise ValueError(f"a keyword has {longest} bytes, more than {KEYWORD_BYTES}")
    parts = math.ceil(total / PART_BYTES)
    for part in range(parts):
        rows = table.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part).collect()
        if rows:
            words = sorted({r["keyword"] for r in rows})
            number = {w: i for i, w in enumerate(words)}
            yield Automaton(words), sorted(((number[r["keyword"]], r) for r in rows), key=lambda x: x[0])


def _lowered(keywords: DataFrame, *columns: str) -> DataFrame:
    return keywords.select(*columns, F.lower("keyword").alias("keyword")).filter("keyword <> ''").distinct()


def _scanned(docs: DataFrame, shared: list, schema: str, answer) -> DataFrame:
    """For each part, what `answer` (names, text numbers, keyword numbers, part) makes of the matches, text by text."""
    texts = docs.select("name", F.lower("text").alias("text")).filter("text <> ''")
    bound_batches(docs.sparkSession)

    def searcher(part):
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton, more = part.value
            for rows in batches:
                names, texts = rows["name"].to_numpy(), rows.pop("text").to_list()
                for begin, end in _groups([len(t.encode("utf-8", "surrogatepass")) for t in texts]):
                    yield answer(names[begin:end], *automaton.search([t.encode("utf-8", "surrogatepass") for t in texts[begin:end]]), more)

        return search

    out = docs.sparkSession.createDataFrame([], schema)
    for part in shared:
        out = out.union(texts.mapInPandas(searcher(part), schema))
    return out


def matches(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(name, keyword): each keyword that stands anywhere in a document's text, once for each row of docs.

    docs has (name, text), keywords has (keyword); both are compared in lower case. Null and empty keywords
    stand nowhere, repeated ones are one, null texts hold none. Other columns are ignored. A keyword of over
    KEYWORD_BYTES is an error.
    """
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast((automaton, np.array([r["keyword"] for _, r in rows], object))) for automaton, rows in _parts(_lowered(keywords))]

    def answer(names, text, word, held):
        return pd.DataFrame({"name": names[text], "keyword": held[word]})

    return _scanned(docs, shared, f"name {docs.schema['name'].dataType.simpleString()}, keyword string", answer)


def groups(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(name, grp, ord, hits): groups of which keywords stand in the document, and how many; keywords has (grp, ord, keyword).

    A keyword may belong to several groups and counts once for each row of docs in each of them; rows with the same
    name are added up. Counting is done where the text is, so only a row for each document and group is shuffled.
    """
    context, shared = docs.sparkSession.sparkContext, []
    for automaton, rows in _parts(_lowered(keywords, "grp", "ord")):
        known = {(r["grp"], r["ord"]): None for _, r in rows}
        number = {g: i for i, g in enumerate(known)}
        of = np.array([number[r["grp"], r["ord"]] for _, r in rows])
        begin = np.searchsorted([w for w, _ in rows], np.arange(rows[-1][0] + 2))
        shared.append(context.broadcast((automaton, (begin, of, np.array([g for g, _ in known], object), np.array([o for _, o in known], object)))))

    def answer(names, text, word, more):
        begin, of, group, order = more
        n = begin[word + 1] - begin[word]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[word], n)
        pair, hits = np.unique(np.repeat(text, n) * len(group) + of[each], return_counts=True)
        return pd.DataFrame({"name": names[pair // len(group)], "grp": group[pair % len(group)], "ord": order[pair % len(group)], "hits": hits})

    kinds = ((docs, "name"), (keywords, "grp"), (keywords, "ord"))
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in kinds) + ", hits long"
    return _scanned(docs, shared, schema, answer).groupBy("name", "grp", "ord").agg(F.sum("hits").alias("hits"))


def classified(docs: DataFrame, keywords: DataFrame, default: str) -> DataFrame:
    """(name, grp): the group with most keywords, the first in order (then by name) on a tie, the default without any."""
    best = groups(docs, keywords).groupBy("name").agg(F.min(F.struct((-F.col("hits")).alias("few"), "ord", "grp")).alias("best"))
    return docs.select("name").join(best, "name", "left").select("name", F.coalesce("best.grp", F.lit(default)).alias("grp"))
