"""Personal data by offset-preserving deobfuscation.

Base detectors read the text as it is. Where a text holds homoglyphs, spelled-out
digits, letters in the place of digits, or disguised at and dot signs, a transducer
rewrites it and keeps, for each character it emits, the span of source characters that
it stands for. The detectors read the rewritten text as well; what they find is mapped
back to source spans and added unless a base span of the kind holds all of it. Base
spans always stay, so an identifier of which a part is plain has its plain part and the
whole; redacting joins what overlaps.

Detectors work in linear time on any text. Null and empty texts have no spans. Each row
is judged by its own text, repeated rows alike. Offsets are code points, ends exclusive.
"""
from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, map_arrow

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Cyrillic, Greek and other letters that look like Latin ones, then signs that look like ASCII ones.
HOMOGLYPHS = dict(zip("авесіјкмнорѕтухԁԛԝһӏѵАВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινρυκɡı", "abecijkmhopstyxdqwhlvABESIJKMHOPCTYXABEZHIKMNOPTYXaoivpukgi"))
HOMOGLYPHS |= dict(zip("\u2024\u3002\uff61\ufe52\ufe6b\u2010\u2011\u2012\u2013\u2212\u00a0\u2009\u202f", "....@-----   "))
# Spelled digits of English, German, French and Spanish.
SPELLED = {
    w: str(d)
    for row in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(row.split())
}
AT = r"at|arroba|arobase|chez"
DOT = r"dot|punkt|point|punto"
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
SIGN_AT = rf"(?:[ \t]*{OPEN}[ \t]*(?:{AT}|@)[ \t]*{CLOSE}[ \t]*|_(?:{AT})_|[ \t]+-(?:{AT})-[ \t]+|&(?:#0*64|#x0*40|commat);)"
SIGN_DOT = rf"(?:[ \t]*{OPEN}[ \t]*(?:{DOT}|\.)[ \t]*{CLOSE}[ \t]*|_(?:{DOT})_|[ \t]+-(?:{DOT})-[ \t]+|&(?:#0*46|#x0*2e|period);)"
BARE_AT, BARE_DOT = rf"[ \t]+(?:{AT})[ \t]+", rf"[ \t]+(?:{DOT})[ \t]+"
#: What a bare word for "dot" after a whole plain address has to be followed by, to go on with it.
ENDINGS = r"[ \t]+(?:dot|punkt|point|punto)[ \t]+(?:com|org|net|edu|gov|info|eu|de|fr|es|uk|br|io)(?![a-z0-9-])"
NAME = r"[a-z0-9_%+-]{1,64}"
HOST = r"[a-z0-9-]{1,63}"
_MORE = rf"(?:(?:\.|{SIGN_DOT}|{BARE_DOT}){HOST})"
#: An address whose at sign, or whose dots, are disguised. A bare word for "at" needs a disguised dot after it, and
#: beside a plain at sign only the bare word "dot" joins names, so that prose before an address stays out of it.
ADDRESS = re.compile(
    rf"(?<![a-z0-9._%+-]){NAME}(?:"
    rf"(?:(?:\.|{SIGN_DOT}|[ \t]+dot[ \t]+){NAME}){{0,4}}@{HOST}(?:(?:{SIGN_DOT}|{BARE_DOT}){HOST}{_MORE}*|(?:\.{HOST})+(?:{SIGN_DOT}{HOST}|{ENDINGS})*)"
    rf"|(?:(?:\.|{SIGN_DOT}|{BARE_DOT}){NAME}){{0,4}}(?:{SIGN_AT}{HOST}{_MORE}+|{BARE_AT}{HOST}(?:\.{HOST}){{0,4}}(?:{SIGN_DOT}|{BARE_DOT}){HOST}{_MORE}*))",
    re.I,
)
ANY_AT, ANY_DOT = re.compile(rf"{SIGN_AT}|{BARE_AT}", re.I), re.compile(rf"{SIGN_DOT}|{BARE_DOT}", re.I)
#: Four groups of digits between which dots are disguised.
DOTTED = re.compile(rf"(?<![\w.])[0-9]{{1,3}}+(?:(?:\.|{SIGN_DOT}|{BARE_DOT})[0-9]{{1,3}}+){{3}}(?!\w)", re.I)
_D = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Four or more digits in a row of which two or more are spelled.
DIGIT_RUN = re.compile(rf"(?<!\w)(?:plus[ \t]+)?(?:{_D}|[0-9]+)(?:(?:[ \t]*[-,.][ \t]*|[ \t]+|{SIGN_DOT}|{BARE_DOT})(?:{_D}|[0-9]+)){{3,}}(?!\w)", re.I)
DIGIT_PART = re.compile(rf"(?P<word>{_D})|(?P<plus>plus[ \t]+)|(?P<dot>{SIGN_DOT}|{BARE_DOT})|(?P<gap>(?:[ \t]*[-,][ \t]*|[ \t]+))", re.I)
#: What a text with disguises holds; the others take only the base detectors.
WORDY = re.compile(rf"{OPEN}[ \t]*(?:{AT}|{DOT}|[@.])[ \t]*{CLOSE}|_(?:{AT})_|[ \t_](?:{DOT})[ \t_]|-(?:{AT}|{DOT})-|&(?:#0*(?:64|46)|#x0*(?:40|2e)|commat|period);", re.I)
#: Characters that may stand for others, invisible ones, and decimal digits of any script.
ODD = re.compile("[" + re.escape("".join(HOMOGLYPHS)) + "\uff01-\uff5e\U0001d400-\U0001d7ff\xad\u200b-\u200d\u2060\ufeff]|(?![0-9])\\d")
#: Letters that stand among digits for 0 and 1, the runs in which they may, and what a text with such runs holds.
LETTERS = str.maketrans("OoIl", "0011")
LETTERED, LETTERED_RUN, LETTERED_WORD = re.compile(r"[0-9][OoIl]|[OoIl][0-9]|\.[Oo]\."), re.compile(r"[0-9OoIl .()+-]{7,}+"), re.compile(r"[0-9OoIl]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping addresses: the run before each at sign, then the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def detect(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    out = [("email", i, j) for i, j in emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


class Tape:
    """Text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in rising order, by texts; what is emitted stands for the whole span."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        parts, starts, ends, at = [], [], [], 0
        for i, j, new in edits:
            parts += [self.text[at:i], new]
            starts += self.starts[at:i] + [self.starts[i]] * len(new)
            ends += self.ends[at:i] + [self.ends[j - 1]] * len(new)
            at = j
        self.text = "".join([*parts, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]


def plain_letter(c: str) -> str | None:
    """What a homoglyph stands for; the empty string for invisible characters, None for others."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    code = ord(c)
    if 0xFF01 <= code <= 0xFF5E:  # full width
        return chr(code - 0xFEE0)
    if 0x1D400 <= code <= 0x1D7FF:  # mathematical letters
        plain = unicodedata.normalize("NFKC", c)
        return plain if plain.isascii() else None
    return "" if code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF) else None


def normalise(text: str) -> Tape:
    """Homoglyphs, then disguised at and dot signs inside addresses of both kinds, then spelled digits."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(m.start(), m.end(), p) for m in ODD.finditer(text) if (p := plain_letter(m[0])) is not None])
    if WORDY.search(tape.text):
        edits = []
        for m in ADDRESS.finditer(tape.text):
            found = [(m.start() + x.start(), m.start() + x.end(), sign) for pattern, sign in ((ANY_AT, "@"), (ANY_DOT, ".")) for x in pattern.finditer(m[0])]
            edits += sorted(found)
        tape.rewrite(edits)
        tape.rewrite([(m.start() + x.start(), m.start() + x.end(), ".") for m in DOTTED.finditer(tape.text) for x in ANY_DOT.finditer(m[0])])
    edits = []
    for m in DIGIT_RUN.finditer(tape.text):
        found, spelled = [], 0
        for x in DIGIT_PART.finditer(m[0]):
            new = SPELLED[x["word"].lower()] if x["word"] else "+" if x["plus"] else "." if x["dot"] else ""
            spelled += bool(x["word"])
            found.append((m.start() + x.start(), m.start() + x.end(), new))
        if spelled >= 2:
            edits += found
    tape.rewrite(edits)
    if LETTERED.search(tape.text):
        tape.rewrite([x for m in LETTERED_RUN.finditer(tape.text) for x in lettered(tape.text, m.start(), m.end())])
    return tape


def lettered(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Edits for letters in the place of digits in a run: in words that hold a digit, or that stand between dots."""
    words = [m for m in LETTERED_WORD.finditer(text, start, end) if not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum())]
    out = []
    for m in words:
        dotted = len(m[0]) <= 3 and "." in (text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])
        if not m[0].isdigit() and (dotted or DIGIT.search(m[0])):
            out.append((m.start(), m.end(), m[0].translate(LETTERS)))
    n_digits = sum(len(DIGIT.findall(m[0])) for m in words)
    changed = [(i + k, i + k + 1, new) for i, j, word in out for k, (old, new) in enumerate(zip(text[i:j], word)) if old != new]
    return changed if len(changed) <= n_digits else []


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind as listed, then start."""
    base = detect(text)
    tape = normalise(text)
    if tape.starts is None:
        return base, base
    rank = KINDS.index
    plain = [(rank(k), i, j) for k, i, j in base]  # in order, so the one base span that may hold another is next to it
    every = {*plain}
    for k, i, j in detect(tape.text):
        x = (rank(k), tape.starts[i], tape.ends[j - 1])
        at = bisect_right(plain, (x[0], x[1], len(text))) - 1
        if at < 0 or plain[at][0] != x[0] or plain[at][2] < x[2]:
            every.add(x)
    return base, [(KINDS[k], i, j) for k, i, j in sorted(every)]


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{i}:{j}" for k, i, j in found])


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    parts, at = [], 0
    for i, j, k in sorted((i, j, k) for k, i, j in found):
        if i >= at:
            parts += [text[at:i], f"[{k.upper()}]"]
        at = max(at, j)
    return "".join([*parts, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans and their number."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column("text"):
                base, found = spans(text.as_py())
                rows.append([*(sum(x[0] == k for x in base) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found), len(found)])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return map_arrow(doc_texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text, n_chars to match; other columns as they were."""

    def run(batches):
        for b in batches:
            text = [None if t is None else redact(t, spans(t)[1]) for t in b.column("text").to_pylist()]
            put = {"text": pa.array(text, pa.string())}
            if "n_chars" in b.schema.names:
                put["n_chars"] = pa.array([None if t is None else len(t) for t in text], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([put.get(c, b.column(c)) for c in b.schema.names], b.schema.names)

    return map_arrow(docs, run, docs.schema)
