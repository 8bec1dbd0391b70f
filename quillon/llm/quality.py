"""Quality rules: a threshold table compiled into one Spark projection.

All measures are built-in expressions over the row's own text: no user functions and
no shuffle. A rule names a ratio and the range that it has to stay in; the verdict is
the conjunction of all rules. Word windows are compared word by word where their 64-bit
hashes within the text agree; stop words are known in any case. Repeated rows are judged
alike. Null text counts as empty; a text without words fails the base rule and every
ratio of it is 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BASE_WORDS, BASE_REPEATS = 50, 50
#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was with as be on at by this are or from "
    "der die und das den von zu mit ist nicht ein eine für auf sich dem des im als auch "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec "
    "el y los del se las por con no para su al lo como más o pero sus"
).split()
#: (rule, ratio, least, most); None leaves that side open.
RULES = (
    ("word length", "mean_word_chars", 2.0, 14.0),
    ("symbols to words", "symbol_ratio", None, 0.12),
    ("exclamations to words", "exclaim_ratio", None, 0.25),
    ("stop words to words", "stop_ratio", 0.02, None),
    ("repeated lines to lines", "dup_line_ratio", None, 0.5),
    ("words in repeated windows to words", "repeat_ratio", None, 0.5),
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def count_in(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def window_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more."""

    def covered(spots: Column) -> Column:
        # Sorted starts of repeated windows: each covers three words, less what the next one covers.
        reach = F.transform(spots, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(spots, i + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def spots(s: Column, same) -> Column:
        """Starts of the windows that are the same as one of their neighbours in the order of s."""
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["p"]))

    def of(w: Column) -> Column:
        at = lambda x, k: F.get(w, x["p"] + k)
        equal = lambda x, y: (at(x, 0) == at(y, 0)) & (at(x, 1) == at(y, 1)) & (at(x, 2) == at(y, 2))
        hashed = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        whole = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))
        by_hash = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        # In the order of hash, words, place equal windows are neighbours, even where another one shares their hash.
        by_words = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(w, i + 1, 3).alias("w"), i.alias("p"))))
        clash = lambda s: F.size(F.filter(s, lambda x, i: F.when(hashed(x, F.get(s, i - 1)), ~equal(x, F.get(s, i - 1))).otherwise(False))) > 0
        exact = lambda h: let(by_words(h), lambda s: let(spots(s, whole), covered))
        heavy = lambda h: let(by_hash(h), lambda s: F.when(clash(s), exact(h)).otherwise(let(spots(s, hashed), covered)))
        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: window_hash(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(heavy(h)))

    return F.when(F.size(words) < 3, 0).otherwise(of(words)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use."""
    text = F.coalesce("text", F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def line_counts(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return docs.select(
        "doc_id",
        let(words_of(text), counts).alias("w"),
        let(lines, line_counts).alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        count_in(text, SYMBOLS).cast("long").alias("n_symbols"),
        count_in(text, "!").cast("long").alias("n_exclaim"),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_exclaim")


def compiled(rules=RULES) -> Column:
    """The table as one boolean expression over the counts."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    ratios = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "exclaim_ratio": ratio("n_exclaim", "n_words"),
        "stop_ratio": ratio("n_stop", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }
    verdict = F.lit(True)
    for _, name, least, most in rules:
        if least is not None:
            verdict = verdict & (ratios[name] >= least)
        if most is not None:
            verdict = verdict & (ratios[name] <= most)
    return verdict


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """The counts of every document, base_failed and kept."""
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"), "n_stop", "n_lines", "n_exclaim")
