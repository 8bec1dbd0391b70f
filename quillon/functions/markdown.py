"""Expressions over markdown documents with front matter. Lengths are code points.

Sections end at the next heading of level two or more, or at the end of the text.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```.*?```"
FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---"
LEVELS = (
    (1, "Blank lines"), (2, "When to Use"), (3, "When NOT to Use"), (4, "Workflow to one line"), (5, "Related Skills"),
    (6, "Bold, italic and code marks"), (7, "Code examples"), (8, "Headings normalised"), (9, "Headings removed"), (10, "Summary"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def frontmatter(content: Column) -> Column:
    """Text between the first pair of --- lines; empty if there is none."""
    return F.regexp_extract(content, FRONT, 1)


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"""^["'](.*)["']$""", "$1")


def lenient_fields(front: Column) -> Column:
    """Map of `key: value` lines, comments and empty values left out; indented keys count like others, the last of a key stays."""
    lines = F.filter(F.transform(F.split(front, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z][\w-]*:\s*\S") & ~x.startswith("#"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), unquoted(F.regexp_extract(x, r"^[\w-]+:\s*(.*)$", 1)).alias("value")))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(let(entries, last))


def h1_title(content: Column, default: Column) -> Column:
    """The first title after the front matter."""
    body = F.regexp_replace(content, FRONT, "")
    title = F.trim(F.regexp_extract(body, r"(?m)^# (.*)$", 1))
    return F.when(title != "", title).otherwise(default)


def truncated(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def truncated_at_word(text: Column, most: int = 60) -> Column:
    head = F.regexp_extract(text, rf"(?s)^(.{{0,{most}}}) ", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(head == "", F.substring(text, 1, most)).otherwise(head), F.lit("...")))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1.0), F.ceil(F.length(text) / 4) + newlines(text) / 2)


def token_estimate_llm(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.ceil(F.length(text) / 4) + 0.5 * newlines(text)))).cast("long")


def fence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("```")).cast("long")


def outside_fences(content: Column, change: Callable[[Column], Column]) -> Column:
    """The text with `change` applied everywhere but inside ``` fences."""
    parts = F.transform(F.split(content, FENCE), change)
    fences = F.regexp_extract_all(content, F.lit(FENCE), 0)
    return F.array_join(F.zip_with(parts, fences, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def drop_blank_lines(content: Column) -> Column:
    return outside_fences(content, lambda x: F.regexp_replace(x, r"\n\n+", "\n"))


def drop_section(content: Column, title: str) -> Column:
    """Without the first section of that title."""
    dropped = F.regexp_replace(content, rf"(?s)\A(.*?)((?:\A|\n)##\s+{title}\n.*?)(\n##.*)?\z", "$1$3")
    return F.when(content.contains(f"{title}\n"), dropped).otherwise(content)


#: The workflow section with its numbered steps, a step, and its bold lead. Possessive, so that a list of any length takes no stack.
WORKFLOW = r"(?m)^##\s+Core Workflow\n((?:\d+\.\s+.*\n?)++)"
STEP, LEAD = r"(?m)^\d+\.\s+(.+)$", r"^\*\*(.+?)\*\*\s*[—:-]?\s*"


def collapse_workflow(content: Column) -> Column:
    """The numbered steps of the first workflow section as one line."""

    def collapsed(x: Column) -> Column:
        found, at = x["found"], F.position(x["found"], content)
        steps = F.transform(F.regexp_extract_all(found, F.lit(STEP), 1), lambda s: F.regexp_replace(F.trim(s), LEAD, "$1: "))
        line = F.concat(F.lit("## Core Workflow\n"), F.array_join(steps, "; "))
        return F.when(found == "", content).otherwise(F.concat(F.substring(content, F.lit(1), at - 1), line, F.substring(content, at + F.length(found), F.length(content))))

    found = F.when(content.contains("Core Workflow\n"), F.regexp_extract(content, WORKFLOW, 0)).otherwise("")
    return let(F.struct(found.alias("found")), collapsed)


def strip_markup(content: Column) -> Column:
    def change(x: Column) -> Column:
        for pattern in (r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"`([^`]+)`"):
            x = F.regexp_replace(x, pattern, "$1")
        return x

    return outside_fences(content, change)


def drop_code(content: Column) -> Column:
    return F.regexp_replace(content, FENCE, "[code example removed]")


def normalise_headings(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?m)^##\s+", "## "), r"(?m)^## Core Workflow$", "## Workflow")


def flatten_headings(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?m)^##\s+.+\n", ""), r"\n\n+", " ")


RECIPES = {
    1: drop_blank_lines,
    2: lambda c: drop_section(c, "When to Use"),
    3: lambda c: drop_section(c, "When NOT to Use"),
    4: collapse_workflow,
    5: lambda c: drop_section(c, "Related Skills"),
    6: strip_markup,
    7: drop_code,
    8: normalise_headings,
    9: flatten_headings,
    10: lambda c: c,  # a summary needs blank lines, which level 1 has removed
}


def compressed(content: Column, level: int) -> Column:
    """Recipes 1 to level in turn, each computed once; levels above 10 count as 10, below 1 nothing changes."""
    for k in range(1, min(level, 10) + 1):
        content = let(content, RECIPES[k])
    return content


def ensure_frontmatter(text: Column, original: Column) -> Column:
    front = F.regexp_extract(original, FRONT, 0)
    return F.when(text.startswith("---") | (front == ""), text).otherwise(F.concat(front, F.lit("\n\n"), text))


def markdown_errors(content: Column) -> Column:
    body = F.regexp_replace(content, r"(?s)\A---\r?\n.*?\r?\n---\s*", "")
    errors = F.array(
        F.when(F.length(content) < 50, "too short"),
        F.when(~body.rlike(r"\A\s*# \S"), "no title"),
        F.when(fence_count(content) % 2 != 0, "unbalanced code blocks"),
        F.when(content.startswith("---") & (F.regexp_extract(content, FRONT, 0) == ""), "open front matter"),
        F.when(F.regexp_replace(content, r"\[[^\]\n]*\]\([^)\n]*\)", "").rlike(r"\]\([^)\n]*(\n|\z)"), "open link"),
    )
    return F.filter(errors, lambda x: x.isNotNull())


def extract_code(text: Column, language: str = "python") -> Column:
    """Block of the language, else any block, else the whole text if it holds a definition; null otherwise."""
    named = F.regexp_extract(text, rf"(?s)```{language}\n(.*?)```", 1)
    any_block = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*?)```", 1)
    whole = F.when(text.contains("def ") | text.contains("class "), F.trim(text))
    return F.coalesce(F.when(named != "", F.trim(named)), F.when(any_block != "", F.trim(any_block)), whole)


def sloc(code: Column) -> Column:
    return F.size(F.filter(F.transform(F.split(code, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))).cast("long")


def replace_region(text: Column, begin: str, end: str, new: Column) -> Column:
    """Every text from the one marker to the next other one replaced by a new block; appended where the first marker is absent."""
    block = F.concat(F.lit(begin + "\n"), new, F.lit("\n" + end))
    quoted = F.replace(F.replace(block, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    region = F.lit("(?s)" + re.escape(begin) + ".*?" + re.escape(end))
    appended = F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), block)
    return F.when(text.contains(begin), F.regexp_replace(text, region, quoted)).otherwise(appended)


def sanitised(text: Column) -> Column:
    for name in ("eval", "exec", "system"):
        text = F.regexp_replace(text, rf"{name}\s*\(", f"{name}_blocked(")
    return F.replace(text, F.lit("`"), F.lit("\\`"))


def sanitised_values(values: Column) -> Column:
    """A map of texts with every value sanitised."""
    return F.transform_values(values, lambda _, v: sanitised(v))


def sanitised_json(text: Column) -> Column:
    """JSON text with every string in it sanitised, at any depth; keys stay. Null where it does not parse."""

    def clean(x):
        if isinstance(x, str):
            for name in ("eval", "exec", "system"):
                x = re.sub(rf"{name}\s*\(", f"{name}_blocked(", x)
            return x.replace("`", "\\`")
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return F.pandas_udf(run, "string")(text)


def word_set(text: Column) -> Column:
    """Lower-case words, each once; none of null."""
    return F.coalesce(F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != "")), F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two word sets; 0 where neither has any."""
    sizes = F.size(a) + F.size(b)
    return F.when(sizes > 0, let(F.size(F.array_intersect(a, b)), lambda both: both / (sizes - both))).otherwise(0.0)


def word_jaccard(a: Column, b: Column) -> Column:
    """Share of common lower-case words; 0 where neither has any."""
    return let(F.struct(word_set(a).alias("a"), word_set(b).alias("b")), lambda w: set_jaccard(w["a"], w["b"]))


def attribution(name: Column, domain: Column, kind: str = "markdown") -> Column:
    badge = F.concat(F.lit("["), F.upper(domain), F.lit("]"))
    if kind == "html":
        return F.concat(F.lit("<li><strong>"), name, F.lit("</strong> "), badge, F.lit("</li>"))
    if kind == "plaintext":
        return F.concat(F.lit("* "), name, F.lit(" "), badge)
    return F.concat(F.lit("- **"), name, F.lit("** "), badge)
