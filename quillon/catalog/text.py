"""Text queries over documents wrapped as markdown."""
from pyspark.sql import functions as F

from ..engine import compressed_versions
from ..functions import markdown as M
from ..functions.code import code_metrics as measure_code, signature
from ..operators.expand import expand_triggers as expand
from ..operators.ranks import paged
from ..operators.routing import parsed_ranking
from ..registry import query, source, spread
from ..sources.tables import staged

_DROP = r"regexp_replace(content, '(?s)\A(.*?)((?:\A|\n)##\s+{t}\n.*?)(\n##.*)?\z', '\1\3')"
_OUT = "list_aggregate(list_transform(list_zip(list_transform(regexp_split_to_array(content, '(?s)```.*?```'), lambda x: {f}), regexp_extract_all(content, '(?s)```.*?```')), lambda p: coalesce(p[1], '') || coalesce(p[2], '')), 'string_agg', '')"
_L1 = _OUT.replace("{f}", r"regexp_replace(x, '\n\n+', chr(10), 'g')")
_STRIP = _OUT.replace("{f}", r"regexp_replace(regexp_replace(regexp_replace(x, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g')")
_FLOW = r"""CASE WHEN f = '' THEN content ELSE substr(content, 1, strpos(content, f) - 1) || '## Core Workflow' || chr(10) ||
 array_to_string(list_transform(regexp_extract_all(f, '(?m)^\d+\.\s+(.+)$', 1), lambda s: regexp_replace(trim(s), '^\*\*(.+?)\*\*\s*[—:-]?\s*', '\1: ')), '; ') || substr(content, strpos(content, f) + length(f)) END"""
_FIND = r"regexp_extract(content, '(?m)^##\s+Core Workflow\n((?:\d+\.\s+.*\n?)+)', 0)"


def _md(spark, d):
    return source(spark, d, "md")


def _text_query(name, change, sql):
    def run(spark, d):
        return _md(spark, d).select("name", change(F.col("content")).alias("content"))

    run.__name__ = name
    query(sql)(run)


_text_query("compress_l1", M.drop_blank_lines, f"WITH @md SELECT name, {_L1} AS content FROM md")
_text_query("fence_replace", lambda c: M.outside_fences(c, lambda x: F.replace(x, F.lit("e"), F.lit("E"))), "WITH @md SELECT name, " + _OUT.replace("{f}", "replace(x, 'e', 'E')") + " AS content FROM md")
_text_query("drop_section", lambda c: M.drop_section(c, "Related Skills"), "WITH @md SELECT name, " + _DROP.replace("{t}", "Related Skills") + " AS content FROM md")
_text_query("collapse_workflow", M.collapse_workflow, f"WITH @md SELECT name, {_FLOW} AS content FROM (SELECT *, {_FIND} AS f FROM md)")
_text_query("strip_markup", M.strip_markup, f"WITH @md SELECT name, {_STRIP} AS content FROM md")
_text_query("drop_code", M.drop_code, "WITH @md SELECT name, regexp_replace(content, '(?s)```.*?```', '[code example removed]', 'g') AS content FROM md")
_text_query("flatten_headings", lambda c: M.flatten_headings(M.normalise_headings(c)), r"WITH @md SELECT name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?m)^##\s+', '## ', 'g'), '(?m)^## Core Workflow$', '## Workflow', 'g'), '(?m)^##\s+.+\n', '', 'g'), '\n\n+', ' ', 'g') AS content FROM md")
_text_query("ensure_frontmatter", lambda c: M.ensure_frontmatter(F.lit("# Short\ntext"), c), r"WITH @md SELECT name, regexp_extract(content, '(?s)\A---\r?\n(.*?)\r?\n---', 0) || chr(10) || chr(10) || '# Short' || chr(10) || 'text' AS content FROM md")
_text_query("sanitize", lambda c: M.sanitised(F.concat(c, F.lit(" eval (x) exec(`y`) system\t("))), r"""WITH @md SELECT name, replace(regexp_replace(regexp_replace(regexp_replace(content || ' eval (x) exec(`y`) system' || chr(9) || '(', 'eval\s*\(', 'eval_blocked(', 'g'), 'exec\s*\(', 'exec_blocked(', 'g'), 'system\s*\(', 'system_blocked(', 'g'), '`', '\`') AS content FROM md""")
_REGION = "CASE doc_id % 3 WHEN 0 THEN content WHEN 1 THEN replace(content, '```python', '``` python') ELSE replace(content, chr(10) || '```' || chr(10), chr(10)) END"


@query(rf"""WITH @md, r AS (SELECT name, {_REGION} AS content FROM md)
SELECT name, CASE WHEN contains(content, '```python') THEN regexp_replace(content, '(?s)```python.*?```', '```python' || chr(10) || 'pay $1' || chr(10) || '```', 'g')
ELSE regexp_replace(content, '\s+\z', '') || chr(10) || chr(10) || '```python' || chr(10) || 'pay $1' || chr(10) || '```' END AS content FROM r""")
def replace_region(spark, d):
    """Documents with the region, without its first mark, and without its last one."""
    i, c = F.col("doc_id") % 3, F.col("content")
    text = F.when(i == 0, c).when(i == 1, F.replace(c, F.lit("```python"), F.lit("``` python"))).otherwise(F.replace(c, F.lit("\n```\n"), F.lit("\n")))
    return _md(spark, d).select("name", M.replace_region(text, "```python", "```", F.lit("pay $1")).alias("content"))


@query(r"""SELECT page_id, 'eval_blocked(' || page_id || ') \`' || url || '\`' AS a, CASE WHEN page_id % 2 = 0 THEN 'system_blocked(x) exec_blocked(y)' ELSE 'systems (x)' END AS b FROM pages""")
def sanitize_map(spark, d):
    """Every value of a map, as each value of a request's context."""
    b = F.when(F.col("page_id") % 2 == 0, "system (x) exec\t(y)").otherwise("systems (x)")
    m = F.create_map(F.lit("a"), F.concat(F.lit("eval ("), "page_id", F.lit(") `"), "url", F.lit("`")), F.lit("b"), b)
    clean = M.sanitised_values(m)
    return source(spark, d, "pages").select("page_id", clean["a"].alias("a"), clean["b"].alias("b"))


_HEADINGS = r"regexp_replace(regexp_replace(content, '(?m)^##\s+', '## ', 'g'), '(?m)^## Core Workflow$', '## Workflow', 'g')"
_STEPS = (
    _L1, _DROP.replace("{t}", "When to Use"), _DROP.replace("{t}", "When NOT to Use"), _FLOW, _DROP.replace("{t}", "Related Skills"), _STRIP,
    "regexp_replace(content, '(?s)```.*?```', '[code example removed]', 'g')", _HEADINGS, r"regexp_replace(regexp_replace(content, '(?m)^##\s+.+\n', '', 'g'), '\n\n+', ' ', 'g')",
)
_TOKENS = "greatest(1.0::DOUBLE, ceil(length({c}) / 4) + (length({c}) - length(replace({c}, chr(10), ''))) / 2)"
_LEVELS = ", ".join(f"l{k} AS (SELECT name, {step} AS content FROM (SELECT *, {_FIND} AS f FROM {f'l{k - 1}' if k > 1 else 'md'}))" for k, step in enumerate(_STEPS, 1))
_ALL = " UNION ALL ".join(f"SELECT name, {k} AS level, content FROM l{min(k, 9)}" for k in range(1, 11))


@query(f"""WITH @md, {_LEVELS}, a AS ({_ALL}) SELECT a.name, CAST(level AS INTEGER) AS level, length(md.content) AS original_chars, length(a.content) AS chars, round(length(a.content) / length(md.content), 6) AS ratio,
greatest(0, {_TOKENS.format(c='md.content')} - {_TOKENS.format(c='a.content')}) AS tokens_saved, round({_TOKENS.format(c='a.content')} / {_TOKENS.format(c='md.content')}, 6) AS token_ratio FROM a JOIN md ON md.name = a.name""")
def compress_levels(spark, d):
    """All ten levels, each on top of the one before."""
    md = spread(_md(spark, d)).withColumn("c0", F.col("content"))
    tokens = lambda c: M.token_estimate(F.col(c)).cast("double")
    for k in range(1, 11):
        md = md.withColumn(f"c{k}", M.RECIPES[k](F.col(f"c{k - 1}")))
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("level"), F.length(f"c{k}").cast("long").alias("chars"), tokens(f"c{k}").alias("tokens")) for k in range(1, 11))))
    out = md.select("name", F.length("content").cast("long").alias("original_chars"), tokens("content").alias("before"), rows)
    return out.select(
        "name", "level", "original_chars", "chars", F.round(F.col("chars") / F.col("original_chars"), 6).alias("ratio"),
        F.greatest(F.lit(0.0), F.col("before") - F.col("tokens")).alias("tokens_saved"), F.round(F.col("tokens") / F.col("before"), 6).alias("token_ratio"),
    )


_STYLES = "(VALUES ('brief', 1600), ('moderate', 3200), ('detailed', 6000)) s(version, most)"


@query(f"""WITH @skills, c AS (SELECT name, version, length(content) AS n, substr(content, 1, CAST(most AS INTEGER)) AS content FROM skills, {_STYLES} WHERE content IS NOT NULL)
SELECT name, version, content, CASE WHEN content = '' THEN 0 ELSE CAST(greatest(1, ceil(ceil(length(content) / 4) + 0.5 * (length(content) - length(replace(content, chr(10), ''))))) AS BIGINT) END AS tokens, round(length(content) / greatest(n, 1), 6) AS ratio FROM c""")
def compress_styles(spark, d):
    """Three styles by budget of tokens, the local stand-in for a model's summaries."""
    return compressed_versions(source(spark, d, "skills").filter("content is not null"))


@query("WITH @md SELECT name, greatest(1.0::DOUBLE, ceil(length(content) / 4) + (length(content) - length(replace(content, chr(10), ''))) / 2) AS tokens FROM md")
def token_estimate(spark, d):
    return _md(spark, d).select("name", M.token_estimate(F.col("content")).cast("double").alias("tokens"))


@query("WITH @md SELECT name, CAST(greatest(1, ceil(ceil(length(content) / 4) + 0.5 * (length(content) - length(replace(content, chr(10), ''))))) AS BIGINT) AS tokens FROM md")
def token_estimate_llm(spark, d):
    return _md(spark, d).select("name", M.token_estimate_llm(F.col("content")).alias("tokens"))


@query("WITH @skills SELECT name FROM skills WHERE greatest(1, ceil(length(content) / 4) + (length(content) - length(replace(content, chr(10), ''))) / 2) >= 100")
def should_compress(spark, d):
    return source(spark, d, "skills").filter(M.token_estimate(F.col("content")) >= 100).select("name")


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in M.LEVELS) + ") v(level, description)")
def recipe_catalog(spark, d):
    return spark.createDataFrame(list(M.LEVELS), "level int, description string")


@query(r"""WITH @md SELECT name, trim(regexp_extract(content, '(?s)```python\n(.*?)```', 1), chr(10) || ' ') AS code FROM md""")
def extract_code(spark, d):
    return _md(spark, d).select("name", F.btrim(M.extract_code(F.col("content")), F.lit("\n ")).alias("code"))


@query(r"""WITH @md SELECT name, CAST(len(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))) AS BIGINT) AS sloc FROM md""")
def sloc(spark, d):
    return _md(spark, d).select("name", M.sloc(F.col("content")).alias("sloc"))


@query()
def code_metrics(spark, d):
    return _md(spark, d).select("name", measure_code(F.coalesce(M.extract_code(F.col("content")), F.lit(""))).alias("m")).select("name", "m.*")


@query()
def infer_signature(spark, d):
    return source(spark, d, "benchmark").select("item_id", signature(F.to_json(F.struct(F.split("text", " ").alias("input")))).alias("signature"))


_W = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[ \\t\\r\\n]+'), lambda w: w <> ''))"


@query(f"""WITH p AS (SELECT a.doc_id, {_W.format(x='a.text')} AS a, {_W.format(x='b.text')} AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 0), 6) AS jaccard FROM p""")
def jaccard(spark, d):
    """Each text is cut into words once; the join moves word sets."""
    a = staged(source(spark, d, "documents").select("doc_id", M.word_set(F.col("text")).alias("words")), "word-sets")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("other"))
    return a.join(b, "doc_id").select("doc_id", F.round(M.set_jaccard(F.col("words"), F.col("other")), 6).alias("jaccard"))


#: Variants of terms: a parameter of the operator.
VARIANTS = {"text": ["document", "prose", "wording"], "de": ["german", "deutsch"], "en": ["english"], "fr": ["french"], "es": ["spanish"]}
_MAP = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{v}')" for k, vs in VARIANTS.items() for i, v in enumerate(vs)) + ") v(key, pos, variant)"


@query(f"""WITH @skills, m AS ({_MAP}), t AS (SELECT name, 0 AS pos, 'Text ' || role AS term FROM skills UNION ALL SELECT name, 1, role FROM skills UNION ALL SELECT name, 2, 'english' FROM skills),
n AS (SELECT DISTINCT name, term FROM (
 SELECT name, variant AS term FROM t JOIN m ON lower(term) = key AND m.pos < 2 UNION ALL SELECT name, key FROM t JOIN m ON lower(term) = variant
 UNION ALL SELECT name, variant FROM (SELECT name, unnest(string_split(lower(term), ' ')) AS w FROM t) JOIN m ON w = key AND m.pos = 0)),
a AS (SELECT name, pos, term FROM t UNION ALL SELECT name, 100, term FROM n WHERE (name, term) NOT IN (SELECT (name, term) FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos, term) AS k FROM a)
SELECT name, string_agg(term, ', ' ORDER BY k) AS triggers FROM r WHERE k <= 8 GROUP BY name""")
def expand_triggers(spark, d):
    t = source(spark, d, "skills").select("name", F.array(F.concat(F.lit("Text "), "role"), "role", F.lit("english")).alias("triggers"))
    return expand(t, spark.createDataFrame([(k, i, v) for k, vs in VARIANTS.items() for i, v in enumerate(vs)], "key string, pos int, variant string"))


@query("""WITH @skills SELECT name, CASE WHEN category IN ('src0', 'src1') THEN category || ':' || role ELSE role END AS related, substr(name, strpos(name, '-') + 1) AS short_name FROM skills""")
def normalize_names(spark, d):
    return source(spark, d, "skills").select("name", F.when(F.col("category").isin("src0", "src1"), F.concat_ws(":", "category", "role")).otherwise(F.col("role")).alias("related"), F.regexp_extract("name", "^[^-]*-(.*)$", 1).alias("short_name"))


@query(r"SELECT doc_id, regexp_replace(concat(doc_id % 100, '_', source), '^(\d+)[_-](.+)$', '\2') AS name FROM documents")
def strip_prefix(spark, d):
    return source(spark, d, "documents").select("doc_id", F.regexp_replace(F.concat_ws("_", F.col("doc_id") % 100, "source"), r"^(\d+)[_-](.+)$", "$2").alias("name"))


@query("""WITH s AS (SELECT doc_id, source || '-' || lang || '-' || doc_id AS old FROM documents)
SELECT doc_id, old AS old_path, split_part(old, '-', 1) || '/' || substr(old, strpos(old, '-') + 1) AS new_path FROM s WHERE split_part(old, '-', 1) IN ('src0', 'src1', 'src2')""")
def migration_plan(spark, d):
    old = F.concat_ws("-", "source", "lang", "doc_id")
    known = source(spark, d, "documents").select("doc_id", old.alias("old_path")).filter(F.substring_index("old_path", "-", 1).isin("src0", "src1", "src2"))
    return known.withColumn("new_path", F.regexp_replace("old_path", "^([^-]*)-", "$1/"))


@query("""WITH @skills, k AS (SELECT category, name, role, CAST((row_number() OVER (PARTITION BY category ORDER BY name) - 1) // 100 AS INTEGER) AS page FROM skills)
SELECT category, page, count(*) AS n, string_agg('- **' || name || '** [' || upper(role) || ']', chr(10) ORDER BY name) AS footer FROM k GROUP BY category, page""")
def footer(spark, d):
    """The lines of each category in the order of names, in pages of a hundred."""
    lines = source(spark, d, "skills").select("category", "name", M.attribution(F.col("name"), F.col("role")).alias("footer"))
    return paged(lines, "category", "footer", 100, "\n", "name")


@query("""SELECT conv_id, turn, 'a' || conv_id AS name, CASE WHEN turn % 4 = 3 THEN 0.0 ELSE CAST('0.' || (turn % 10) AS DOUBLE) END AS score, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'fits ' || role END AS reason FROM conversations
UNION ALL SELECT conv_id, turn, 'b', 0.5::DOUBLE, CASE WHEN turn % 4 = 0 THEN 'ok' ELSE 'is, ok' END FROM conversations""")
def rank_parse(spark, d):
    """Replies as JSON in prose, as numbered lines, as broken JSON with lines, and with a score that is no number."""
    i, t = F.col("conv_id").cast("string"), F.col("turn")
    score = F.concat(F.lit("0."), (t % 10).cast("string"))
    json = F.concat(F.lit('Here: {"rankings": [{"name": "a'), i, F.lit('", "score": '), score, F.lit('}, {"name": "c", "score": 1}, {"skillName": "b", "score": 0.5, "reason": "ok"}]} done'))
    lines = lambda value: F.concat(F.lit("1. a"), i, F.lit(" score: "), value, F.lit(" reason: fits "), "role", F.lit(" \n no. 2.\n2.  b Score:0.5Reason: is, ok\n3. c score: 1 reason: unknown"))
    reply = F.when(t % 4 == 0, json).when(t % 4 == 1, lines(score)).when(t % 4 == 2, F.concat(F.lit('{"rankings": [{"name" }\n'), lines(score))).otherwise(lines(F.lit(".")))
    rows = source(spark, d, "conversations").select("conv_id", "turn", parsed_ranking(reply, F.array(F.concat(F.lit("a"), i), F.lit("b"))).alias("r"))
    return rows.select("conv_id", "turn", F.inline("r"))
