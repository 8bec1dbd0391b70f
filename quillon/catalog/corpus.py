"""Corpus queries."""
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..operators import corpus as K
from ..operators import postings as P
from ..operators.ranks import paged, positions
from ..registry import query, source
from ..sources import logs, tables

_FRONT = r"regexp_extract(content, '(?s)\A---\r?\n(.*?)\r?\n---', 1)"


def _md(spark, d):
    return source(spark, d, "md")


def _skills(spark, d):
    return source(spark, d, "skills")


def _raw(spark, d):
    return _md(spark, d).select(F.concat(F.lit("corpus/"), "category", F.lit("/"), "name", F.lit("/SKILL.md")).alias("path"), "content")


@query("""WITH @md SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'z/' ELSE 'a/' END, category, '/', name, '/SKILL.md') AS path, concat('doc-', doc_id) AS name, category,
concat(CASE WHEN doc_id % 3 = 0 THEN 'Early: ' ELSE 'Text: ' END, role) AS description, concat(category, ',alpha,beta,', role) AS tags, '1.0.0' AS version, role,
concat('alpha,', category, ',beta') AS triggers, concat('doc-', doc_id * 7 % 1000, ',x') AS related FROM md""")
def load_skills(spark, d):
    """Two folders of which the first, that of every third document, comes last by name."""
    md = _md(spark, d)
    place = lambda folder: F.concat(F.lit(folder), "category", F.lit("/"), "name", F.lit("/SKILL.md"))
    early = md.filter("doc_id % 3 = 0").select(F.lit(0).alias("dir_rank"), place("z/").alias("path"), F.replace("content", F.lit("Text: "), F.lit("Early: ")).alias("content"))
    rows = K.load(early.unionByName(md.select(F.lit(1).alias("dir_rank"), place("a/").alias("path"), "content")))[0]
    return rows.select("path", "name", "category", "description", "version", "role", *(F.array_join(c, ",").alias(c) for c in ("tags", "triggers", "related")))


@query("""WITH @skills, p AS (SELECT concat('doc-', lpad(CAST(page_id // 2 * 3 AS STRING), 8, '0')) AS name, min_by(url, page_id) AS description FROM pages GROUP BY 1)
SELECT name, description FROM skills UNION ALL SELECT name, description FROM p WHERE name NOT IN (SELECT name FROM skills)""")
def index_merge(spark, d):
    """A new list that names every document twice."""
    name = F.concat(F.lit("doc-"), F.lpad((F.floor(F.col("page_id") / 2) * 3).cast("string"), 8, "0"))
    new = source(spark, d, "pages").select(name.alias("name"), F.col("url").alias("description"), "page_id")
    return K.merged_index(_skills(spark, d).select("name", "description"), new, "page_id")


@query("""WITH @skills SELECT name, CASE WHEN doc_id % 3 = 0 THEN concat('local ', category) WHEN doc_id % 5 = 0 THEN concat('shared ', role) ELSE concat('remote ', role) END AS content FROM skills""")
def content_resolve(spark, d):
    s = _skills(spark, d)
    tries = F.inline(F.array(
        F.struct(F.lit(2).alias("priority"), F.concat(F.lit("remote "), "role").alias("content")),
        F.struct(F.lit(0).alias("priority"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("local "), "category")).alias("content")),
        F.struct(F.lit(1).alias("priority"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("shared "), "role")).alias("content")),
    ))
    return K.resolved_content(s.select("name", tries))


@query("SELECT CAST(vec_id AS VARCHAR) AS name, CAST(label AS VARCHAR) AS category, len(embedding) AS size, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def vector_index_roundtrip(spark, d):
    e = source(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("label").cast("string").alias("category"), "embedding")
    rows = tables.read_vector_index(spark, tables.write_vector_index(e))
    return rows.select("name", "category", F.size("embedding").cast("long").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT n_name AS line FROM nation UNION ALL SELECT lower(n_name) FROM nation")
def file_ops(spark, d):
    folder = tables.scratch(spark, "notes")
    names = source(spark, d, "nation").select("n_name")
    tables.append_lines(names, folder, "a.txt")
    tables.append_lines(names.select(F.lower("n_name")), folder, "a.txt")
    return tables.read_lines(spark, folder, "a.txt")


_LOG = "SELECT event_id, concat(event_type, ' user=', user_id, ' ', props) AS line FROM events"


@query(f"WITH l AS ({_LOG}) SELECT event_id, line FROM l WHERE regexp_matches(line, 'error.*user=[1-5]') ORDER BY event_id DESC LIMIT 100")
def log_tail(spark, d):
    lines = source(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" user="), "user_id", F.lit(" "), "props").alias("line"))
    return logs.tail(lines, "event_id", "error.*user=[1-5]", 100)


@query("SELECT event_id, event_type AS level FROM events WHERE event_type IN ('purchase', 'error')")
def log_level_filter(spark, d):
    e = source(spark, d, "events").select("event_id", F.col("event_type").alias("level"))
    return logs.at_least(e, "purchase", ("view", "click", "signup", "purchase", "error"))


@query("WITH @skills SELECT 'total' AS kind, '' AS key, count(*) AS n FROM skills UNION ALL SELECT 'domain', category, count(*) FROM skills GROUP BY category UNION ALL SELECT 'role', role, count(*) FROM skills GROUP BY role")
def skills_index(spark, d):
    s = _skills(spark, d)
    sets = s.groupingSets([[], ["category"], ["role"]], "category", "role").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "domain").otherwise("role").alias("kind"), F.coalesce("category", "role", F.lit("")).alias("key"), "n")


@query("""SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) FILTER (event_type <> 'error') AS text, CAST(coalesce(sum(k) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS tokens,
string_agg(CAST(event_id AS STRING), '; ' ORDER BY event_id) FILTER (event_type = 'error') AS errors FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id""")
def run_stream_fold(spark, d):
    e = source(spark, d, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return logs.folded(e, "user_id", "event_id", F.col("event_type"), text=F.col("event_type"), tokens=F.col("k"), error=F.col("event_id").cast("string"))


@query("SELECT concat('exercise-', item_id) AS name, text AS task, 'simple' AS tier FROM benchmark WHERE text IS NOT NULL")
def exercise_scan(spark, d):
    lines = source(spark, d, "benchmark").select(F.to_json(F.struct(F.concat(F.lit("exercise-"), "item_id").alias("name"), F.col("text").alias("task"), F.lit("simple").alias("tier"))).alias("value"))
    return logs.exercises(lines)


@query("""SELECT doc_id, concat('skills/', source, '/', doc_id, '/SKILL.md') AS path, n_chars AS bytes FROM documents WHERE n_chars < 3000""")
def stub_list_parse(spark, d):
    line = F.concat(F.lit("- skills/"), "source", F.lit("/"), "doc_id", F.lit("/SKILL.md ("), F.format_number("n_chars", 0), F.lit(" bytes)"))
    return logs.stub_list(source(spark, d, "documents").select("doc_id", line.alias("line")))


@query("""WITH l AS (SELECT doc_id, doc_id // 10 AS report, CASE WHEN doc_id % 10 = 0 THEN '## Dead' WHEN doc_id % 10 = 5 THEN '## Missing' ELSE concat('- `', source, '` -> `', lang, '`') END AS line FROM documents)
SELECT report, CASE WHEN doc_id % 10 < 5 THEN 'Dead' ELSE 'Missing' END AS section, regexp_extract(line, '`([^`]+)` -> `([^`]+)`', 1) AS src, regexp_extract(line, '`([^`]+)` -> `([^`]+)`', 2) AS dst FROM l WHERE starts_with(line, '- ')""")
def report_sections(spark, d):
    i = F.col("doc_id")
    line = F.when(i % 10 == 0, "## Dead").when(i % 10 == 5, "## Missing").otherwise(F.concat(F.lit("- `"), "source", F.lit("` -> `"), "lang", F.lit("`")))
    lines = source(spark, d, "documents").select(F.floor(i / 10).cast("long").alias("report"), i.alias("line_no"), line.alias("line"))
    return logs.report_links(lines)


@query(f"WITH @fronts SELECT doc_id, {_FRONT} AS frontmatter FROM fronts")
def frontmatter_extract(spark, d):
    return source(spark, d, "fronts").select("doc_id", M.frontmatter(F.col("content")).alias("frontmatter"))


@query()
def frontmatter_fields(spark, d):
    return _md(spark, d).select("name", K.yaml_fields(M.frontmatter(F.col("content"))).alias("fields"))


_LINES = rf"list_filter(list_transform(regexp_split_to_array({_FRONT}, '\r?\n'), lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-Za-z][\w-]*:\s*\S'))"
_FIELD = r"""regexp_replace(trim(regexp_extract(list_filter(l, lambda x: starts_with(x, '{0}:'))[-1], '^[\w-]+:\s*(.*)$', 1)), '^["''](.*)["'']$', '\1') AS f_{0}"""


@query(f"WITH @fronts, l AS (SELECT doc_id, {_LINES} AS l FROM fronts) SELECT doc_id, {', '.join(map(_FIELD.format, ('name', 'description', 'domain', 'role', 'triggers')))} FROM l")
def frontmatter_lenient(spark, d):
    f = source(spark, d, "fronts").select("doc_id", M.lenient_fields(M.frontmatter(F.col("content"))).alias("f"))
    return f.select("doc_id", *(F.col("f")[k].alias(f"f_{k}") for k in ("name", "description", "domain", "role", "triggers")))


@query("WITH @md SELECT concat('doc-', doc_id) AS name, category, concat('Text: ', role) AS description, concat_ws('|', category, 'alpha', 'beta', role) AS tags, '1.0.0' AS version FROM md")
def skill_metadata(spark, d):
    # A trigger that equals the category stands once.
    return K.with_metadata(_raw(spark, d)).select("name", "category", "description", F.concat_ws("|", "tags").alias("tags"), "version")


@query("SELECT doc_id, array_to_string(list_filter(list_transform(str_split(concat(' ', source, ', ,', text, ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM documents")
def split_lists(spark, d):
    return source(spark, d, "documents").select("doc_id", F.concat_ws("|", M.split_list(F.concat(F.lit(" "), "source", F.lit(", ,"), "text", F.lit(",")))).alias("items"))


@query("WITH @md SELECT name, concat('Title ', doc_id) AS title FROM md")
def h1_title(spark, d):
    return _md(spark, d).select("name", M.h1_title(F.col("content"), F.col("name")).alias("title"))


@query("WITH @skills SELECT name, concat_ws(' ', name, description, nullif(role, 'en')) AS text FROM skills")
def embedding_text(spark, d):
    return _skills(spark, d).select("name", F.concat_ws(" ", "name", "description", F.nullif("role", F.lit("en"))).alias("text"))


@query("WITH @skills SELECT name, category, description, concat('corpus/', category, '/', name) AS source_file FROM skills")
def list_skills(spark, d):
    return _skills(spark, d).select("name", "category", "description", F.concat_ws("/", F.lit("corpus"), "category", "name").alias("source_file"))


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS task,
CASE WHEN length(text) <= 60 THEN text ELSE coalesce(nullif(regexp_extract(text, '(?s)^(.{0,60}) ', 1), ''), substr(text, 1, 60)) || '...' END AS short FROM documents""")
def truncate_task(spark, d):
    return source(spark, d, "documents").select("doc_id", M.truncated(F.col("text")).alias("task"), M.truncated_at_word(F.col("text")).alias("short"))


@query("WITH x AS (SELECT concat(source, '-', n_chars % 50) AS name, doc_id, row_number() OVER (PARTITION BY concat(source, '-', n_chars % 50) ORDER BY lang, doc_id) AS k FROM documents) SELECT name, doc_id FROM x WHERE k = 1")
def dedupe_first(spark, d):
    rows = source(spark, d, "documents").select(F.concat_ws("-", "source", F.col("n_chars") % 50).alias("name"), "lang", "doc_id")
    return K.first_by_name(rows, "lang", "doc_id").select("name", "doc_id")


@query("WITH @skills SELECT name FROM skills WHERE category = 'src3'")
def by_category(spark, d):
    return _skills(spark, d).filter(F.col("category") == "src3").select("name")


@query("WITH @skills SELECT name FROM skills WHERE 'fr' IN (category, role)")
def by_tag(spark, d):
    return _skills(spark, d).filter(F.array_contains(F.array("category", "role"), "fr")).select("name")


@query("WITH @skills, q AS (SELECT * FROM (VALUES ('src3'), ('fr'), ('none')) v(term)) SELECT term, name FROM q JOIN skills ON category = term OR (role = term AND NOT EXISTS (SELECT 1 FROM skills x WHERE x.category = term))")
def by_category_or_tag(spark, d):
    """Documents of the category; those with the tag only where no category fits."""
    terms = spark.createDataFrame([("src3",), ("fr",), ("none",)], "term string")
    s = _skills(spark, d)
    hits = terms.join(s, F.col("term") == F.col("category")).select("term", "name", F.lit(0).alias("way")).union(terms.join(s, F.col("term") == F.col("role")).select("term", "name", F.lit(1)))
    best = hits.groupBy("term").agg(F.min("way").alias("way"))  # a row for each term asked
    return hits.join(best, ["term", "way"]).select("term", "name")


@query("WITH @skills SELECT name, category, role FROM skills WHERE name = 'doc-00000007'")
def skill_by_name(spark, d):
    return _skills(spark, d).filter(F.col("name") == "doc-00000007").select("name", "category", "role")


@query("WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, CASE WHEN text IN (SELECT text FROM c) THEN 'hit' ELSE 'miss' END AS cached FROM documents")
def embed_cache_split(spark, d):
    docs = source(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = docs.filter("doc_id % 3 = 0").select("key").distinct()
    return docs.join(cache, "key", "left_semi").select("doc_id", F.lit("hit").alias("cached")).union(docs.join(cache, "key", "left_anti").select("doc_id", F.lit("miss")))


_STORED = "SELECT category AS domain, name AS skill, 'brief' AS version, 0 AS created, description AS content FROM skills UNION ALL SELECT category, name, 'detailed', 1, concat(role, ' ', name) FROM skills UNION ALL SELECT category, name, 'brief', 2, CASE WHEN doc_id % 4 = 1 THEN concat('new ', name) WHEN doc_id % 4 = 2 THEN '' END FROM skills"


@query(f"WITH @skills, s AS ({_STORED}) SELECT domain, skill, version, max(created) AS created, max_by(content, created) AS content FROM s WHERE content <> '' GROUP BY ALL")
def version_cache(spark, d):
    """Versions written twice, of which the last with content counts, read back by folder."""
    path = tables.scratch(spark, "versions")
    rows = spark.sql(_STORED.replace("FROM skills", "FROM {s}"), s=_skills(spark, d))
    for k in (0, 1, 2):
        tables.write_versions(rows.filter(F.col("created") == k), path)
    return tables.read_versions(spark, path, "skill string, created int, content string")


@query("SELECT concat('t', vec_id) AS key, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS written, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE len(embedding) END AS size FROM embeddings WHERE vec_id % 5 <> 1 OR vec_id % 3 = 0")
def embedding_cache(spark, d):
    """A cache of embeddings with later writes, broken lines and rows without a vector."""
    path = tables.scratch(spark, "embedding-cache")
    e = source(spark, d, "embeddings").select(F.concat(F.lit("t"), "vec_id").alias("key"), "embedding", "vec_id")
    tables.save_cache(e.filter("vec_id % 5 <> 1").select("key", F.lit(1).alias("written"), "embedding"), path)
    tables.save_cache(e.filter("vec_id % 3 = 0").select("key", F.lit(2).alias("written"), F.array().cast("array<double>").alias("embedding")), path)
    tables.save_cache(e.filter("vec_id % 7 = 0").select("key", F.lit(3).alias("written")), path)
    e.filter("vec_id % 5 = 1").select(F.concat(F.lit('{"key": "'), "key", F.lit('", "embedding": [0.1, '))).write.mode("append").text(path)
    rows = tables.load_cache(spark, path, "key string, written int, embedding array<double>", "embedding")
    return rows.select("key", "written", F.size("embedding").cast("long").alias("size"))


@query("SELECT event_id, event_type AS level, concat(user_id, ' ', event_type) AS message FROM events WHERE event_type IN ('purchase', 'error')")
def log_sink(spark, d):
    """Entries at a level or above, written as JSON lines and read back."""
    path = tables.scratch(spark, "log")
    e = source(spark, d, "events").select("event_id", F.col("event_type").alias("level"), F.concat_ws(" ", "user_id", "event_type").alias("message"))
    logs.write_log(e, path, "purchase", ("view", "click", "signup", "purchase", "error"))
    return logs.read_ndjson(spark, path, "event_id long, level string, message string")


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) // count(*) AS tokens FROM conversations GROUP BY conv_id")
def batch_tokens(spark, d):
    """Texts embedded in one call share its tokens evenly."""
    calls = source(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total"))
    return logs.batch_tokens(calls).select("conv_id", "n", "tokens")


@query("SELECT user_id, count(*) AS n, round(max(value), 4) AS most FROM events GROUP BY user_id")
def result_sink(spark, d):
    """Nested results of each run, written as JSON and read back."""
    path = tables.scratch(spark, "results")
    runs = source(spark, d, "events").groupBy("user_id").agg(F.struct(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most")).alias("result"))
    tables.write_results(runs, path)
    return spark.read.schema("user_id long, result struct<n:long,most:double>").json(path).select("user_id", "result.*")


@query("WITH @skills SELECT name FROM skills WHERE nullif(role, 'es') IS NOT NULL")
def valid_skills(spark, d):
    tags = F.array_compact(F.array(F.nullif("role", F.lit("es"))))
    return _skills(spark, d).withColumn("tags", tags).filter(K.is_valid()).select("name")


_STUBBY = "concat(CASE WHEN doc_id % 4 = 0 THEN 'Implementing this specific pattern or feature. ' ELSE '' END, content)"


@query(f"WITH @skills SELECT name, content = '' OR (length(c) < 3000 AND contains(c, 'Implementing this specific pattern or feature')) AS stub FROM (SELECT *, {_STUBBY} AS c FROM skills)")
def stub_flag(spark, d):
    text = F.concat(F.when(F.col("doc_id") % 4 == 0, K.STUB_PHRASE + ". ").otherwise(""), "content")
    return _skills(spark, d).select("name", K.is_stub(text).alias("stub"))


@query("WITH @md SELECT category, count(*) AS n, count(*) FILTER (strlen(content) < 2000 AND (length(content) - length(replace(content, '```', ''))) // 3 < 2) AS stubs FROM (SELECT category, CASE WHEN doc_id % 2 = 0 THEN replace(content, '```', '') ELSE content END AS content FROM md) GROUP BY category")
def stub_report(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("content"), F.lit("```"), F.lit(""))).otherwise(F.col("content"))
    stub = (F.octet_length("text") < 2000) & (M.fence_count(F.col("text")) < 2)
    return _md(spark, d).select("category", text.alias("text")).groupBy("category").agg(F.count("*").alias("n"), F.count_if(stub).alias("stubs"))


@query("""WITH @md SELECT name, concat_ws('; ', CASE WHEN doc_id % 4 = 0 THEN 'sentinel' END, CASE WHEN strlen(c) < 3000 THEN 'small' END, CASE WHEN role = 'en' THEN 'few code blocks' END, CASE WHEN doc_id % 3 = 0 THEN 'stock phrases' END) AS reasons
FROM (SELECT name, doc_id, role, concat(content, CASE WHEN doc_id % 4 = 0 THEN 'Implementing this specific pattern or feature' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'identify the specific use case, iterate based on results' ELSE '' END) AS c FROM md)""")
def skill_gate(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.col("content"), F.when(i % 4 == 0, K.STUB_PHRASE).otherwise(""), F.when(i % 3 == 0, "identify the specific use case, iterate based on results").otherwise(""))
    role = F.when(F.col("role") == "en", "implementation").otherwise(F.col("role"))
    return _md(spark, d).select("name", F.concat_ws("; ", K.gate_reasons(text, role)).alias("reasons"))


@query("""WITH @md SELECT name, CASE WHEN doc_id % 7 = 0 THEN 'no front matter' ELSE '' END AS errors,
concat_ws('; ', CASE WHEN doc_id % 7 = 0 THEN NULL ELSE NULL END, 'missing metadata version', CASE WHEN doc_id % 7 = 0 THEN 'missing metadata domain' END, CASE WHEN doc_id % 7 = 0 THEN 'missing metadata role' END,
'missing metadata scope', 'missing metadata output-format', CASE WHEN doc_id % 7 = 0 THEN 'missing metadata triggers' END, CASE WHEN length(content) - CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 0 END < 3000 THEN 'short' END) AS warnings FROM md""")
def validate_skills(spark, d):
    text = F.when(F.col("doc_id") % 7 == 0, F.substring(F.col("content"), 5, 1 << 30)).otherwise(F.col("content"))
    errors, warnings = K.validation(text)
    return _md(spark, d).select("name", F.concat_ws("; ", errors).alias("errors"), F.concat_ws("; ", warnings).alias("warnings"))


@query(r"""WITH @marked SELECT doc_id, concat_ws('; ', CASE WHEN length(content) < 50 THEN 'too short' END, CASE WHEN NOT regexp_matches(regexp_replace(content, '(?s)\A---\r?\n.*?\r?\n---\s*', ''), '\A\s*# \S') THEN 'no title' END,
CASE WHEN (length(content) - length(replace(content, '```', ''))) // 3 % 2 = 1 THEN 'unbalanced code blocks' END, CASE WHEN starts_with(content, '---') AND NOT regexp_matches(content, '(?s)\A---\r?\n(.*?)\r?\n---') THEN 'open front matter' END,
CASE WHEN regexp_matches(regexp_replace(content, '\[[^\]\n]*\]\([^)\n]*\)', '', 'g'), '\]\([^)\n]*(\n|\z)') THEN 'open link' END) AS errors FROM marked""")
def markdown_validate(spark, d):
    return source(spark, d, "marked").select("doc_id", F.concat_ws("; ", M.markdown_errors(F.col("content"))).alias("errors"))


@query("WITH @md SELECT category, count(*) FILTER (doc_id % 3 = 0) AS present, count(*) FILTER (doc_id % 3 <> 0) AS absent FROM md GROUP BY category")
def section_presence(spark, d):
    text = F.concat(F.col("content"), F.when(F.col("doc_id") % 3 == 0, "## Tutorial\n").otherwise(" ## Tutorial\n"))
    has = text.rlike("(?m)^## Tutorial")
    return _md(spark, d).groupBy("category").agg(F.count_if(has).alias("present"), F.count_if(~has).alias("absent"))


@query("WITH @skills SELECT count(*) AS skills, count(DISTINCT category) AS categories, count(DISTINCT category) + count(DISTINCT role) AS tags, count(*) FILTER (draft) AS drafts, count(*) FILTER (length(content) < 3000) AS short FROM skills")
def registry_stats(spark, d):
    s = _skills(spark, d)
    tags = s.select(F.explode(F.array("category", "role")).alias("tag")).agg(F.countDistinct("tag"))
    counts = s.agg(F.count("*").alias("skills"), F.countDistinct("category").alias("categories"), F.count_if("draft").alias("drafts"), F.count_if(F.length("content") < 3000).alias("short"))
    return counts.select("skills", "categories", tags.scalar().alias("tags"), "drafts", "short")


@query("""WITH @skills, t AS (SELECT category AS tag, name FROM skills UNION ALL SELECT role, name FROM skills), k AS (SELECT tag, name, CAST((row_number() OVER (PARTITION BY tag ORDER BY name) - 1) // 100 AS INTEGER) AS page FROM t)
SELECT tag, page, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM k GROUP BY tag, page""")
def tag_postings(spark, d):
    """The names of each tag in order, in pages of a hundred: a tag may hold a third of all documents."""
    t = _skills(spark, d).select(F.explode(F.array("category", "role")).alias("tag"), F.col("name").alias("names"))
    return paged(t, "tag", "names", 100, ",")


#: Questions about tags, as bits and as SQL.
_ASKED = (
    ("both", ["src0", "en"], lambda a, b: a.bitwiseAND(b), "category = 'src0' AND role = 'en'"),
    ("either", ["src3", "fr"], lambda a, b: a.bitwiseOR(b), "category = 'src3' OR role = 'fr'"),
    ("without", ["src0", "en"], lambda a, b: a.bitwiseAND(F.bitwise_not(b)), "category = 'src0' AND role <> 'en'"),
    ("not", ["en"], lambda a: F.bitwise_not(a), "role <> 'en'"),
    ("mixed", ["src1", "src2", "draft", "none"], lambda a, b, c, d: a.bitwiseOR(b).bitwiseAND(F.bitwise_not(c)).bitwiseOR(d), "category IN ('src1', 'src2') AND NOT draft"),
)


def _bitmaps(spark, d):
    """The index of categories, roles and drafts, written in two batches and read back."""
    s = _skills(spark, d).select("doc_id", F.array("category", "role", F.when(F.col("draft"), "draft")).alias("tags"))
    old, new = (P.bitmaps(s.filter(f"doc_id % 3 {sign} 0"), "tags", "doc_id") for sign in ("<>", "="))
    path = tables.scratch(spark, "postings")
    P.save(P.extend(old, new), path)
    return P.load(spark, path)


@query("WITH @skills " + " UNION ALL ".join(f"SELECT '{q}' AS question, doc_id FROM skills WHERE {w}" for q, _, _, w in _ASKED))
def postings_boolean(spark, d):
    """Documents that answer AND, OR and NOT of tags, from bitmaps alone."""
    index = _bitmaps(spark, d)
    found = [P.ids_where(index, tags, rule).select(F.lit(q).alias("question"), F.col("id").alias("doc_id")) for q, tags, rule, _ in _ASKED]
    return reduce(DataFrame.union, found)


@query("WITH @skills " + " UNION ALL ".join(f"SELECT '{q}' AS question, count(*) AS n FROM skills WHERE {w}" for q, _, _, w in _ASKED))
def postings_counts(spark, d):
    index = _bitmaps(spark, d)
    return reduce(DataFrame.union, [P.count_where(index, tags, rule).select(F.lit(q).alias("question"), "n") for q, tags, rule, _ in _ASKED])


@query("WITH @skills SELECT category, role, count(*) AS n FROM skills GROUP BY category, role")
def domain_role_counts(spark, d):
    return _skills(spark, d).groupBy("category", "role").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT strlen(text) AS s FROM documents), k AS (SELECT CASE WHEN s < 1000 THEN 0 WHEN s < 2000 THEN 1 WHEN s < 3000 THEN 2 WHEN s < 5000 THEN 3 WHEN s < 10000 THEN 4 ELSE 5 END AS bucket FROM b)
SELECT CAST(r.bucket AS INTEGER) AS bucket, count(k.bucket) AS n, round(100.0 * count(k.bucket) / (SELECT count(*) FROM documents), 2) AS percent FROM (VALUES (0), (1), (2), (3), (4), (5)) r(bucket) LEFT JOIN k ON k.bucket = r.bucket GROUP BY r.bucket""")
def size_histogram(spark, d):
    counts = source(spark, d, "documents").groupBy(K.size_bucket(F.octet_length("text")).alias("bucket")).agg(F.count("*").alias("n"))
    out = spark.range(6).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").withColumn("total", counts.agg(F.sum("n")).scalar())
    return out.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("total"), 2).alias("percent"))


@query("WITH @skills SELECT category, count(*) AS n, count(*) FILTER (length(content) < 3000) AS short, round(100.0 * count(*) FILTER (length(content) < 3000) / count(*), 2) AS short_percent, count(*) FILTER (draft) AS drafts, sum(length(content))::BIGINT AS chars FROM skills GROUP BY category")
def corpus_report(spark, d):
    short = F.count_if(F.length("content") < 3000)
    return _skills(spark, d).groupBy("category").agg(F.count("*").alias("n"), short.alias("short"), F.round(100.0 * short / F.count("*"), 2).alias("short_percent"), F.count_if("draft").alias("drafts"), F.sum(F.length("content")).alias("chars"))


@query("WITH @skills SELECT category, name, CAST(row_number() OVER (PARTITION BY category ORDER BY CASE role WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, name) AS INTEGER) AS position FROM skills")
def catalog_listing(spark, d):
    roles = F.when(F.col("role") == "en", 0).when(F.col("role") == "de", 1).otherwise(2)
    return positions(_skills(spark, d).select("category", "name", roles.alias("way")), "category", "way", "name").drop("way")


@query("SELECT source AS domain, count(*) AS n, min(n_chars) AS smallest, max(n_chars) AS largest, round(avg(n_chars), 4) AS mean, count(*) FILTER (n_chars >= 3000) AS ok FROM documents GROUP BY source")
def batch_report(spark, d):
    return source(spark, d, "documents").groupBy(F.col("source").alias("domain")).agg(F.count("*").alias("n"), F.min("n_chars").alias("smallest"), F.max("n_chars").alias("largest"), F.round(F.avg("n_chars"), 4).alias("mean"), F.count_if(F.col("n_chars") >= 3000).alias("ok"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 15 END, 3) AS max_depth, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 15 END, 3) BETWEEN 1 AND 10 AS ok FROM customer")
def config_merge(spark, d):
    """New settings over old ones, with their bounds."""
    new = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 15)
    depth = F.coalesce(new, F.lit(3))
    return source(spark, d, "customer").select("c_custkey", depth.alias("max_depth"), depth.between(1, 10).alias("ok"))
