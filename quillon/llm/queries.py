"""The operators over the given tables, as registered queries with their SQL where there is some."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, exact, html, near, packing, pii, quality, releases, spelling, syncmers, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after(start: str, minutes):
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))


def dated_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2024 that follows from page_id: the table has none."""
    return pages.select("page_id", "url", minutes_after("2024-01-01 00:00:00", F.col("page_id") * 7919 % 525_600).alias("fetched_at"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List events that follow from the hosts seen: the tables have no list."""
    host = urls.host_of(F.col("url"))
    hosts = pages.select("page_id", host.alias("host")).filter("host <> ''").groupBy("host").agg(F.min("page_id").alias("m"), F.count("*").alias("n"))
    domains = hosts.withColumn("host", F.regexp_extract("host", r"[^.]+\.[^.]+$", 0)).groupBy("host").agg(F.min("m").alias("m"), F.sum("n").alias("n"))
    m, n = F.col("m"), F.col("n")

    def events(source: DataFrame, suffix: str, kind: str, *dated) -> DataFrame:
        rows = F.array(*(F.struct(F.lit(a).alias("action"), (day * 1440).alias("minute")) for a, day in dated))
        return source.select(F.concat("host", F.lit(suffix)).alias("pattern"), F.lit(kind).alias("list"), F.inline(rows)).select("pattern", "list", "action", minutes_after("2024-01-01 00:00:00", F.col("minute")).alias("at"))

    return (
        events(hosts, "", "block", ("add", m % 200), ("remove", m % 200 + 40 + n % 60), ("add", m % 200 + 150))
        .unionByName(events(hosts, "/en", "allow", ("add", m * 3 % 180)))
        .unionByName(events(domains, "", "block", ("add", m % 100), ("remove", m % 100 + 90)))
    )


def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = urls.filter_captures(dated_captures(pages), dated_entries(pages))
    return found.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm").alias("fetched_at"), "matched_list", "matched_pattern", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "blocked")


OP1_SQL = r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS fetched_at,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
         regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*/+([^/?#]+)', 1) AS seg
  FROM pages),
h AS (SELECT host, min(page_id) AS m, count(*) AS n FROM c WHERE host <> '' GROUP BY host),
d AS (SELECT regexp_extract(host, '[^.]+\.[^.]+$', 0) AS host, min(m) AS m, sum(n) AS n FROM h GROUP BY 1),
e AS (
  SELECT host AS pattern, host, '' AS seg, 'block' AS list, 'add' AS action, m % 200 AS day FROM h
  UNION ALL SELECT host, host, '', 'block', 'remove', m % 200 + 40 + n % 60 FROM h
  UNION ALL SELECT host, host, '', 'block', 'add', m % 200 + 150 FROM h
  UNION ALL SELECT host || '/en', host, 'en', 'allow', 'add', m * 3 % 180 FROM h
  UNION ALL SELECT host, host, '', 'block', 'add', m % 100 FROM d
  UNION ALL SELECT host, host, '', 'block', 'remove', m % 100 + 90 FROM d),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day, action = 'remove') AS until FROM e),
v AS (SELECT pattern, host, seg, list, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INTEGER)) AS valid_from,
             TIMESTAMP '2024-01-01' + to_days(CAST(until AS INTEGER)) AS valid_to
      FROM i WHERE action = 'add' AND (until IS NULL OR day < until)),
r AS (
  SELECT c.page_id, c.url, c.fetched_at, v.list, v.pattern, v.valid_from,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC NULLS LAST, v.list = 'allow' DESC NULLS LAST, v.list DESC, v.pattern DESC) AS k
  FROM c LEFT JOIN v ON (c.host = v.host OR ends_with(c.host, '.' || v.host)) AND (v.seg = '' OR v.seg = c.seg)
       AND c.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to))
SELECT page_id, url, strftime(fetched_at, '%Y-%m-%d %H:%M') AS fetched_at, list AS matched_list, pattern AS matched_pattern,
       strftime(valid_from, '%Y-%m-%d') AS valid_from, coalesce(list <> 'allow', false) AS blocked
FROM r WHERE k = 1
"""


def op2_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
k AS (SELECT doc_id, count(DISTINCT p + d) AS n FROM r, (VALUES (0), (1), (2)) s(d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         length(text) - length(translate(text, '!', '')) AS n_exclaim,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains({stop}, lower(x)))) AS n_stop
  FROM w LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words AND n_symbols / n_words <= 0.12
       AND n_exclaim / n_words <= 0.25 AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND n_repeat_words / n_words <= 0.5 AS kept,
       n_stop, n_lines, n_exclaim
FROM f
""".replace("{stop}", "[" + ", ".join(f"'{w}'" for w in quality.STOP_WORDS) + "]")


def op6_html_extraction(spark, sf_dir):
    return html.main_texts(table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op9_substring_dedup(spark, sf_dir):
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark, sf_dir):
    return near.jaccard_classes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE s >= 0.8 * (x.n + y.n - s) - 1e-9),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, least(doc_id, min(other)) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT t.doc_id, coalesce(class_id, t.doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""


#: Check sums in SQL: the table of single bytes, and the check sum of what a text of hexadecimal digits stands for.
CRC_TABLE = """tbl AS MATERIALIZED (SELECT list(c ORDER BY i) AS tbl FROM (
  SELECT i, list_reduce([CAST(i AS BIGINT)] || CAST(range(8) AS BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i)))"""
CRC = """xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda a, b: xor(a // 256, tbl[xor(a, b) % 256 + 1])), 4294967295)"""


def op11_cascading_release(spark, sf_dir):
    return releases.releases(table(spark, sf_dir, "conversations"))


def _outcome(start: str) -> str:
    """SQL of the attempts of a turn that starts at a second: times, and the number of the first that delivers."""
    times = f"[{start}, {start} + 20, {start} + 60, {start} + 140]"
    good = f"list_filter([1, 2, 3, 4], lambda a: NOT (h[2] % 101 < 20 AND ({times}[a] < 7 * p + h[3] % 101 OR h[a + 3] % 3 = 0)))[1]"
    return f"{start} AS first_at, {times} AS times, {good} AS good"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, text, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p FROM conversations),
s AS (SELECT conv, p, k, hex(encode(CASE WHEN k = 7 THEN coalesce(text, '') ELSE concat(k, ':', conv, ':', turn) END)) AS x FROM c CROSS JOIN range(8) r(k)),
x AS MATERIALIZED (SELECT conv, p, list(h ORDER BY k) AS h FROM (SELECT conv, p, k, {CRC} AS h FROM s, tbl) GROUP BY conv, p),
t AS MATERIALIZED (SELECT c.conv_id, c.turn, conv, p, h, CASE WHEN h[1] % 7 > 0 AND h[1] % 7 <= p THEN p - h[1] % 7 END AS parent FROM c JOIN x USING (conv, p)),
r AS (SELECT conv, p, 'open' AS above, {_outcome("CAST(7 * p AS BIGINT)")} FROM t WHERE parent IS NULL
  UNION ALL SELECT conv, p, above, {_outcome("began")} FROM (
    SELECT t.conv, t.p, t.h, CASE WHEN r.above = 'blocked' OR r.good IS NULL THEN 'blocked' ELSE 'open' END AS above, greatest(7 * t.p, coalesce(r.times[r.good], 0)) AS began FROM r JOIN t ON t.conv = r.conv AND t.parent = r.p)),
d AS (SELECT t.conv_id, t.turn, conv, p, h[8] AS crc, CASE WHEN above = 'blocked' THEN 'blocked' WHEN good IS NULL THEN 'dead' ELSE 'delivered' END AS status, CASE WHEN above = 'blocked' THEN 0 ELSE coalesce(good, 4) END AS attempts,
  CASE WHEN above <> 'blocked' THEN first_at END AS first_at, CASE WHEN above <> 'blocked' THEN times[coalesce(good, 4)] END AS last_at FROM r JOIN t USING (conv, p)),
n AS (SELECT *, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY conv, status ORDER BY last_at, p) END AS release_no FROM d)
SELECT conv_id, turn, status, CAST(attempts AS INTEGER) AS attempts, first_at, last_at, release_no,
  CASE WHEN status = 'delivered' THEN CAST(sum(release_no * crc) OVER (PARTITION BY conv, status ORDER BY last_at, p) AS BIGINT) END AS state FROM n
"""


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
w AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{6,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT hex(encode(id || ':' || run)) AS x, run, count(*) AS n FROM w GROUP BY id, run),
x AS (SELECT run, n, {CRC} AS h FROM g, tbl),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM x),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.part UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.part),
k AS (SELECT p.word, other, v.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, other) AS r FROM p JOIN v ON v.word = other),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN k ON k.word = v.word AND r = 1),
o AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, o.root FROM o JOIN f ON f.form = o.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN o ON o.word = f.word
"""


def op13_syncmer_fingerprints(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_pii, op3_bpe, op4_toxicity, op5_quality_rules, op6_html_extraction, op7_best_fit_packing, op8_exact_dedup, op9_substring_dedup, op10_ngram_jaccard_join,
    op11_cascading_release, op12_spelling_variants, op13_syncmer_fingerprints,
)}
SQL = {"op1_url_filter": OP1_SQL, "op5_quality_rules": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_cascading_release": OP11_SQL, "op12_spelling_variants": OP12_SQL}
