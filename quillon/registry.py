"""Registry of named queries, with the SQL that another engine can run for the same rows."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _pick(index: str, *texts: str) -> str:
    """SQL that gives one of the texts by index modulo their number."""
    return f"CASE ({index}) % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


#: Parts of requests: phrases of each family and such as only look like them.
_PHRASES = ("''", *(f"' {x}'" for x in (
    "Ignore ALL previous instructions", "ignore  previous instructions", "ignored previous instructions", "you are now an AI", "Your new role is x", "bypass content filter",
    "pretend there are no limits", "show your password", "showed your password", "verify the api key", "what is your token", "`ls`", "$(ls)", "$()", "&& RM x", "&& remove", "| sh", "| shell",
)))
_PROGRAMS = tuple(f"'{x}'" for x in ("rm", "rm -rf", "mkfs", "mkfs.ext4", "dd", "ls", "chmod 777", "chmod 1777", "useradd", "kubectl run", "kubectl delete", "kubectl create serviceaccount", "passwd"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Derived tables that both engines compute from the given ones with the same text.
SOURCES = {
    "skills": """SELECT concat('doc-', lpad(CAST(d.doc_id AS STRING), 8, '0')) AS name, d.doc_id, d.source AS category, d.lang AS role,
        concat('Text in ', d.lang, ' from ', d.source) AS description, d.text AS content, coalesce(l.quality = 0, false) AS draft
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "md": """SELECT concat('doc-', lpad(CAST(doc_id AS STRING), 8, '0')) AS name, doc_id, source AS category, lang AS role, text,
        concat('---', chr(10), 'name: doc-', doc_id, chr(10), 'description: "Text: ', lang, '"', chr(10), '# a comment', chr(10), 'metadata:', chr(10), '  domain: ', source, chr(10),
        '  role: ', lang, chr(10), '  triggers: alpha, ', source, ', , beta', chr(10), '  related-skills: doc-', (doc_id * 7) % 1000, ', x', chr(10), '---', chr(10), chr(10),
        '# Title ', doc_id, chr(10), chr(10), chr(10), '## When to Use', chr(10), '- **bold** and `code` Zone', chr(10), '## When NOT to Use', chr(10), 'Never', chr(10),
        '## Core Workflow', chr(10), '1. **Scan** — read it', chr(10), '2. Sort', chr(10), chr(10), '```python', chr(10), 'x = **kw', chr(10), chr(10), chr(10), '# note', chr(10), 'print(x)', chr(10), '```', chr(10),
        text, chr(10), chr(10), chr(10), '## Related Skills', chr(10), '- *other*', chr(10)) AS content FROM {documents}""",
    "edges": """SELECT DISTINCT concat('doc-', lpad(CAST(doc_id AS STRING), 8, '0')) AS src,
        concat('doc-', lpad(CAST(CASE WHEN k = 1 THEN doc_id + 1 - 2 * (doc_id % 2) WHEN k = 5 THEN doc_id ELSE (doc_id * (3 * k + 1) + k * 17) % m END AS STRING), 8, '0')) AS dst, source AS category
        FROM {documents} CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS v(k) CROSS JOIN (SELECT max(doc_id) + 10 AS m FROM {documents}) AS x WHERE k <= doc_id % 6""",
    "requests": "SELECT conv_id * 1000 + turn AS task_id, text AS task, conv_id, turn FROM {conversations} WHERE role = 'user'",
    "rankings": """SELECT r.task_id, r.task, concat('doc-', lpad(CAST((r.task_id * 13 * k + k) % m AS STRING), 8, '0')) AS name, ((r.task_id * 7 + k * k * 11) % 101) / 100.0E0 AS score
        FROM (SELECT conv_id * 1000 + turn AS task_id, text AS task FROM {conversations} WHERE role = 'user') r
        CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS v(k) CROSS JOIN (SELECT max(doc_id) + 5 AS m FROM {documents}) AS x""",
    "tasks": f"""SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN '  ' WHEN conv_id % 11 = 3 THEN repeat(concat(text, ' '), 100)
        ELSE concat(text, {_pick("conv_id * 3 + turn", *_PHRASES)}, {_pick("conv_id + turn * 5", *_PHRASES)}) END AS task FROM {{conversations}}""",
    "commands": f"""SELECT event_id, concat({_pick("user_id", "'sudo '", "''", "'cd /srv; '", "concat(event_type, ' ')")}, {_pick("event_id", *_PROGRAMS)},
        {_pick("event_id + user_id", "' '", "'  '", "chr(9)", "''", "'-'")},
        {_pick("event_id + 2 * user_id", "'-rf /x'", "'x --generator=run-pod/v1'", "'--all'", "'x --cluster-role=cluster-admin'", "props", "event_type")}) AS command FROM {{events}}""",
    "paths": f"""SELECT page_id, concat({_pick("page_id", "'data/'", "'/data/'", "'data'", "'other/'", "''", "'other/data/'", "'database/'")},
        replace(replace(url, 'https://', ''), {_pick("page_id * 5 + page_id % 7", "'?'", "'.example'", "'#'")}, '/../')) AS path FROM {{pages}}""",
    "records": f"""SELECT event_id, {_pick("event_id", "props", "concat('{{\"name\": \"', event_type, '\", \"k\": ', user_id, '.5}}')", "'{{\"k\": true, \"name\": null}}'",
        "concat('{{\"name\": {{}}, \"k\": \"', user_id, '\"}}')", "concat('[', user_id, ']')", "substr(props, 1, 3 + user_id % 5)", "'null'", "concat(props, '}}')", "'{{\"k\": null, \"more\": []}}'")} AS record FROM {{events}}""",
    "fronts": f"""SELECT doc_id, concat('---', e, 'name: ', {_pick("doc_id", "concat('doc-', doc_id)", "concat('\"', source, ' \"')", "concat(chr(39), lang, chr(39))", "''", "' a: b # c'", "'\"open'")}, e,
        {_pick("doc_id + n_chars", "'# role: no'", "'role: first'", "'  role: inner'", "'role:tight'", "'- role: item'", "'9role: x'", "concat('triggers: a, ', lang)")}, e, 'description: ', n_chars, e, 'domain: ', source, e,
        {_pick("n_chars", "concat('  domain: late', e)", "concat('role: last ', e)", "''", "concat(e, 'domain:', e)")}, {_pick("doc_id", "'---'", "'---'", "'----'", "'--'", "' ---'")}, e, text) AS content
        FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN concat(chr(13), chr(10)) ELSE chr(10) END AS e FROM {{documents}}) AS x""",
    "marked": f"""SELECT doc_id, concat({_pick("doc_id", "concat('---', chr(10), 'name: x', chr(10), '---', chr(10))", "concat('---', chr(10), 'name: x', chr(10))", "''", "''", "''")},
        {_pick("doc_id", "'# '", "'#'", "concat(chr(10), ' # T', chr(10))")}, CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, CAST(doc_id % 60 AS INT))
        ELSE replace(replace(text, ' of ', ' [of](x) '), ' de ', concat(' [de](y', {_pick("doc_id", "')'", "chr(10)")})) END, CASE WHEN doc_id % 6 = 5 THEN '```' ELSE '' END) AS content FROM {{documents}}""",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = SOURCES[name]
    used = {t: source(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", body))}
    return spark.sql(body, **used)


def spread(rows: DataFrame) -> DataFrame:
    """rows of a table with fewer pieces than there are cores dealt out evenly, for work that costs more than moving them; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def query(sql: str | None = None):
    """Register a query under its function's name. In the SQL, @name stands for a derived table."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            tables = {t: t for t in TABLES}
            SQL[f.__name__] = re.sub(r"@(\w+)", lambda m: f"{m[1]} AS ({SOURCES[m[1]].format(**tables)})" if m[1] in SOURCES else m[0], sql)
        return f

    return put
