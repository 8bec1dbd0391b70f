"""Routing queries: every user turn is a request with scored candidates."""
from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import safety as S
from ..plans import levels as L
from ..plans import planner as P
from ..registry import query, source

_W = "WITH @skills, @rankings"
_K = "k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, name) - 1 AS rank FROM rankings)"
_SEL = "k AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, name) - 1 AS rank FROM rankings WHERE name NOT IN (SELECT name FROM skills WHERE draft)), s AS (SELECT *, CASE WHEN rank = 0 THEN 'primary' ELSE 'supporting' END AS role FROM k WHERE rank < 5 AND score >= 0.5)"


def _rankings(spark, d):
    return source(spark, d, "rankings").select("task_id", "task", "name", "score")


def _drafts(spark, d):
    return source(spark, d, "skills").filter("draft")


def _selection(spark, d):
    return R.selected(_rankings(spark, d), _drafts(spark, d)).withColumn("role", R.role_of(F.col("rank")))


@query(_W + " SELECT task_id, name, score FROM rankings WHERE name NOT IN (SELECT name FROM skills WHERE draft)")
def draft_gate(spark, d):
    return R.without_drafts(_rankings(spark, d), _drafts(spark, d)).select("task_id", "name", "score")


@query(_W + " SELECT task_id, name, score FROM rankings WHERE name IN (SELECT name FROM skills)")
def rank_semi(spark, d):
    return R.known_only(_rankings(spark, d), source(spark, d, "skills")).select("task_id", "name", "score")


@query(f"{_W}, {_SEL} SELECT task_id, name, score, CAST(rank AS INTEGER) AS rank FROM s WHERE contains(lower(name), '1') OR contains(lower(name), 'doc-00000002')")
def route_select(spark, d):
    return R.selected(_rankings(spark, d), _drafts(spark, d), 0, ["1", "DOC-00000002"]).select("task_id", "name", "score", "rank")


@query(f"{_W}, {_K} SELECT task_id, name, CAST(rank AS INTEGER) AS rank FROM k WHERE rank < 10")
def rank_candidates(spark, d):
    return R.capped(_rankings(spark, d)).select("task_id", "name", "rank")


@query(f"{_W}, {_SEL} SELECT task_id, name, role FROM s")
def rank_roles(spark, d):
    return _selection(spark, d).select("task_id", "name", "role")


_P1, _P2, _P3 = ("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in R.PROMPT)


@query(f"{_W}, {_K} SELECT task_id, {_P1} || task || {_P2} || string_agg((rank + 1) || '. ' || name || ': ' || coalesce(description, 'unknown'), chr(10) ORDER BY rank) || {_P3} AS prompt FROM (SELECT k.*, s.description FROM k LEFT JOIN skills s ON s.name = k.name WHERE rank < 10) GROUP BY task_id, task")
def rank_prompt(spark, d):
    k = R.capped(_rankings(spark, d)).join(source(spark, d, "skills").select("name", "description"), "name", "left")
    return R.prompts(k.withColumn("description", F.coalesce("description", F.lit("unknown"))))


@query(f"{_W}, {_SEL} SELECT r.task_id, round(least(1.0, coalesce(CASE WHEN min_by(score, rank) > 0.8 THEN avg(score) * 1.1 ELSE avg(score) END, 0)), 6) AS confidence FROM (SELECT DISTINCT task_id FROM rankings) r LEFT JOIN s ON s.task_id = r.task_id GROUP BY r.task_id")
def route_confidence(spark, d):
    tasks = _rankings(spark, d).select("task_id").distinct()
    return tasks.join(_selection(spark, d), "task_id", "left").groupBy("task_id").agg(F.round(R.confidence(F.col("score"), F.col("rank")), 6).alias("confidence"))


@query(f"{_W}, {_SEL} SELECT task_id, string_agg(name || '=' || printf('%.2f', score), ';' ORDER BY name) AS scores FROM (SELECT task_id, name, max(score) AS score FROM s GROUP BY task_id, name) GROUP BY task_id")
def routing_scores(spark, d):
    best = _selection(spark, d).groupBy("task_id", "name").agg(F.max("score").alias("score"))
    m = best.groupBy("task_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "score")))).alias("m"))
    return m.select("task_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ";").alias("scores"))


@query(f"{_W} SELECT task_id, sha256(lower(trim(task)) || '|' || string_agg(name, ',' ORDER BY name)) AS key FROM rankings GROUP BY task_id, task")
def rank_cache_key(spark, d):
    g = _rankings(spark, d).groupBy("task_id", "task").agg(F.collect_list("name").alias("names"))
    return g.select("task_id", R.ranking_key(F.col("task"), F.col("names")).alias("key"))


@query("""WITH r AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN concat('  ', event_type, ' ') ELSE concat(event_type, user_id) END AS task,
CASE user_id % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b', 'a'] WHEN 2 THEN ['b'] ELSE ['c', 'b', 'a'] END AS names FROM events),
k AS (SELECT id, sha256(lower(trim(task)) || '|' || array_to_string(list_sort(names), ',')) AS key FROM r), s AS (SELECT *, min(id) OVER (PARTITION BY key) AS served_by FROM k) SELECT id, key, served_by, id <> served_by AS hit FROM s""")
def ranking_cache(spark, d):
    """Repeated requests, in other cases, with blanks around or their candidates in another order, read the first one's ranking."""
    e, user = source(spark, d, "events"), F.col("user_id") % 4
    task = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), "event_type", F.lit(" "))).otherwise(F.concat("event_type", "user_id"))
    some = lambda *xs: F.array(*map(F.lit, xs))
    names = F.when(user == 0, some("a", "b")).when(user == 1, some("b", "a")).when(user == 2, some("b")).otherwise(some("c", "b", "a"))
    return R.cached_rankings(e.select(F.col("event_id").alias("id"), task.alias("task"), names.alias("names")))


@query(f"""{_W}, {_SEL}, p AS (SELECT task_id, count(*) AS n, bool_or(role = 'supporting') AS sup FROM s GROUP BY task_id)
SELECT r.task_id, CASE WHEN coalesce(n, 0) <= 1 THEN 'sequential' WHEN sup THEN 'hybrid' ELSE 'sequential' END AS strategy FROM (SELECT DISTINCT task_id FROM rankings) r LEFT JOIN p ON p.task_id = r.task_id""")
def plan_strategy(spark, d):
    s = _selection(spark, d).join(source(spark, d, "skills").select("name", "category"), "name", "left")
    return P.strategy(s, _rankings(spark, d).select("task_id", "task").distinct())


_STEPS = "st AS (SELECT task_id, rank, name, role, row_number() OVER w - 1 AS step, first_value(name) OVER w AS first FROM s WINDOW w AS (PARTITION BY task_id ORDER BY rank))"


@query(f"{_W}, {_SEL}, {_STEPS} SELECT task_id, CAST(step AS INTEGER) AS step, name, CASE WHEN step > 0 THEN CASE WHEN role = 'supporting' THEN first ELSE lag(name) OVER (PARTITION BY task_id ORDER BY rank) END END AS depends_on FROM st")
def plan_dependencies(spark, d):
    return P.steps(_selection(spark, d)).select("task_id", "step", "name", "depends_on")


@query(f"{_W}, {_SEL} SELECT task_id, count(*) || ' skill(s): ' || string_agg(name, ', ' ORDER BY rank) || '. Roles: ' || string_agg(name || ' (' || role || ')', ', ' ORDER BY rank) || '.' AS summary FROM s GROUP BY task_id")
def plan_steps(spark, d):
    return P.summary(_selection(spark, d))


_PLAN = "SELECT conv_id AS task_id, turn AS step, concat('s', turn) AS name, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 7 = 5 THEN concat('s', turn + 1) WHEN turn % 11 = 10 THEN concat('s', turn) ELSE concat('s', turn - 1 - turn % 2) END AS depends_on FROM conversations"


def _plan(spark, d):
    return spark.sql(_PLAN.replace("conversations", "{c}"), c=source(spark, d, "conversations")).distinct()


@query(f"WITH p AS (SELECT DISTINCT * FROM ({_PLAN})) SELECT task_id, step, name, depends_on FROM p WHERE depends_on IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p e WHERE e.task_id = p.task_id AND e.name = p.depends_on AND e.step <= p.step)")
def plan_validate(spark, d):
    return P.invalid(_plan(spark, d))


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT * FROM ({_PLAN})), r AS (SELECT task_id, name, 0 AS depth FROM p WHERE depends_on IS NULL UNION ALL SELECT p.task_id, p.name, depth + 1 FROM p JOIN r ON p.task_id = r.task_id AND p.depends_on = r.name),
l AS (SELECT p.task_id, p.name, max(depth) AS stage FROM p LEFT JOIN r ON r.task_id = p.task_id AND r.name = p.name GROUP BY p.task_id, p.name)
SELECT task_id, CAST(stage AS INTEGER) AS stage, string_agg(name, ',' ORDER BY name) AS names, CASE WHEN count(*) > 1 THEN 'parallel-group' ELSE 'single' END AS kind FROM l GROUP BY task_id, stage""")
def plan_stages(spark, d):
    return P.stages(_plan(spark, d))


_GRAPH = """SELECT 1 AS task_id, concat('s', event_id) AS name, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 97 = 5 THEN concat('s', event_id + 2) WHEN event_id % 211 = 7 THEN concat('s', event_id)
ELSE concat('s', event_id - 1 - (event_id * 7) % 13) END AS depends_on FROM {e} UNION ALL SELECT 1, concat('s', event_id), concat('s', event_id - 3) FROM {e} WHERE event_id % 11 = 3"""
_DEPTHS = f"""p AS ({_GRAPH.format(e="events")}), w AS (SELECT name, count(DISTINCT depends_on) AS need FROM p GROUP BY name), u AS MATERIALIZED (SELECT DISTINCT name, depends_on AS d FROM p WHERE depends_on IS NOT NULL),
far AS MATERIALIZED (SELECT name, d FROM u UNION SELECT far.name, u.d FROM far JOIN u ON far.d = u.name), tied AS MATERIALIZED (SELECT DISTINCT name FROM far WHERE name = d),
first AS (SELECT name FROM u WHERE d NOT IN (SELECT name FROM w) UNION SELECT name FROM tied), bad AS (SELECT name FROM first UNION SELECT u.name FROM u JOIN bad ON u.d = bad.name),
free AS MATERIALIZED (SELECT name, d FROM u WHERE name NOT IN (SELECT name FROM tied)), r AS (SELECT name, 0 AS depth FROM w WHERE need = 0 UNION SELECT free.name, depth + 1 FROM free JOIN r ON free.d = r.name)"""


def _whole_graph(spark, d):
    """All events as the steps of one plan."""
    return spark.sql(_GRAPH, e=source(spark, d, "events"))


@query(f"WITH RECURSIVE {_DEPTHS} SELECT w.name, CASE WHEN w.name IN (SELECT name FROM bad) THEN NULL ELSE max(depth) END AS stage FROM w LEFT JOIN r ON r.name = w.name GROUP BY w.name")
def plan_levels(spark, d):
    """Levels of one plan that holds every event."""
    return L.levels(_whole_graph(spark, d)).select("name", "stage")


_RUNS = "SELECT user_id AS task_id, event_id AS step, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events"


def _runs(spark, d):
    return spark.sql(_RUNS.replace("FROM events", "FROM {e}"), e=source(spark, d, "events"))


@query(f"WITH r AS ({_RUNS}), f AS (SELECT task_id, min(step) FILTER (status <> 'success') AS first FROM r GROUP BY task_id) SELECT r.* FROM r JOIN f ON f.task_id = r.task_id WHERE first IS NULL OR step <= first")
def exec_cutoff(spark, d):
    return P.cut_off(_runs(spark, d))


@query(f"WITH r AS ({_RUNS}) SELECT task_id, CASE WHEN bool_and(status = 'success') THEN 'success' ELSE 'partial_failure' END AS status FROM r GROUP BY task_id")
def exec_status(spark, d):
    return _runs(spark, d).groupBy("task_id").agg(P.overall(F.col("status") == "success").alias("status"))


@query("SELECT * FROM (VALUES (1, 100::BIGINT), (2, 200::BIGINT)) v(retry, delay_ms)")
def backoff_schedule(spark, d):
    return spark.range(1, P.RETRIES + 1).select(F.col("id").cast("int").alias("retry"), P.backoff_ms(F.col("id")).alias("delay_ms"))


@query(f"{_W}, {_SEL} SELECT task_id, string_agg('# ' || s.name || chr(10) || k.content, chr(10) || '---' || chr(10) ORDER BY rank) AS content FROM s JOIN skills k ON k.name = s.name GROUP BY task_id")
def route_content(spark, d):
    s = _selection(spark, d).join(source(spark, d, "skills").select("name", "content"), "name")
    g = s.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("# "), "name", F.lit("\n"), "content").alias("text")))).alias("s"))
    return g.select("task_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n---\n").alias("content"))


_FOUND = ", ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(task, '{p}')" for p in ps)} THEN '{name}' END" for name, ps in S.FAMILIES)
_SCAN = f"WITH @tasks, f AS (SELECT *, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS found FROM tasks), s AS (SELECT *, CASE WHEN len(found) = 0 THEN 'low' WHEN len(found) = 1 THEN 'medium' WHEN list_contains(found, 'potential-command-injection') THEN 'critical' ELSE 'high' END AS risk, array_to_string(found, '+') AS flags FROM f)"


@query(f"{_SCAN} SELECT conv_id, turn, flags, len(found) < 2 AS is_safe, risk FROM s")
def injection_scan(spark, d):
    x = source(spark, d, "tasks").select("conv_id", "turn", S.injection_scan(F.col("task")).alias("x"))
    return x.select("conv_id", "turn", F.array_join("x.flags", "+").alias("flags"), "x.is_safe", "x.risk")


@query(f"""{_SCAN}, r AS (SELECT conv_id, turn, CASE WHEN trim(task) = '' THEN 'critical empty-task' WHEN length(task) > {S.LONGEST_TASK} THEN 'high task-too-long' WHEN len(found) > 1 THEN concat(risk, ' ', flags)
WHEN conv_id % 3 = 1 THEN 'high category-not-allowed' END AS r FROM s) SELECT conv_id, turn, r IS NULL AS is_safe, coalesce(split_part(r, ' ', 1), 'low') AS risk, coalesce(split_part(r, ' ', 2), '') AS flag FROM r""")
def validate_request(spark, d):
    wanted = F.when(F.col("conv_id") % 3 == 1, F.array(F.lit("a"), F.lit("z"))).otherwise(F.array(F.lit("a")))
    x = source(spark, d, "tasks").select("conv_id", "turn", S.validate_request(F.col("task"), F.array(F.lit("a"), F.lit("b")), wanted).alias("x"))
    return x.select("conv_id", "turn", "x.*")


@query(f"WITH @commands SELECT event_id, command, {' OR '.join(f"regexp_matches(command, '{p}')" for p in S.DENIED + S.DENIED_CLUSTER)} AS denied FROM commands")
def deny_list(spark, d):
    return source(spark, d, "commands").select("event_id", "command", S.any_of(F.col("command"), S.DENIED + S.DENIED_CLUSTER).alias("denied"))


@query("WITH @paths SELECT page_id, path, NOT contains(path, '..') AND path[1] <> '/' AND regexp_matches(path, '^(data|other)/') AS allowed FROM paths")
def path_guard(spark, d):
    return source(spark, d, "paths").select("page_id", "path", S.path_allowed(F.col("path"), ["data", "other/"]).alias("allowed"))


@query("WITH @skills SELECT name, doc_id % 5 = 0 OR list_contains(['en', 'fr', 'de', 'es'][1:doc_id % 5], role) AS allowed FROM skills")
def allow_list(spark, d):
    allowed = F.slice(F.array(*map(F.lit, ("en", "fr", "de", "es"))), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    return source(spark, d, "skills").select("name", S.allow_listed(F.col("role"), allowed).alias("allowed"))


@query("""WITH @records, t AS (SELECT event_id, record, json_valid(record) AS ok, CASE WHEN json_valid(record) THEN record END AS j FROM records)
SELECT event_id, CASE WHEN NOT ok THEN 'not JSON' WHEN json_type(j) <> 'OBJECT' THEN 'not an object' ELSE concat_ws('+', CASE WHEN json_type(j, '$.k') IS NULL THEN 'missing k' END, CASE WHEN json_type(j, '$.name') IS NULL THEN 'missing name' END,
CASE WHEN json_type(j, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'k is not number' END) END AS errors FROM t""")
def schema_check(spark, d):
    rules = '{"required": ["k", "name"], "properties": {"k": {"type": "number"}}}'
    return source(spark, d, "records").select("event_id", F.array_join(S.schema_errors(F.col("record"), rules), "+").alias("errors"))
