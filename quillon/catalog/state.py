"""State queries over the event log: user_id is the key, props.k the level, value a size or a latency."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state as S
from ..registry import query, source
from ..sources.tables import scratch
from ..sources.versions import VersionStore

_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


def _events(spark, d):
    e = source(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", S.micros(F.col("ts")).alias("us"), F.from_json("props", "k long")["k"].alias("k"))


_REPLAY = "r AS (SELECT *, us - lag(us) OVER (PARTITION BY {keys} ORDER BY us, event_id) AS gap FROM e), o AS (SELECT *, CASE WHEN gap IS NULL THEN 'miss' WHEN gap <= {ttl} THEN 'hit' ELSE 'expired' END AS outcome FROM r)"
_TTL = _REPLAY.format(keys="user_id", ttl=S.TTL)


@query(f"{_E}, {_TTL} SELECT event_id, user_id, outcome FROM o")
def ttl_replay(spark, d):
    return S.ttl_replay(_events(spark, d), F.lit(S.TTL), "user_id").select("event_id", "user_id", "outcome")


@query(f"{_E}, " + _REPLAY.format(keys="user_id, k % 3", ttl=f"CASE WHEN user_id % 4 = 0 THEN {S.HOT_TTL} ELSE {S.TTL} END") + " SELECT event_id, user_id || '@L' || (k % 3) AS key, outcome FROM o")
def adaptive_ttl_replay(spark, d):
    """Hot keys have the shorter time to live."""
    e = _events(spark, d).withColumn("level", F.col("k") % 3)
    ttl = F.when(F.col("user_id") % 4 == 0, S.HOT_TTL).otherwise(S.TTL)
    return S.ttl_replay(e, ttl, "user_id", "level").select("event_id", F.concat("user_id", F.lit("@L"), "level").alias("key"), "outcome")


@query(f"{_E}, {_TTL} SELECT count(DISTINCT user_id) AS size, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome <> 'hit') AS misses, count(*) FILTER (outcome = 'expired') AS expirations FROM o")
def cache_stats(spark, d):
    o = F.col("outcome")
    return S.ttl_replay(_events(spark, d), F.lit(S.TTL), "user_id").agg(F.countDistinct("user_id").alias("size"), F.count_if(o == "hit").alias("hits"), F.count_if(o != "hit").alias("misses"), F.count_if(o == "expired").alias("expirations"))


_AW = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, us AS start, n, 0::BIGINT AS win, 1::BIGINT AS c FROM e WHERE n = 1
 UNION ALL SELECT e.event_id, e.user_id, CASE WHEN e.us - w.start >= {S.WINDOW} THEN e.us ELSE w.start END, e.n, CASE WHEN e.us - w.start >= {S.WINDOW} THEN win + 1 ELSE win END, CASE WHEN e.us - w.start >= {S.WINDOW} THEN 1 ELSE c + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)"""


@query(_AW + ' SELECT user_id, event_id, win AS "window", c AS in_window FROM w')
def access_windows(spark, d):
    return S.access_windows(_events(spark, d))


@query(_AW + " SELECT user_id, event_id FROM w WHERE c > 2")
def deferred_retry(spark, d):
    return S.access_windows(_events(spark, d)).filter("in_window > 2").select("user_id", "event_id")


_VERSIONS = "v AS (SELECT user_id, us // 86400000000 AS version, min(us) AS created, max(us) AS last, count(*) AS accesses FROM e GROUP BY user_id, us // 86400000000), m AS (SELECT max(us) AS now FROM e)"


def _versions(spark, d):
    e = _events(spark, d)
    v = e.groupBy("user_id", F.floor(F.col("us") / 86_400_000_000).alias("version")).agg(F.min("us").alias("created"), F.max("us").alias("last"), F.count("*").alias("accesses"))
    return v.withColumn("now", e.agg(F.max("us")).scalar())


@query(f"{_E}, {_VERSIONS} SELECT user_id, version, accesses FROM v, m WHERE now - created <= {S.FRESH}")
def fresh_versions(spark, d):
    return _versions(spark, d).filter(F.col("now") - F.col("created") <= S.FRESH).select("user_id", "version", "accesses")


_EXP = f"x AS (SELECT user_id, version, CASE WHEN now - created <= {S.FRESH // 7} THEN 'keep' WHEN accesses > 2 AND now - last < {S.WINDOW} THEN 'defer' ELSE 'delete' END AS action FROM v, m)"


def _expiry(spark, d):
    v = _versions(spark, d)
    return v.select("user_id", "version", S.expiry(F.col("now") - F.col("created"), F.col("now") - F.col("last"), F.col("accesses"), S.FRESH // 7).alias("action"))


@query(f"{_E}, {_VERSIONS}, {_EXP} SELECT * FROM x")
def expiry_classify(spark, d):
    return _expiry(spark, d)


@query(f"{_E}, {_VERSIONS}, {_EXP} SELECT count(*) AS scanned, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'defer') AS deferred, count(*) FILTER (action = 'delete') * 1024 AS freed FROM x")
def cleanup_totals(spark, d):
    gone = F.count_if(F.col("action") == "delete")
    return _expiry(spark, d).agg(F.count("*").alias("scanned"), gone.alias("deleted"), F.count_if(F.col("action") == "defer").alias("deferred"), (gone * 1024).alias("freed"))


@query(f"""{_E}, {_VERSIONS}, {_EXP} SELECT v.user_id, v.version, v.accesses FROM v JOIN x USING (user_id, version) WHERE action <> 'delete'
UNION ALL SELECT user_id, version, 0 FROM x WHERE action = 'delete' AND user_id % 3 = 0""")
def version_compaction(spark, d):
    """A store whose expired versions are removed, compacted, of which some are written again; read back after the folders are gone."""
    store = VersionStore(spark, scratch(spark, "version-store"), "user_id long, version long, created long, accesses long", ("user_id", "version"))
    v = _versions(spark, d)
    store.write(v)
    gone = _expiry(spark, d).filter("action = 'delete'").select("user_id", "version")
    now = v.agg(F.max("now")).scalar()
    store.remove(gone.withColumn("now", now), F.col("now"))
    store.compact()
    store.write(gone.filter("user_id % 3 = 0").select("user_id", "version", (now + 1).alias("created"), F.lit(0).cast("long").alias("accesses")))
    store.compact()
    store.vacuum()
    return store.read().select("user_id", "version", "accesses")


_FLUSH = """WITH RECURSIVE e AS (SELECT user_id, value, epoch_us(ts) // {flush} AS slot, row_number() OVER (PARTITION BY epoch_us(ts) // {flush} ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT slot, n, user_id, value, 0::BIGINT AS flush, [user_id] AS held FROM e WHERE n = 1
 UNION ALL SELECT e.slot, e.n, e.user_id, e.value, CASE WHEN len(held) >= {size} THEN flush + 1 ELSE flush END, CASE WHEN len(held) >= {size} THEN [e.user_id] WHEN list_contains(held, e.user_id) THEN held ELSE list_append(held, e.user_id) END FROM w JOIN e ON e.slot = w.slot AND e.n = w.n + 1),
l AS (SELECT user_id, slot, flush, max_by(value, n) AS value FROM w GROUP BY user_id, slot, flush)
SELECT user_id, slot, flush, value, (row_number() OVER (PARTITION BY slot, flush ORDER BY user_id) - 1) // 10 AS batch FROM l"""


@query(_FLUSH.format(flush=5_000_000, size=50))
def write_coalesce(spark, d):
    return S.last_writes(_events(spark, d), "user_id")


@query(_FLUSH.format(flush=43_200_000_000, size=20))
def write_flush(spark, d):
    """Half-day intervals, in which twenty waiting keys trigger the flush."""
    return S.last_writes(_events(spark, d), "user_id", size=20, flush=43_200_000_000)


_BUSY = 45 * S.MINUTE


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, n, us AS start, event_id AS served_by FROM e WHERE n = 1
 UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.us >= start + {_BUSY} THEN e.us ELSE start END, CASE WHEN e.us >= start + {_BUSY} THEN e.event_id ELSE served_by END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, served_by FROM w""")
def inflight_dedupe(spark, d):
    """Requests of a key share the result of the one in flight until it is done; the next one starts anew."""
    return S.in_flight(_events(spark, d), "user_id", _BUSY)


@query("WITH @skills SELECT name, CASE WHEN doc_id % 3 = 0 THEN 'm:' || role WHEN doc_id % 2 = 0 THEN 'd:' || category ELSE content END AS content, CASE WHEN doc_id % 3 = 0 THEN 'memory' WHEN doc_id % 2 = 0 THEN 'disk' ELSE 'original' END AS tier FROM skills")
def tiered_read(spark, d):
    s = source(spark, d, "skills")
    memory = s.filter("doc_id % 3 = 0").select("name", F.concat(F.lit("m:"), "role").alias("content"))
    disk = s.filter("doc_id % 2 = 0").select("name", F.concat(F.lit("d:"), "category").alias("content"))
    return S.tiered(s, ("memory", memory), ("disk", disk), ("original", s))


@query(f"{_E}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS place FROM e) SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20")
def recent_by_user(spark, d):
    """A ring of twenty events for each key."""
    return S.recent(_events(spark, d), 20, "user_id").select("user_id", "event_id", "place")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(spark, d):
    return source(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "ts", "event_type")


_HOT = "h AS (SELECT user_id, count(*) AS hits FROM e GROUP BY user_id ORDER BY hits DESC, user_id LIMIT 100)"


def _hot(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "user_id").limit(100)


@query(f"{_E}, {_HOT} SELECT * FROM h")
def hot_skills(spark, d):
    return _hot(spark, d)


@query(f"{_E}, {_HOT}, x AS (SELECT e.event_type AS grp, e.user_id, h.user_id IS NOT NULL AS hot, count(*) AS accesses, max(us) AS us FROM e LEFT JOIN (SELECT * FROM h LIMIT 20) h ON h.user_id = e.user_id GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY hot, accesses, us, user_id) AS r FROM x) SELECT grp, user_id AS name FROM k WHERE r = 1")
def evict_victim(spark, d):
    e = _events(spark, d)
    hot = _hot(spark, d).limit(20).select("user_id", F.lit(True).alias("hot"))
    x = e.join(F.broadcast(hot), "user_id", "left").groupBy(F.col("event_type").alias("grp"), F.col("user_id").alias("name"), F.coalesce("hot", F.lit(False)).alias("hot")).agg(F.count("*").alias("accesses"), F.max("us").alias("us"))
    return S.evict_victim(x, "grp")


@query(f"""{_E}, {_HOT}, f AS (SELECT DISTINCT user_id FROM e WHERE user_id NOT IN (SELECT user_id FROM h) ORDER BY md5('7:' || user_id) LIMIT 100),
w AS (SELECT user_id, 0 AS way, lpad(CAST(1000000000 - hits AS VARCHAR), 10, '0') AS r FROM h UNION ALL SELECT user_id, 1, md5('7:' || user_id) FROM f)
SELECT user_id, (row_number() OVER (ORDER BY way, r, user_id) - 1) // 10 AS batch FROM w""")
def warmup_batches(spark, d):
    """The hot keys, then a fill of as many in the order of a seeded hash, in batches of ten."""
    hot = _hot(spark, d).select("user_id", F.lit(0).alias("way"), F.lpad((1_000_000_000 - F.col("hits")).cast("string"), 10, "0").alias("r"))
    fill = _events(spark, d).select("user_id").distinct().join(hot.select("user_id"), "user_id", "left_anti")
    fill = fill.withColumn("way", F.lit(1)).withColumn("r", F.md5(F.concat(F.lit("7:"), F.col("user_id").cast("string")))).orderBy("r").limit(100)
    place = F.row_number().over(Window.orderBy("way", "r", "user_id")) - 1  # over two hundred rows at most
    return hot.unionByName(fill).select("user_id", F.floor(place / 10).cast("long").alias("batch"))
