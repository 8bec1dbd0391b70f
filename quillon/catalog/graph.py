"""Link graph queries over derived links."""
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import keywords as AC
from ..registry import query, source, spread

_E = "WITH @skills, @edges"
_REV = "r AS (SELECT dst AS src, src AS dst FROM edges)"
_LIVE = "live AS (SELECT src, dst FROM edges WHERE dst IN (SELECT name FROM skills))"
_ONE = "one AS (SELECT dst AS src, src AS dst FROM live WHERE (dst, src) NOT IN (SELECT (src, dst) FROM live))"


def _edges(spark, d):
    return source(spark, d, "edges").select("src", "dst")


def _names(spark, d):
    return source(spark, d, "skills").select("name", "category")


@query(_E + " SELECT src, dst FROM edges WHERE dst NOT IN (SELECT name FROM skills)")
def dangling_edges(spark, d):
    return G.dangling(_edges(spark, d), _names(spark, d))


@query(f"{_E}, {_REV} SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM r")
def non_reciprocal(spark, d):
    return G.one_way(_edges(spark, d))


@query(_E + """, t AS (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM edges WHERE ends_with(dst, '7')), live AS (SELECT src, dst FROM edges WHERE dst IN (SELECT name FROM skills))
SELECT src, dst, 'missing' AS problem FROM edges WHERE dst NOT IN (SELECT name FROM skills) UNION ALL SELECT src, dst, 'self' FROM edges WHERE src = dst
UNION ALL SELECT src, dst, 'one way' FROM live WHERE (dst, src) NOT IN (SELECT (src, dst) FROM live) UNION ALL SELECT src, dst, 'duplicate' FROM t GROUP BY src, dst HAVING count(*) > 1""")
def validate_links(spark, d):
    e = _edges(spark, d)
    return G.problems(e.unionByName(e.filter(F.col("dst").endswith("7"))), _names(spark, d))


def _texts(spark, d):
    """The names and texts of skills, without its join to labels, which would shuffle the texts."""
    return source(spark, d, "md").select("name", "category", "text")


_DEG = "g AS (SELECT name, category, count(dst) AS degree FROM skills LEFT JOIN (SELECT src, dst FROM edges) ON src = name GROUP BY name, category)"


@query(f"{_E}, {_DEG} SELECT name, degree, degree BETWEEN 2 AND 4 AS ok FROM g")
def degree_bounds(spark, d):
    return G.degrees(_edges(spark, d), _names(spark, d)).withColumn("ok", F.col("degree").between(2, 4))


@query(f"{_E}, {_DEG} SELECT name FROM g WHERE degree <= 1")
def orphans(spark, d):
    return G.degrees(_edges(spark, d), _names(spark, d)).filter("degree <= 1").select("name")


@query(f"{_E}, {_DEG} SELECT category, count(*) AS n, round(avg(degree), 6) AS mean_degree, count(*) FILTER (degree <= 1) AS orphans, CAST(greatest(2, floor(1.2 * avg(degree))) AS BIGINT) AS target FROM g GROUP BY category")
def link_stats(spark, d):
    g = G.degrees(_edges(spark, d), _names(spark, d)).join(_names(spark, d), "name")
    mean = F.avg("degree")
    return g.groupBy("category").agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean_degree"), F.count_if(F.col("degree") <= 1).alias("orphans"), F.greatest(F.lit(2), F.floor(1.2 * mean)).cast("long").alias("target"))


@query(f"{_E}, {_REV} SELECT count(*) FILTER ((src, dst) IN (SELECT (src, dst) FROM r)) AS verified, count(*) FILTER ((src, dst) NOT IN (SELECT (src, dst) FROM r)) AS violations FROM edges")
def reciprocity_counts(spark, d):
    e = _edges(spark, d)
    pairs = e.join(G.reverse(e).withColumn("back", F.lit(True)), ["src", "dst"], "left")
    return pairs.agg(F.count_if(F.col("back").isNotNull()).alias("verified"), F.count_if(F.col("back").isNull()).alias("violations"))


@query(f"""{_E}, {_LIVE}, {_ONE}, held AS (SELECT src, count(*) AS held FROM live GROUP BY src),
k AS (SELECT one.src, dst, row_number() OVER (PARTITION BY one.src ORDER BY dst) AS k, coalesce(held, 0) AS held FROM one LEFT JOIN held ON held.src = one.src)
SELECT src, dst FROM live UNION ALL SELECT src, dst FROM k WHERE k <= 4 - held""")
def enforce_reciprocal(spark, d):
    return G.enforce_reciprocal(_edges(spark, d), _names(spark, d))


@query(f"{_E}, {_REV}, b AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT src, dst FROM r WHERE src <> dst), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM b) SELECT src, dst FROM k WHERE k <= 5")
def symmetrize_trim(spark, d):
    return G.symmetrised(_edges(spark, d))


@query(f"""{_E}, {_LIVE}, {_ONE}, s AS (SELECT src, src AS dst FROM edges WHERE src = dst),
b AS (SELECT src, dst FROM live UNION SELECT src, dst FROM one WHERE dst IN (SELECT name FROM skills) UNION SELECT src, concat('doc-', lpad(CAST(CAST(substr(src, 5) AS BIGINT) % 10 AS STRING), 8, '0')) FROM edges),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM b) SELECT src, dst FROM k WHERE k <= 4 AND src <> dst""")
def repair_links(spark, d):
    e = _edges(spark, d)
    extra = e.select("src", F.concat(F.lit("doc-"), F.lpad((F.substring("src", 5, 8).cast("long") % 10).cast("string"), 8, "0")).alias("dst"))
    return G.repaired(e, _names(spark, d), extra)


@query(r"""WITH @skills, @edges, t AS (SELECT name, category, list_distinct(list_filter(regexp_split_to_array(lower(content), '[ \t\r\n]+'), lambda w: w <> '')) AS w FROM skills),
p AS (SELECT a.category, a.name AS src, b.name AS dst, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS score FROM t a JOIN t b ON a.category = b.category AND a.name < b.name WHERE (a.name, b.name) NOT IN (SELECT (src, dst) FROM edges))
SELECT * FROM p WHERE score > 0.3 ORDER BY score DESC, src, dst LIMIT 50""")
def suggest_links(spark, d):
    return G.suggested(spread(_texts(spark, d)), _edges(spark, d))


#: Keyword groups of these queries: a parameter of the operators.
KEYWORDS = (("articles", 0, "der "), ("articles", 0, "the "), ("articles", 0, "les "), ("joints", 1, "und "), ("joints", 1, "and "), ("joints", 1, "por "), ("shouts", 2, "!!"), ("shouts", 2, "***"))
_KW = "SELECT * FROM (VALUES " + ", ".join(f"('{g}', {o}, '{k}')" for g, o, k in KEYWORDS) + ") v(grp, ord, keyword)"
_HITS = f"kw AS ({_KW}), h AS (SELECT name, grp, ord, count(DISTINCT keyword) AS hits FROM skills JOIN kw ON contains(lower(content), keyword) GROUP BY name, grp, ord)"


def _keyworded(spark, d):
    return _texts(spark, d).select("name", "text"), KEYWORDS


@query(f"WITH @skills, {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hits DESC, ord) AS k FROM h) SELECT s.name, coalesce(grp, 'none') AS grp FROM skills s LEFT JOIN k ON k.name = s.name AND k = 1")
def keyword_classify(spark, d):
    return G.classified(*_keyworded(spark, d), "none")


@query(f"WITH @skills, {_HITS} SELECT name, grp FROM h")
def keyword_multilabel(spark, d):
    return G.keyword_groups(*_keyworded(spark, d)).select("name", "grp")


@query(f"""WITH @skills, {_HITS}, m AS (SELECT name, string_agg(grp, '+' ORDER BY grp) AS grps FROM h GROUP BY name), s AS (SELECT DISTINCT grps, grp FROM m JOIN h ON h.name = m.name)
SELECT 'member' AS kind, name AS src, grps AS dst FROM m UNION ALL SELECT DISTINCT 'link', a.grps, b.grps FROM s a JOIN s b ON a.grp = b.grp""")
def shared_group_links(spark, d):
    """Links of documents that share a keyword group, over the whole corpus: members of group sets, and linked sets."""
    return G.shared_group_sets(G.keyword_groups(*_keyworded(spark, d)))


#: Every word and every two words in a row of the benchmark's texts, grouped by first letter: thousands of keywords as a table.
_PHRASES = """b AS (SELECT regexp_split_to_array(lower(text), '[^a-z]+') AS l FROM benchmark), pw AS (SELECT unnest(l) AS keyword FROM b UNION ALL SELECT unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) FROM b),
kw AS (SELECT DISTINCT substr(keyword, 1, 1) AS grp, ascii(keyword) AS ord, keyword FROM pw WHERE keyword <> ''), h AS (SELECT name, grp, ord, count(DISTINCT keyword) AS hits FROM skills JOIN kw ON contains(lower(content), keyword) GROUP BY name, grp, ord)"""


def _phrases(spark, d):
    words = F.split(F.lower("text"), "[^a-z]+")
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    b = source(spark, d, "benchmark").select(F.explode(F.concat(words, F.array_compact(pairs))).alias("keyword"))
    return b.filter("keyword <> ''").select(F.substring("keyword", 1, 1).alias("grp"), F.ascii("keyword").alias("ord"), "keyword").distinct()


@query(f"WITH @skills, {_PHRASES} SELECT name, grp, hits FROM h")
def keyword_table_groups(spark, d):
    """Groups of a keyword table of any size, by an automaton."""
    return AC.groups(spread(_texts(spark, d)), _phrases(spark, d)).select("name", "grp", "hits")


@query(f"WITH @skills, {_PHRASES}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hits DESC, ord) AS k FROM h) SELECT s.name, coalesce(grp, 'none') AS grp FROM skills s LEFT JOIN k ON k.name = s.name AND k = 1")
def keyword_table_classify(spark, d):
    return AC.classified(spread(_texts(spark, d)), _phrases(spark, d), "none")


_FLOW = [("src0", "src1", 0), ("src0", "src2", 1), ("src1", "src2", 0), ("src2", "src0", 0), ("src3", "src1", 0), ("src3", "src9", 1), ("src3", "src4", 2)]
_FL = "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _FLOW) + ") v(grp, to_grp, pos))"


@query(f"""WITH @skills, {_FL}, m AS (SELECT name, category AS grp, row_number() OVER (PARTITION BY category ORDER BY name) AS k FROM skills),
i AS (SELECT a.name AS src, b.name AS dst, 0 AS step, b.k, row_number() OVER (PARTITION BY a.name ORDER BY b.k) AS r FROM m a JOIN m b ON a.grp = b.grp AND b.k <= 3 AND a.name <> b.name),
x AS (SELECT src, dst, step, k FROM i WHERE r <= 2 UNION ALL SELECT m.name, h.name, 1, f.pos FROM m JOIN f ON m.grp = f.grp JOIN m h ON h.grp = f.to_grp AND h.k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY step, k, dst) AS r FROM x) SELECT src, dst FROM o WHERE r <= 4""")
def group_links(spark, d):
    members = source(spark, d, "skills").select("name", F.col("category").alias("grp"))
    return G.group_links(members, spark.createDataFrame(_FLOW, "grp string, to_grp string, pos int"))


#: Curated groups: literal lists, whole by definition.
CURATED = (
    ("src0", ("doc-00000000", "doc-00000040", "doc-00000100", "doc-00000160")),
    ("src1", ("doc-00000001", "doc-00000021", "doc-00000061", "doc-00000121", "doc-00000181")),
    ("src2", ("doc-00000022", "doc-00000082", "doc-00000102")),
    ("src3", ("doc-00000003", "doc-00000043", "doc-00000083", "doc-00000123", "doc-00000163", "doc-00000183")),
    ("src4", ("doc-00000024", "doc-00000044", "doc-00000144")),
    ("src9", ("doc-00000009", "doc-00000089", "doc-00000129", "doc-00000169")),
)
#: Documents with complementary ones of their own choice, in order: where a mapped group holds some, the first two replace its own.
COMPLEMENTARY = (
    ("doc-00000000", ("doc-00000181", "doc-00000061", "doc-00000121", "doc-00000099")),
    ("doc-00000022", ("doc-00000100",)),
    ("doc-00000003", ("doc-00000144", "doc-00000099")),
)
_CU = "cu AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{n}')" for g, names in CURATED for n in names) + ") v(grp, name))"
_CO = "co AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{x}', {k})" for n, xs in COMPLEMENTARY for k, x in enumerate(xs)) + ") v(name, dst, pos))"


@query(f"""WITH @skills, {_FL}, {_CU}, {_CO}, c AS (SELECT DISTINCT cu.grp, cu.name FROM cu JOIN skills s ON s.name = cu.name),
o AS (SELECT s.name, f.to_grp, co.dst, row_number() OVER (PARTITION BY s.name, f.to_grp ORDER BY co.pos) AS k FROM skills s JOIN f ON s.category = f.grp JOIN co ON co.name = s.name JOIN c ON c.grp = f.to_grp AND c.name = co.dst),
h AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY name) AS k FROM c)
SELECT a.name AS src, b.name AS dst FROM c a JOIN c b ON a.grp = b.grp AND a.name <> b.name UNION SELECT name, dst FROM o WHERE k <= 2 AND name <> dst
UNION SELECT s.name, h.name FROM skills s JOIN f ON s.category = f.grp JOIN h ON h.grp = f.to_grp AND h.k <= 2 WHERE s.name <> h.name AND (s.name, f.to_grp) NOT IN (SELECT (name, to_grp) FROM o)""")
def curated_links(spark, d):
    """Every pair of a curated group, and for every document of a mapped category two of each group that it maps to."""
    names = source(spark, d, "skills").select("name", F.col("category").alias("grp"))
    listed = spark.createDataFrame([(g, n) for g, group in CURATED for n in group], "grp string, name string")
    own = spark.createDataFrame([(n, x, k) for n, xs in COMPLEMENTARY for k, x in enumerate(xs)], "name string, dst string, pos int")
    return G.curated(names, listed, spark.createDataFrame(_FLOW, "grp string, to_grp string, pos int"), own)


@query("SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey")
def all_pairs_links(spark, d):
    """The complete graph of one small group of a fixed size."""
    n = source(spark, d, "nation").select("n_name")
    return n.select(F.col("n_name").alias("src")).join(F.broadcast(n.select(F.col("n_name").alias("dst"))), F.col("src") != F.col("dst"))
