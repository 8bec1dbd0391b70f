"""URL filter by temporal list join, DataFrame functions only.

Dated list entries (a pattern added to or removed from a list) become validity
intervals. A capture is judged by the entries active when it was fetched. A pattern
is a domain with or without leading path segments: it matches that host and its
subdomains, and paths that begin with those segments.

Both sides meet in an equi-join on (pattern, month), with the interval as residual:
an interval stands once in each month it covers, so a host that holds a third of all
captures is spread over months, and Spark can split what is left of it. Only the
small columns of a capture take part. A capture meets only those of its suffixes and
paths that are as long as some pattern (a scan of the entries finds the lengths); what
matches nothing ends at the join, and one aggregation brings the matches back to all
captures.

Rules: of the active patterns the longest decides; between lists with the same
pattern, "allow" does. Events of one list and pattern at the same instant: a removal
comes last. Null or unparsable URLs and null fetch times match nothing and are not
blocked. Entries with a null pattern, list or time are ignored. Identical captures
are judged alike, each keeping its row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW = "allow"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def segments_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://[^/?#]*(/[^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def pattern_keys(url: Column, labels_in: list[int], depths_in: list[int]) -> Column:
    """Every pattern that would match the URL, of those numbers of labels and path segments that patterns have."""
    labels, segments = F.split(host_of(url), r"\."), segments_of(url)
    lengths = F.filter(F.array(*map(F.lit, labels_in)), lambda n: n <= F.size(labels))
    suffixes = F.transform(lengths, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    depths = F.filter(F.array(*map(F.lit, depths_in)), lambda n: n <= F.size(segments))
    paths = F.transform(depths, lambda d: F.when(d > 0, F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), d), "/"))).otherwise(""))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(paths, lambda p: F.concat(s, p))))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(keys)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, list, start, end) from (pattern, list, action, at): until the next event of the pattern in its list."""
    pattern = F.concat(F.lower(F.regexp_extract("pattern", "^[^/]*", 0)), F.rtrim(F.regexp_extract("pattern", "/.*$", 0), F.lit("/")))
    known = entries.filter("pattern is not null and list is not null and at is not null").withColumn("pattern", pattern)
    order = Window.partitionBy("list", "pattern").orderBy("at", F.col("action") == "remove")
    following = known.withColumn("end", F.lead("at").over(order)).filter(F.col("action") == "add")
    return following.filter("end is null or at < end").select("pattern", "list", F.col("at").alias("start"), "end")


def filter_captures(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """id, url, fetched_at, matched_list, matched_pattern, valid_from and blocked of every capture."""
    seen = captures.select(F.col(id_column).alias("id"), "url", "fetched_at")
    intervals = validity_intervals(entries)
    # Scalars: the range of fetch times, and the numbers of labels and path segments that patterns have.
    low, high = seen.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    count = lambda part, mark: F.length(part) - F.length(F.replace(part, F.lit(mark), F.lit("")))
    shape = intervals.agg(F.collect_set(count(F.substring_index("pattern", "/", 1), ".") + 1), F.collect_set(count(F.col("pattern"), "/"))).first()
    month = lambda c: F.date_trunc("month", c).cast("date")
    if low is not None:
        low, high = F.lit(low), F.lit(high)
        intervals = intervals.filter((F.col("start") <= high) & (F.col("end").isNull() | (F.col("end") > low)))
        months = F.sequence(month(F.greatest("start", low)), month(F.least(F.coalesce("end", high), high)), F.expr("interval 1 month"))
        intervals = intervals.withColumn("slice", F.explode(months))
    else:
        intervals = intervals.withColumn("slice", F.lit(None).cast("date"))
    keys = pattern_keys(F.col("url"), sorted(shape[0]), sorted(shape[1])) if shape[0] else F.array().cast("array<string>")
    keyed = seen.filter("fetched_at is not null").withColumn("pattern", F.explode(keys)).withColumn("slice", month(F.col("fetched_at")))
    active = (F.col("fetched_at") >= F.col("start")) & (F.col("end").isNull() | (F.col("fetched_at") < F.col("end")))
    met = keyed.join(intervals, ["pattern", "slice"]).filter(active)
    match = F.struct(F.length("pattern").alias("n"), (F.col("list") == ALLOW).alias("allow"), "list", "pattern", "start")
    met = met.select("id", "url", "fetched_at", match.alias("match"), F.lit(0).alias("rows"))
    every = met.unionByName(seen.withColumns({"match": F.lit(None).cast(met.schema["match"].dataType), "rows": F.lit(1)}))
    best = every.groupBy("id", "url", "fetched_at").agg(F.max("match").alias("best"), F.sum("rows").alias("rows"))
    # Identical captures were one group: each gets its row back.
    best = best.withColumn("_", F.explode(F.when(F.col("rows") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "rows"))))
    return best.select(
        F.col("id").alias(id_column), "url", "fetched_at",
        F.col("best.list").alias("matched_list"), F.col("best.pattern").alias("matched_pattern"), F.col("best.start").alias("valid_from"),
        F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"),
    )
