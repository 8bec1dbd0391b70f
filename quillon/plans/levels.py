"""Levels and cycles of dependency graphs of any size, worked out in tables: no plan is one task.

A plan has (task_id, name, depends_on), a row for each thing that a step waits for, null for none. Rows of one
name are one step; repeated rows count once. Null names and null task_ids are values like others.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged


def _graph(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (v) and what they wait for (v, d), each once; a step is its plan and its name."""
    nodes = plan.select(F.struct("task_id", "name").alias("v")).distinct()
    edges = plan.filter("depends_on is not null").select(F.struct("task_id", "name").alias("v"), F.struct("task_id", F.col("depends_on").alias("name")).alias("d")).distinct()
    return staged(nodes, "steps"), staged(edges, "waits")


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, to, hops) of steps that wait for one thing: the first step down their chain that does not; and steps whose chain closes.

    Every round doubles the hops, and rows that have met an end are done. While any chain with an end is under way, some
    step nearer to that end meets it, so a round in which none does leaves only chains that close: rounds follow the
    longest chain, not the number of steps.
    """
    jump = staged(edges.groupBy("v").agg(F.first("d").alias("to"), F.count("*").alias("n")).filter("n = 1").select("v", "to", F.lit(1).cast("long").alias("hops")), "jumps")
    ended, open_ = jump.limit(0), jump
    while True:
        ahead = ended.union(open_).select(F.col("v").alias("to"), F.col("to").alias("then"), F.col("hops").alias("more"))
        further = open_.join(ahead, "to", "left")
        moved = staged(further.select("v", F.coalesce("then", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("then").isNull().alias("ended")), "jumps")
        stay = moved.filter("ended").drop("ended")
        if stay.isEmpty():
            return ended, open_.select("v")
        ended, open_ = ended.union(stay), moved.filter("not ended").drop("ended")


def _staged_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, stage) of all steps that can run, by peeling: chains are one move, so rounds follow only steps that wait for several.

    A step that waits for something closing or missing goes as soon as that is known, as those that can run do: a round
    moves only what is still open.
    """
    chain, closes = _chains(edges)
    waits = edges.groupBy("v").agg(F.count("*").alias("need"))
    several = waits.filter("need > 1")
    # What a step waits for, by the end of its chain; `at` holds the deepest level met so far.
    ends = chain.withColumn("never", F.lit(False)).union(closes.select("v", F.col("v").alias("to"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("never")))
    closing = edges.join(several.select("v"), "v", "left_semi").join(ends.withColumnRenamed("v", "d"), "d", "left")
    none = F.lit(None).cast("long")
    deps = staged(closing.select("v", F.coalesce("to", "d").alias("to"), F.coalesce("hops", F.lit(0)).alias("hops"), none.alias("at"), F.coalesce("never", F.lit(False)).alias("never")), "heads")
    roots = nodes.join(waits, "v", "left_anti").select("v", F.lit(0).cast("long").alias("stage"), F.lit(False).alias("never"))
    missing = deps.filter("not never").select(F.col("to").alias("v")).distinct().join(nodes, "v", "left_anti").select("v", none.alias("stage"), F.lit(True).alias("never"))
    new = staged(roots.union(missing), "levels")
    known = new.filter("not never")
    while not new.isEmpty() and not deps.isEmpty():
        told = new.select(F.col("v").alias("to"), F.col("stage").alias("of"), F.col("never").alias("lost"))
        met = deps.join(told, "to", "left").select("v", "to", "hops", F.coalesce("at", F.col("of") + F.col("hops")).alias("at"), (F.col("never") | F.coalesce("lost", F.lit(False))).alias("never"))
        met = staged(met, "met")
        open_ = F.col("at").isNull() & ~F.col("never")
        sums = staged(met.groupBy("v").agg(F.count_if(open_).alias("need"), F.max("at").alias("at"), F.max("never").alias("never")), "waiting")
        new = sums.filter("never or need = 0").select("v", F.when(~F.col("never"), F.col("at") + 1).alias("stage"), "never")
        left = sums.filter("not never and need > 0")
        known = known.union(new.filter("not never"))
        rest = met.filter(open_).join(left.select("v"), "v", "left_semi").select("v", "to", "hops", "at", "never")
        # What a waiting step has met is one row, its deepest; it joins nothing more.
        deps = staged(rest.union(left.filter("at is not null").select("v", F.lit(None).cast(deps.schema["to"].dataType), none, "at", "never")), "heads")
    heads = staged(known.select("v", "stage"), "levels")
    single = chain.join(heads.select(F.col("v").alias("to"), "stage"), "to").select("v", (F.col("stage") + F.col("hops")).alias("stage"))
    return heads.union(single)


def levels(plan: DataFrame) -> DataFrame:
    """(task_id, name, stage) of every step: the length of its longest chain; null on a cycle, behind one or behind a missing step.

    Steps are numbered first, so that the rounds move numbers and no names.
    """
    nodes, edges = _graph(plan)
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "numbered")
    of, on = (nodes.select(F.col("v").alias(name), F.col("id").alias(number)) for name, number in (("v", "of"), ("d", "on")))
    # Behind a missing step, whatever its name, is one number.
    numbers = staged(edges.join(of, "v").join(on, "d", "left").select(F.col("of").alias("v"), F.coalesce("on", F.lit(-1).cast("long")).alias("d")), "numbers")
    found = _staged_levels(nodes.select(F.col("id").alias("v")), numbers)
    return nodes.join(found.withColumnRenamed("v", "id"), "id", "left").select("v.task_id", "v.name", "stage")


def _highest(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(v, top): the highest rank that each step reaches, its own included; ends has (v, top) with own ranks.

    What a step reaches, the step that it reaches as its highest so far reaches for it too: long ways shorten by halves.
    """
    top = ends
    while True:
        seen = edges.join(top.select(F.col("v").alias("d"), "top"), "d").select("v", "top").union(top.select("v", "top"))
        far = top.select("v", F.col("top.v").alias("d")).join(top.select(F.col("v").alias("d"), "top"), "d").select("v", "top")
        after = seen.union(far).groupBy("v").agg(F.max("top").alias("top"))
        after = staged(after.join(top.withColumnRenamed("top", "was"), "v").select("v", "top", (F.col("top") != F.col("was")).alias("moved")), "tops")
        top = after.select("v", "top")
        if after.filter("moved").isEmpty():
            return top


def cycles(plan: DataFrame) -> DataFrame:
    """(task_id, cycle, name): the members of every set of steps that wait for each other, named by its first; a step that waits for itself is one.

    Steps that can run go first, and those that no step of a cycle waits for. Then each step takes the highest rank (a hash) that it reaches. Where a
    rank's own step reaches back, both wait for each other; what remains falls apart by rank and goes on.
    """
    nodes, edges = _graph(plan)
    runs = _staged_levels(nodes, edges).select("v")
    stuck = staged(edges.join(runs, "v", "left_anti").join(runs.withColumnRenamed("v", "d"), "d", "left_anti"), "stuck")
    found = [stuck.filter("v = d").select("v", F.col("v").alias("root"))]
    open_ = stuck.filter("v <> d")
    # What waits behind cycles without being waited for goes by the same peeling from the other end.
    back = staged(open_.select(F.col("d").alias("v"), F.col("v").alias("d")), "waited-for")
    behind = _staged_levels(staged(open_.select("v").union(open_.select("d")).distinct(), "steps"), back).select("v")
    open_ = open_.join(behind, "v", "left_anti").join(behind.withColumnRenamed("v", "d"), "d", "left_anti").select("v", "d")
    while True:
        open_ = staged(open_, "open")
        if open_.isEmpty():
            break
        ranks = open_.select("v").union(open_.select("d")).distinct().select("v", F.struct(F.xxhash64("v").alias("rank"), "v").alias("top"))
        to = _highest(open_, ranks)
        ends = to.select(F.col("v").alias("d"), F.col("top").alias("end"))
        same = staged(open_.join(to, "v").join(ends, "d").filter(F.col("top") == F.col("end")).select("v", "d"), "same")
        back = _highest(same.select(F.col("d").alias("v"), F.col("v").alias("d")), ranks)
        tied = staged(to.join(back.withColumnRenamed("top", "from"), "v").filter(F.col("top") == F.col("from")).select("v", F.col("top.v").alias("root")), "tied")
        found.append(tied)
        open_ = same.join(tied.select("v"), "v", "left_anti").join(tied.select(F.col("v").alias("d")), "d", "left_anti")
    members = found[0]
    for more in found[1:]:
        size = more.groupBy("root").count().filter("count > 1").select("root")
        members = members.union(more.join(size, "root", "left_semi").select("v", "root"))
    # A step that waits for itself and for others on a cycle belongs to the larger set.
    members = members.groupBy("v").agg(F.max_by("root", F.col("root") != F.col("v")).alias("root"))
    sets = members.groupBy("root").agg(F.min("v.name").alias("cycle"))
    return members.join(sets, "root").select("v.task_id", "cycle", "v.name")
