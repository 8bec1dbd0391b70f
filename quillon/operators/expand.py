"""Expansion of trigger lists by a table of variants."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_triggers(triggers: DataFrame, variants: DataFrame, most: int = 8) -> DataFrame:
    """(name, triggers): the originals in order, then new terms sorted, `most` at the most.

    A term brings its first two variants; a variant brings its term; each word of a
    term brings that word's first variant. variants has (key, pos, variant).
    """
    terms = triggers.select("name", F.posexplode("triggers").alias("pos", "term"))
    low = terms.select("name", F.lower("term").alias("low"))
    exact = low.join(variants.filter("pos < 2"), F.col("low") == F.col("key")).select("name", F.col("variant").alias("term"))
    back = low.join(variants, F.col("low") == F.col("variant")).select("name", F.col("key").alias("term"))
    words = low.select("name", F.explode(F.split("low", " ")).alias("word"))
    by_word = words.join(variants.filter("pos = 0"), F.col("word") == F.col("key")).select("name", F.col("variant").alias("term"))
    new = exact.union(back).union(by_word).distinct().join(terms, ["name", "term"], "left_anti").select("name", F.lit(1 << 30).alias("pos"), "term")
    ranked = terms.select("name", "pos", "term").union(new).withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("pos", "term")))
    return ranked.filter(F.col("k") <= most).groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), ", ").alias("triggers"))
