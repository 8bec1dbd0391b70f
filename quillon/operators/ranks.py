"""Places in ordered groups, for groups of any size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `position`, from 1, in each group (nulls are one) by the order, which has to tell its rows apart.

    Rows are dealt by range, so a group is spread over as many tasks as its size needs: a row's position is its
    place in its range and the numbers of the ranges before.
    """
    ranges = staged(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    before = sums.select("_group", "_of", (F.sum("_n").over(Window.partitionBy("_group").orderBy("_of")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    placed = ranges.join(before, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.select(*rows.columns, (within + F.col("_before")).cast("int").alias("position"))


def paged(rows: DataFrame, group: str, value: str, per_page: int, separator: str, order: str | None = None) -> DataFrame:
    """(group, page, n, value): the values of each group in order, joined in pages of `per_page`, so no row holds a whole group."""
    placed = positions(rows, group, order or value).withColumn("page", F.floor((F.col("position") - 1) / per_page).cast("int"))
    lines: Column = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", value))), lambda x: x[value]), separator)
    return placed.groupBy(group, "page").agg(F.count("*").alias("n"), lines.alias(value))
