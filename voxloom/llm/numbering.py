"""Gapless numbers within groups, without a task for a whole group. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm.scratch import saved

#: Rows of counts (one for each group and range) up to which they are broadcast.
BROADCAST_COUNTS = 200_000


def numbered_within(rows: DataFrame, group: str, order: list[Column], number: str = "number", total: str = "total") -> DataFrame:
    """``rows`` with the number in ``order`` within ``group``, from 0, and the size of the group; a written table.

    Rows are dealt out by ranges of group and order and sorted there. A row's number is its place in
    its range plus the rows of its group in the ranges before, which is one row for each range and
    group. A group of any size is many ranges, if the last columns of ``order`` tell its rows apart.
    Rows equal in all of ``order`` are numbered in any order. Null is a group of its own.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = saved(placed, "numbered").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts = saved(counts, "numbered-counts")
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_r", "_g", "_first", before.alias("_before"), F.sum("_n").over(W.partitionBy("_g")).alias(total))
    counts = F.broadcast(counts) if counts.limit(BROADCAST_COUNTS + 1).count() <= BROADCAST_COUNTS else counts.hint("merge")
    joined = placed.join(counts, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(number, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_r", "_g", "_first", "_before")
