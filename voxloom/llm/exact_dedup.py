"""Exact dedup by most-significant-digit radix partitioning over Spark shuffles.

Each round splits every open group on the next run of bytes, taken as one digit of a large radix.
A group that is down to one row, or whose texts have ended, is closed; the others go on with the
rest of their bytes. Equality is decided by the bytes alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.scratch import saved

#: Bytes of the digit in each round; after the last one it doubles, so a text of n bytes takes about log2(n) rounds.
DIGIT_BYTES = (64, 1024, 16_384, 262_144)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: tuple[int, ...] = DIGIT_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The row with the largest id stays
    (a null id is below all others; a group of null ids only keeps a null). Rows that repeat an id
    are rows of their own: with equal texts they count in group_size and are both marked kept.
    An empty table gives an empty result. Other columns of the input are ignored.
    """
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    open_rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lit(0).cast("long").alias("gid"), raw.alias("rest"), F.sha2(raw, 256).alias("text_sha256"))
    closed = []
    for i in range(1 << 30):
        width = digits[i] if i < len(digits) else digits[-1] << (i - len(digits) + 1)
        cut = open_rows.select("id", "gid", "text_sha256", F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        # Partial sums on the map side: a hot group sends one row per task.
        groups = cut.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("largest")).where("n > 1")
        groups = saved(groups.withColumn("next_gid", F.monotonically_increasing_id()), "radix-groups")
        ended = F.octet_length("digit") < width
        # The group side has one row a key, so AQE can split a hot group of the other side. It grows with
        # the input, so it isn't broadcast when it happens to be small.
        split = cut.join(groups.hint("merge"), ["gid", "digit"], "left").select(
            "id", "text_sha256", F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("largest")).alias("keep_id"),
            F.coalesce("next_gid", F.lit(0).cast("long")).alias("gid"), F.when(F.col("n").isNotNull() & ~ended, F.col("rest")).alias("rest"),
        )
        split = saved(split, "radix-rows")
        closed.append(split.where("rest is null").select("id", "keep_id", "n", "text_sha256"))
        open_rows = split.where("rest is not null").select("id", "gid", "rest", "text_sha256")
        if open_rows.isEmpty():
            break
    rows = reduce(DataFrame.unionAll, closed)
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
