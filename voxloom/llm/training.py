"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a fit uses at most: those with the smallest hash of their id.
ROWS_PER_CLASS = 6_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS_PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of the sample, and the weight of a sampled row of each class.

    Held-out rows, null labels and null ids are left out. Weights restore the share of each class
    among all labelled rows.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = [usable.where(F.col("label") == y).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    # At most 2 * rows ids, so they are broadcast; the texts stay where they are.
    ids = chosen[0].union(chosen[1])
    weights = {y: totals.get(y, 0) / max(1, min(rows, totals.get(y, 0))) for y in (0, 1)}
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), weights
