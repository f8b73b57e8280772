"""Average-linkage clusters of unit vectors by rounds of mutually best pairs.

Two clusters' mean similarity is that of their sum vectors, so a cluster is its sum, its size and its
first member. Pairs are ordered by similarity, then by place. A merger is never closer to a third
cluster than the closer of its parts, so all pairs that are each other's best merge at once and the
result is that of merging the best pair of all, one after another. Only clusters whose best partner
has merged look for a new one.

A recording of at most :data:`IN_TASK` windows is one group. A longer one is a table of clusters: each
round compares blocks of rows in as many tasks as there are pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.sources.stored import removed, saved

LEAST = 0.58
#: Windows of a recording that one task clusters by itself; clusters of a block; digits that similarities are compared at.
IN_TASK, BLOCK, DIGITS = 4096, 2048, 12
#: Rows of a product of vectors that are held at once.
ROWS = 256


def similarity(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Mean similarities of clusters, rounded so that equal ones are equal in any block."""
    return np.round(a @ b.T / np.outer(a_size, b_size), DIGITS)


def best_mates(heads, sums, size, other_heads, other_sums, other_size) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, head) of the best other cluster of each; of equals the first by head. ``other_heads`` ascend."""
    best, mate = np.full(len(heads), -np.inf), np.full(len(heads), -1, np.int64)
    for a in range(0, len(heads), ROWS):
        part = slice(a, a + ROWS)
        mean = similarity(sums[part], size[part], other_sums, other_size)
        mean[heads[part][:, None] == other_heads[None, :]] = -np.inf
        at = mean.argmax(axis=1)
        best[part], mate[part] = mean[np.arange(len(at)), at], other_heads[at]
    return best, mate


def mutual(heads: np.ndarray, best: np.ndarray, mate: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the clusters that take another in, and of those; where rounding leaves no mutual pair, of the best pair alone."""
    at = np.minimum(np.searchsorted(heads, mate), len(heads) - 1)
    close = (best >= least) & (mate >= 0)
    into = np.flatnonzero(close & (mate[at] == heads) & (heads < mate))
    if into.size or not close.any():
        return into, at[into]
    low, high = np.minimum(np.arange(len(heads)), at), np.maximum(np.arange(len(heads)), at)
    first = np.lexsort((high, low, -np.where(close, best, -np.inf)))[:1]
    return low[first], high[first]


def average_linkage(x: np.ndarray, least: float = LEAST) -> list[int]:
    """Labels by first member of the rows of ``x``; lone vectors join their closest larger cluster, one after another."""
    n = len(x)
    head, heads = np.arange(n), np.arange(n)
    sums, size = x.astype(np.float64).copy(), np.ones(n)
    best, mate, stale = np.full(n, -np.inf), np.full(n, -1, np.int64), np.ones(n, bool)
    while len(heads) > 1:
        best[stale], mate[stale] = best_mates(heads[stale], sums[stale], size[stale], heads, sums, size)
        into, gone = mutual(heads, best, mate, least)
        if not into.size:
            break
        head = _renamed(head, heads[gone], heads[into])
        sums[into] += sums[gone]
        size[into] += size[gone]
        touched = np.concatenate([heads[into], heads[gone]])
        stale = np.isin(mate, touched) | np.isin(heads, touched)
        keep = np.ones(len(heads), bool)
        keep[gone] = False
        heads, sums, size, best, mate, stale = heads[keep], sums[keep], size[keep], best[keep], mate[keep], stale[keep]
    lone = size == 1
    if lone.any() and not lone.all():
        targets = attach(heads[~lone], sums[~lone], size[~lone], heads[lone], sums[lone])
        head = _renamed(head, heads[lone], targets)
    first: dict[int, int] = {}
    return [first.setdefault(h, len(first)) for h in head.tolist()]


def _renamed(head: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    order = np.argsort(old)
    at = np.minimum(np.searchsorted(old[order], head), len(old) - 1)
    return np.where(old[order][at] == head, new[order][at], head)


def attach(heads: np.ndarray, sums: np.ndarray, size: np.ndarray, lone: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cluster that each lone vector joins, in their order; clusters grow with each, the last of equals counts."""
    sums, size, out = sums.copy(), size.copy(), np.zeros(len(lone), np.int64)
    order = np.argsort(heads)
    heads, sums, size = heads[order], sums[order], size[order]
    for i in np.argsort(lone):
        score = np.round(sums @ vectors[i] / size, DIGITS)
        j = len(score) - 1 - int(np.argmax(score[::-1]))
        out[i] = heads[j]
        sums[j] += vectors[i]
        size[j] += 1
    return out


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.sort_by("head").combine_chunks()
    sums = table["sum"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return table["head"].to_numpy(), sums, table["size"].to_numpy().astype(np.float64)


def new_mates(clusters: DataFrame, block: int) -> DataFrame:
    """(tid, head, found_best, found_mate) of the clusters without a mate, by products of blocks."""

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        others = others.rename_columns([c.removeprefix("other_") for c in others.column_names])
        names = ["tid", "head", "best", "mate"]
        if not rows.num_rows or not others.num_rows:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=names)
        heads, sums, size = _arrays(rows)
        best, mate = best_mates(heads, sums, size, *_arrays(others))
        tid = rows["tid"][0].as_py()
        return pa.table([pa.array([tid] * len(heads), pa.string()), heads, best, mate], names=names)

    rows = clusters.select("tid", "head", "size", "sum", F.expr(f"head div {block}").alias("part"), F.col("mate").isNull().alias("stale"))
    parts = rows.groupBy("tid", "part").agg(F.bool_or("stale").alias("asks"))
    asking = rows.where("stale").withColumnRenamed("part", "asker").join(parts.select("tid", "part"), "tid")
    asked = rows.join(parts.where("asks").select("tid", F.col("part").alias("asker")), "tid")
    keys = ["tid", "asker", "part"]
    values = ["head", "size", "sum"]
    other = asked.select(*[F.col(c).alias(f"other_{c}") for c in keys + values]).groupBy(*[f"other_{c}" for c in keys])
    found = asking.select(*keys, *values).groupBy(*keys).cogroup(other).applyInArrow(run, "tid string, head long, best double, mate long")
    best = found.where("mate >= 0 and best > double('-infinity')").groupBy("tid", "head").agg(F.max(F.struct("best", (-F.col("mate")).alias("m"))).alias("x"))
    return best.select("tid", "head", F.col("x.best").alias("found_best"), (-F.col("x.m")).alias("found_mate"))


def long_recordings(vectors: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(tid, place, speaker) of (tid, place, unit): the same clusters, with the work of one recording in many tasks.

    Each round is a few written tables; rounds end when no pair of any recording is close enough.
    """
    clusters = saved(vectors.select("tid", F.col("place").alias("head"), F.lit(1).cast("long").alias("size"), F.col("unit").alias("sum"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("mate")), "linkage")
    members = saved(vectors.select("tid", "place", F.col("place").alias("head")), "linkage-members")
    while True:
        found = clusters.join(new_mates(clusters, block), ["tid", "head"], "left")
        asked = saved(found.select("tid", "head", "size", "sum", F.coalesce("best", "found_best").alias("best"), F.coalesce("mate", "found_mate").alias("mate")), "linkage")
        removed(clusters)
        clusters = asked
        close = clusters.where(F.col("best") >= least).select("tid", "head", "best", "mate")
        back = close.select("tid", F.col("head").alias("mate"), F.col("mate").alias("head"))
        pairs = saved(close.where("head < mate").join(back, ["tid", "head", "mate"], "left_semi").select("tid", F.col("head").alias("into"), F.col("mate").alias("gone")), "linkage-pairs")
        if pairs.isEmpty():
            # Rounding can leave no mutual pair; then the best of each recording merges.
            one = close.groupBy("tid").agg(F.min(F.struct((-F.col("best")).alias("b"), F.least("head", "mate").alias("into"), F.greatest("head", "mate").alias("gone"))).alias("x"))
            pairs = saved(one.select("tid", "x.into", "x.gone"), "linkage-pairs")
            if pairs.isEmpty():
                break
        gone = clusters.select("tid", F.col("head").alias("gone"), F.col("size").alias("more"), F.col("sum").alias("other")).join(pairs, ["tid", "gone"]).select("tid", F.col("into").alias("head"), "more", "other")
        touched = pairs.select("tid", F.explode(F.array("into", "gone")).alias("mate"), F.lit(True).alias("touched"))
        kept = clusters.join(pairs.select("tid", F.col("gone").alias("head")), ["tid", "head"], "left_anti").join(gone, ["tid", "head"], "left").join(touched, ["tid", "mate"], "left")
        stale = F.col("more").isNotNull() | F.coalesce("touched", F.lit(False))
        whole = F.when(F.col("more").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "other", lambda a, b: a + b))
        fewer = kept.select("tid", "head", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), whole.alias("sum"), F.when(~stale, F.col("best")).alias("best"), F.when(~stale, F.col("mate")).alias("mate"))
        fewer = saved(fewer, "linkage")
        renamed = members.join(pairs.select("tid", F.col("gone").alias("head"), "into"), ["tid", "head"], "left")
        moved = saved(renamed.select("tid", "place", F.coalesce("into", "head").alias("head")), "linkage-members")
        for old in (clusters, members, pairs):
            removed(old)
        clusters, members = fewer, moved
    return _with_lone(clusters, members)


def _with_lone(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Lone vectors join, each recording's one after another, and clusters are numbered by their first member."""

    def run(table: pa.Table) -> pa.Table:
        heads, sums, size = _arrays(table)
        lone = size == 1
        targets = attach(heads[~lone], sums[~lone], size[~lone], heads[lone], sums[lone]) if lone.any() and not lone.all() else heads[lone]
        tid = table["tid"][0].as_py()
        return pa.table([pa.array([tid] * len(targets), pa.string()), heads[lone], targets], names=["tid", "head", "target"])

    joined = clusters.select("tid", "head", "size", "sum").groupBy("tid").applyInArrow(run, "tid string, head long, target long")
    groups = members.join(joined, ["tid", "head"], "left").select("tid", "place", F.coalesce("target", "head").alias("head"))
    groups = saved(groups, "linkage-groups")
    first = groups.groupBy("tid", "head").agg(F.min("place").alias("first"))
    numbers = first.select("tid", "head", (F.row_number().over(W.partitionBy("tid").orderBy("first")) - 1).cast("int").alias("speaker"))
    return groups.join(numbers, ["tid", "head"]).select("tid", "place", "speaker")
