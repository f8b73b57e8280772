"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. A shift table over blocks of two words tells how
far a search position can move on; where it can't, the bucket of the block selects the windows to
compare, first by word hashes, then by the words themselves. Many texts are searched in step, so
each step is a numpy operation. The benchmark goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm import arrow_text as A
from voxloom.llm.scratch import saved

WINDOW = 10
#: MB of benchmark text in one broadcast table.
BLOCK_MB = 16
#: Least and most bits of a shift table; it has four times as many places as there are blocks.
TABLE_BITS = (12, 26)
#: End positions that one search lane covers.
LANE = 2048


class Patterns:
    """Wu-Manber tables of all windows with one number of words."""

    def __init__(self, length: int, hashes: np.ndarray, texts: list[bytes], items: list[list[str]]):
        self.m, self.block = length, min(2, length)
        blocks = self.blocks(hashes.reshape(-1)).reshape(-1)
        per = np.zeros((len(hashes), length), A.U64)
        flat = np.concatenate([np.zeros(self.block - 1, A.U64), blocks])  # block that ends at each word
        per[:] = flat.reshape(len(hashes), length)
        self.bits = int(min(max(np.ceil(np.log2(4 * per.size + 1)), TABLE_BITS[0]), TABLE_BITS[1]))
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int64)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, self.slot(per[:, j]), length - 1 - j)
        order = np.argsort(per[:, -1], kind="stable")
        self.suffix, self.hashes = per[order, -1], hashes[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]

    def blocks(self, h: np.ndarray) -> np.ndarray:
        return h if self.block == 1 else A.mix(h[:-1] * A.U64(0xD6E8FEB86659FD93) + h[1:])

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> A.U64(64 - self.bits)).astype(np.int64)

    def search(self, words: A.Words) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        h, m = words.hashes, self.m
        if len(h) < m:
            return []
        ending = np.concatenate([np.zeros(self.block - 1, A.U64), self.blocks(h)])
        skip = self.shift[self.slot(ending)]
        first, last = words.first[:-1] + m - 1, words.first[1:]
        lanes = np.maximum(0, -(-(last - first) // LANE))
        owner = np.repeat(np.arange(len(first)), lanes)
        at = first[owner] + LANE * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(at + LANE, last[owner])
        found = []
        while len(at):
            step = skip[at]
            if (stop := at[step == 0]).size:
                found.append(stop)
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        if not found:
            return []
        stop = np.concatenate(found)
        low, high = np.searchsorted(self.suffix, ending[stop], "left"), np.searchsorted(self.suffix, ending[stop], "right")
        out = []
        while (on := low < high).any():
            stop, low, high = stop[on], low[on], high[on]
            same = (h[stop[:, None] + np.arange(1 - m, 1)] == self.hashes[low]).all(axis=1)
            out += [(int(e) - m + 1, int(p)) for e, p in zip(stop[same], low[same])]
            low = low + 1
        return [(i, p) for i, p in out if b" ".join(words.text(k) for k in range(i, i + m)) == self.texts[p]]


def compile_patterns(items: pa.Table, window: int = WINDOW) -> list[Patterns]:
    """Tables for each window length of ``items`` (item_id as text, text)."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, list[str]]]] = {}
    ids = items["item_id"].to_pylist()
    for i, j, data, off in A.slices(items["text"]):
        words = A.Words(data, off, A.ALNUM)
        for d in range(j - i):
            a, b = words.first[d], words.first[d + 1]
            m = min(window, b - a)
            for k in range(a, b - m + 1) if m else ():
                text = b" ".join(words.text(x) for x in range(k, k + m))
                had = by_length.setdefault(int(m), {}).setdefault(text, (words.hashes[k : k + m], []))[1]
                if (item := ids[i + d]) is not None and item not in had:
                    had.append(item)
    return [Patterns(m, np.array([h for h, _ in p.values()]), list(p), [x for _, x in p.values()]) for m, p in sorted(by_length.items())]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_mb: int = BLOCK_MB) -> DataFrame:
    """``docs`` with n_words, hit_spans (flat first, end word pairs, merged) and hit_items (sorted).

    A benchmark of one block is searched in one narrow pass. A larger one takes a pass a block, one
    broadcast at a time; each pass writes the hits of the rows that have any, and these are merged by row.
    Null and empty texts have no words and no hits; long texts are searched whole. Items without words
    have no window; of repeated items all ids are listed; a null item id marks hits but isn't listed.
    Rows that repeat an id are searched each. Columns of these names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + total // int(block_mb * (1 << 20))
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in {f.name for f in FIELDS}])
    if n_blocks == 1:
        return _searched(docs, spark.sparkContext.broadcast(compile_patterns(items.toArrow(), window)), text_col, docs.columns)
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    hits = []
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        tables = spark.sparkContext.broadcast(compile_patterns(block.toArrow(), window))
        found = _searched(rows.select(row, text_col), tables, text_col, [row])
        hits.append(saved(found.where("size(hit_spans) > 0").drop("n_words"), "decontam-hits"))
        tables.destroy()
    hits = reduce(DataFrame.unionAll, hits)
    merge = F.pandas_udf(lambda s: s.map(lambda x: merged(list(zip(x[::2], x[1::2])))), T.ArrayType(T.LongType()))
    each = hits.groupBy(row).agg(F.flatten(F.collect_list("hit_spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    words = _searched(rows, spark.sparkContext.broadcast([]), text_col, rows.columns).drop("hit_spans", "hit_items")
    out = words.join(each.select(row, merge("spans").alias("hit_spans"), "hit_items").hint("merge"), row, "left").drop(row)
    return out.select(*[f"`{c}`" for c in docs.columns], "n_words", *[F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) for f in FIELDS[1:]])


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def _searched(docs: DataFrame, tables, text_col: str, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of ``docs`` with n_words, hit_spans and hit_items by the broadcast tables, in one narrow pass."""

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            n_words, spans, hits = [], [], []
            for i, j, data, off in A.slices(column(text_col)):
                words = A.Words(data, off, A.ALNUM)
                n_words += words.counts.tolist()
                found: dict[int, list] = {}
                for patterns in tables.value:
                    for at, p in patterns.search(words):
                        d = int(words.doc[at])
                        x = found.setdefault(d, [[], set()])
                        x[0].append((at - int(words.first[d]), at - int(words.first[d]) + patterns.m))
                        x[1].update(patterns.items[p])
                for d in range(j - i):
                    x = found.get(d, ((), ()))
                    spans.append(merged(x[0]))
                    hits.append(sorted(x[1]))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*map(column, kept), *new], names=[*kept, *(f.name for f in FIELDS)])
        A.release()

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *FIELDS]))


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping and touching spans made one, as a flat list."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = contamination(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.expr("aggregate(transform(hit_spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
