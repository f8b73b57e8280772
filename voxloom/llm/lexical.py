"""Ranked lexical search on an index whose documents are grouped by their normaliser.

A document's normaliser m depends on its length alone, and its score on m and its term counts alone.
So documents of equal m form a stratum, cut into segments of bounded size, and a segment holds
for each term and each number of occurrences the documents that have it. The impact of a posting list
is one number, computed once. The most that an item can score in a stratum follows from the
largest count of each term there; an item visits its strata by that bound, first those that hold
enough documents for a full answer, then only those whose bound isn't below its last place.
"""

from __future__ import annotations

from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import arrow_text as A
from voxloom.llm.scratch import saved

TOP = 20
#: Documents of one segment of a stratum; documents of the strata that an item visits first.
SEGMENT, FIRST = 16_384, 1_000
#: MB of items that are searched at once; their terms and weights are broadcast.
BLOCK_MB = 2
#: Rows of a table of strata, or of segments, up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of scores that a task holds.
SCORE_BYTES = 32 << 20
FORWARD = "doc_id long, row long, n long, terms array<int>, counts array<int>"
INDEX = "m long, segment int, term int, tf int, docs array<long>"
HITS = "item int, doc_id long, score long"


class Queries:
    """The terms of a block of items: bytes, hashes in ascending order, and for each term the items that hold it."""

    def __init__(self, items: pa.Table):
        self.ids = items["item_id"].to_pylist()
        counts: dict[bytes, dict[int, int]] = {}
        for i, _, data, off in A.slices(items["text"]):
            words = A.Words(data, off, A.ALNUM)
            for k, d in enumerate(words.doc.tolist()):
                held = counts.setdefault(words.text(k), {})
                held[i + d] = held.get(i + d, 0) + 1
        terms = list(counts)
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        hashes = A.span_hashes(data, ends - [len(t) for t in terms], ends) if terms else np.zeros(0, A.U64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.terms = hashes[order], [terms[i] for i in order]
        self.items = [np.array(list(counts[t]), np.int64) for t in self.terms]
        self.repeats = [np.array(list(counts[t].values()), np.int64) for t in self.terms]
        by_length: dict[int, list[int]] = {}
        for i, t in enumerate(self.terms):
            by_length.setdefault(len(t), []).append(i)
        self.bytes = {n: (np.array(at), np.frombuffer(b"".join(self.terms[i] for i in at), np.uint8).reshape(len(at), n)) for n, at in by_length.items()}

    def find(self, words: A.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words that are terms; hashes first, then bytes."""
        if not len(self.hashes) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.searchsorted(self.hashes, words.hashes)
        at = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == words.hashes)
        found_words, found_terms = [], []
        while at.size:
            size = words.ends[at] - words.starts[at]
            for n in np.unique(size[np.isin(size, list(self.bytes))]).tolist():
                these = at[size == n]
                ids, table = self.bytes[n]
                spot = np.searchsorted(ids, low[these])
                spot = np.minimum(spot, len(ids) - 1)
                same = (ids[spot] == low[these]) & (words.data[words.starts[these][:, None] + np.arange(n)] == table[spot]).all(axis=1)
                found_words.append(these[same])
                found_terms.append(low[these[same]])
            # Terms with the same hash follow one another.
            low[at] += 1
            at = at[low[at] < len(self.hashes)]
            at = at[self.hashes[low[at]] == words.hashes[at]]
        return np.concatenate(found_words or [np.zeros(0, np.int64)]), np.concatenate(found_terms or [np.zeros(0, np.int64)])


def forward_rows(docs: DataFrame, queries) -> DataFrame:
    """doc_id, row, n, and the terms of the broadcast ``queries`` with their counts, in one narrow pass."""

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            q = queries.value
            for i, j, data, off in A.slices(column("text")):
                words = A.Words(data, off, A.ALNUM)
                word, term = q.find(words)
                pairs, counts = np.unique(words.doc[word] * max(1, len(q.terms)) + term, return_counts=True)
                doc, term = np.divmod(pairs, max(1, len(q.terms)))
                bounds = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (term, counts)]
                yield pa.RecordBatch.from_arrays([column("doc_id").slice(i, j - i), column("row").slice(i, j - i), pa.array(words.counts, pa.int64()), *lists], names=["doc_id", "row", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").mapInArrow(run, FORWARD)


def bounded(table: DataFrame) -> DataFrame:
    """``table`` to be broadcast if it is small, counted first, else to be joined by merge."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table.hint("merge")


def stratified(forward: DataFrame, n_docs: int, n_terms: int, segment: int = SEGMENT) -> DataFrame:
    """The index: for each stratum, segment, term and count the documents, as ascending places in the segment.

    The row with the term -1 lists the segment's documents, in ascending order with null last. Large
    strata are cut by a hash of the row, so equal ids don't meet in one segment.
    """
    rows = forward.where("size(terms) > 0").withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L"))
    large = bounded(rows.groupBy(F.col("m").alias("large")).agg(F.ceil(F.count(F.lit(1)) / segment).alias("parts")).where("parts > 1"))
    rows = rows.join(large, F.col("m") == F.col("large"), "left").withColumn("segment", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        m, part = table["m"][0].as_py(), table["segment"][0].as_py()
        table = table.sort_by([("doc_id", "ascending")]).combine_chunks()
        terms, counts = table["terms"].combine_chunks(), table["counts"].combine_chunks()
        place = np.repeat(np.arange(len(table)), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
        order = np.lexsort((place, tf, term))
        place, term, tf = place[order], term[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(term)]]), pa.int32()), pa.array(place, pa.int64()))
        own = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table["doc_id"].combine_chunks())
        n = len(first) + 1
        return pa.table({
            "m": pa.array([m] * n, pa.int64()), "segment": pa.array([part] * n, pa.int32()), "term": pa.array(np.concatenate([[-1], term[first]]), pa.int32()),
            "tf": pa.array(np.concatenate([[0], tf[first]]), pa.int32()), "docs": pa.concat_arrays([own, lists]),
        })

    return rows.select("m", "segment", "doc_id", "terms", "counts").groupBy("m", "segment").applyInArrow(run, INDEX)


def impact(tf, m):
    """The score of ``tf`` occurrences of a term of weight 1 in a document with the normaliser ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def visited(index: DataFrame, plan: DataFrame, tables, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each segment for the items that ``plan`` (m, segment, items, floors) sends there."""

    def run(postings: pa.Table, visits: pa.Table) -> pa.Table:
        empty = pa.table({"item": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not visits.num_rows or not postings.num_rows:
            return empty
        queries, weights = tables.value
        m = postings["m"][0].as_py()
        term, tf = postings["term"].to_numpy(), postings["tf"].to_numpy().astype(np.int64)
        docs = postings["docs"].combine_chunks()
        own = int(np.flatnonzero(term < 0)[0])
        offsets, flat = docs.offsets.to_numpy(), docs.values
        ids = flat[int(offsets[own]) : int(offsets[own + 1])]
        counts, which = np.unique(tf, return_inverse=True)
        impacts = impact(counts, m)[which]
        places = pa.compute.fill_null(flat, -1).to_numpy()
        items, floors = np.array(visits["items"][0].as_py(), np.int64), np.array(visits["floors"][0].as_py(), np.int64)
        step, out = max(1, SCORE_BYTES // (8 * max(1, len(ids)))), []
        for low in range(0, len(items), step):
            some = items[low : low + step]
            local = np.full(len(queries.ids), -1, np.int64)
            local[some] = np.arange(len(some))
            scores = np.zeros((len(some), len(ids)), np.int64)
            for k in np.flatnonzero(term >= 0).tolist():
                t = int(term[k])
                rows = local[queries.items[t]]
                here = rows >= 0
                if here.any():
                    add = queries.repeats[t][here] * (weights[t] * int(impacts[k]))
                    scores[rows[here][:, None], places[offsets[k] : offsets[k + 1]]] += add[:, None]
            for r, item in enumerate(some.tolist()):
                own_scores = scores[r]
                best = np.flatnonzero(own_scores >= max(1, floors[low + r]))
                if len(best) > top:
                    best = best[own_scores[best] >= np.partition(own_scores[best], -top)[-top]]
                best = best[np.lexsort((best, -own_scores[best]))][:top]
                out.append((np.full(len(best), item), best, own_scores[best]))
        best = np.concatenate([b for _, b, _ in out])
        return pa.table({"item": pa.array(np.concatenate([i for i, _, _ in out]), pa.int32()), "doc_id": ids.take(pa.array(best)), "score": pa.array(np.concatenate([s for _, _, s in out]), pa.int64())})

    wanted = bounded(plan.select("m", "segment"))
    few = index.join(wanted, ["m", "segment"], "left_semi").select("m", "segment", "term", "tf", "docs")
    return few.groupBy("m", "segment").cogroup(plan.groupBy("m", "segment")).applyInArrow(run, HITS)


def best_of(hits: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_block(docs: DataFrame, items: pa.Table, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""
    spark = docs.sparkSession
    queries = Queries(items)
    forward = saved(forward_rows(docs, spark.sparkContext.broadcast(queries)), "lexical-forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    index = saved(stratified(forward, n_docs, max(1, n_terms)), "lexical-index")
    listed = index.where("term >= 0")
    # No more rows than the block has terms.
    found = {r["term"]: r["df"] for r in listed.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).collect()}
    weights = [floor(1000 * log((2 * n_docs + 2) / (2 * found[t] + 1))) if t in found else 0 for t in range(len(queries.terms))]
    tables = spark.sparkContext.broadcast((queries, weights))
    pairs = [(t, int(i), int(c) * weights[t]) for t in found for i, c in zip(queries.items[t], queries.repeats[t])]
    pairs = spark.createDataFrame(pairs, "term int, item int, weight long")
    most = listed.groupBy("m", "term").agg(F.max("tf").cast("long").alias("tf")).join(F.broadcast(pairs), "term")
    bounds = most.groupBy("item", "m").agg(F.sum(F.col("weight") * F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")).alias("bound")).where("bound > 0")
    segments = saved(index.where("term < 0").select("m", "segment", F.size("docs").alias("size")), "lexical-segments")
    sizes = bounded(segments.groupBy("m").agg(F.sum("size").alias("size")))
    ordered = W.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(W.unboundedPreceding, -1)
    bounds = saved(bounds.join(sizes, "m").withColumn("before", F.coalesce(F.sum("size").over(ordered), F.lit(0))), "lexical-bounds")

    def plan(visits: DataFrame) -> DataFrame:
        # One row a stratum, with no more entries than the block has items.
        rows = visits.groupBy("m").agg(F.collect_list(F.struct("item", "floor")).alias("v")).select("m", F.col("v.item").alias("items"), F.col("v.floor").alias("floors"))
        return saved(rows.join(segments.select("m", "segment").hint("merge"), "m").select("m", "segment", "items", "floors"), "lexical-plan")

    first = saved(visited(index, plan(bounds.where(F.col("before") < FIRST).withColumn("floor", F.lit(1).cast("long"))), tables, top), "lexical-first")
    last_place = best_of(first, top).where(F.col("rank") == top).select("item", F.col("score").alias("floor"))
    rest = bounds.where(F.col("before") >= FIRST).join(bounded(last_place), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    second = saved(visited(index, plan(rest.where(F.col("bound") >= F.col("floor"))), tables, top), "lexical-second")
    names = spark.createDataFrame(list(enumerate(queries.ids)), "item int, item_id long")
    return best_of(first.unionAll(second), top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_mb: int = BLOCK_MB) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each row of ``benchmark``, by falling score, then doc_id with null last.

    Null and empty texts have no terms: such documents are in no count and no answer, such items
    have no answer. Rows of one doc_id are documents each, rows of one item_id are items each, with an
    answer each; a null item_id is kept. Long texts are read whole. Items are searched in blocks of
    ``block_mb`` MB; all statistics are of all documents. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n_blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (block_mb << 20)
    if n_blocks == 1:
        return search_block(docs, items.toArrow(), top)
    parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b) for b in range(n_blocks)]
    return reduce(DataFrame.unionAll, [search_block(docs, part.toArrow(), top) for part in parts])
