"""Toxicity by a factorization machine over hashed terms.

Terms are the words of the whole text and their four- and five-byte beginnings, hashed into 2^18
buckets. Score: sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms, so pairs of
terms (an insult and a group) count beyond their single weights. The machine learns on the terms
whose own share differs between the classes, and on those of pairs that explain what these leave
over, also if neither term tells anything alone. All other terms carry no weight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm import arrow_text as A
from voxloom.llm import training
from voxloom.llm.scratch import saved

BITS = 18
FACTORS = 4
#: Standard errors by which the share of a term in the two classes must differ.
SUPPORT = 2.2
#: Chance that a sample whose left-overs are dealt at random has any pair that counts as clear.
PAIR_CHANCE = 0.01
#: Tasks of the pair search, and the entries of rows that one of them holds at once; parts of the terms whose pairs could be clear.
PAIR_TASKS, PAIR_ENTRIES, ABLE_PARTS = 64, 1 << 20, 16
THRESHOLD = 0.3
#: Entries (row, term) that a pass over a sample holds at once beyond the sample itself.
STRETCH = 1 << 19


def term_sets(data: np.ndarray, off: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct terms of a slice; only buckets that are ``known``, if given."""
    words = A.Words(data, off, A.ALNUM)
    parts = [(words.doc, words.hashes)]
    for n in (4, 5):
        long = np.flatnonzero(words.ends - words.starts >= n)
        parts.append((words.doc[long], A.mix(A.span_hashes(words.data, words.starts[long], words.starts[long] + n) ^ A.U64(n))))
    keys = []
    for doc, h in parts:
        bucket = h >> A.U64(64 - BITS)
        if known is not None:
            on = known[bucket]
            doc, bucket = doc[on], bucket[on]
        keys.append((doc.astype(A.U64) << A.U64(BITS)) | bucket)
    keys = np.unique(np.concatenate(keys))
    return (keys >> A.U64(BITS)).astype(np.int64), (keys & A.U64((1 << BITS) - 1)).astype(np.int64)


def stretches(doc: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about STRETCH entries that end with a row; ``doc`` ascends."""
    cuts = [0]
    while cuts[-1] < len(doc):
        last = doc[min(cuts[-1] + STRETCH, len(doc)) - 1]
        cuts.append(int(np.searchsorted(doc, last, side="right")))
    return list(zip(cuts[:-1], cuts[1:]))


def term_counts(doc: np.ndarray, term: np.ndarray, size: int, value: np.ndarray | None = None) -> np.ndarray:
    """Rows of each term, or the sum of their ``value``."""
    out = np.zeros(size, np.int64 if value is None else float)
    for a, b in stretches(doc):
        out += np.bincount(term[a:b], None if value is None else value[doc[a:b]], size)
    return out


@dataclass
class FactorizationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """``doc`` ascends."""
        out = np.full(n, float(self.bias))
        for a, b in stretches(doc):
            first, m = int(doc[a]), int(doc[b - 1] - doc[a]) + 1
            row, of, part = doc[a:b] - first, term[a:b], out[first : first + m]
            part += np.bincount(row, self.w[of], m)
            for f in range(self.v.shape[1]):
                x = self.v[of, f]
                part += 0.5 * (np.bincount(row, x, m) ** 2 - np.bincount(row, x * x, m))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        known = (self.w != 0) | (self.v != 0).any(axis=1)
        out = []
        for i, j, data, off in A.slices(column):
            doc, term = term_sets(data, off, known)
            out.append(1 / (1 + np.exp(-np.clip(self.logits(doc, term, j - i), -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def share_terms(p: np.ndarray, q: np.ndarray, one: float, zero: float) -> np.ndarray:
    """Terms whose share of the toxic rows (counts p of ``one``) clearly differs from that of the others (q of ``zero``)."""
    odds = np.log((p + 0.5) / (one + 1)) - np.log((q + 0.5) / (zero + 1))
    clear = np.abs(odds) / np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
    return np.flatnonzero((clear > SUPPORT) & (p + q >= 2))


@dataclass
class PairSearch:
    """The rows of a sample as lists of places of ``known`` terms, with what is left over of each row.

    A pair is clear if the left-overs of the rows with both terms sum to more than Bernstein's bound
    allows in any of the pairs of ``known`` terms, but with PAIR_CHANCE. Every pair is looked at, but
    those of terms none of whose subsets of rows could reach the bound.
    """

    known: np.ndarray
    left: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    least: float
    spread: float
    most: float

    @staticmethod
    def of(doc: np.ndarray, term: np.ndarray, left: np.ndarray) -> PairSearch:
        """``doc`` ascends; a row has each term once."""
        n, left = len(left), left - left.mean()
        known = np.flatnonzero(term_counts(doc, term, 1 << BITS) >= 2)
        least = float(np.log(max(len(known), 2) ** 2 / PAIR_CHANCE))
        search = PairSearch(known, left, np.zeros(n + 1, np.int64), np.zeros(0, np.int32), least, float(np.mean(left**2)) + 1e-12, float(np.abs(left).max()) + 1e-12)
        known = search.known = known[np.isin(known, search.able(doc, term))]
        place = np.full(1 << BITS, -1, np.int32)
        place[known] = np.arange(len(known))
        rows, places = np.zeros(n, np.int64), [search.places]
        for a, b in stretches(doc):
            at = place[term[a:b]]
            rows += np.bincount(doc[a:b][at >= 0], minlength=n)
            places.append(at[at >= 0])
        search.starts, search.places = np.concatenate([[0], np.cumsum(rows)]), np.concatenate(places)
        return search

    def evidence(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bernstein's exponent of a sum of ``count`` left-overs; grows with the total."""
        total = np.abs(total)
        return total * total / (2 * (count * self.spread + self.most * total / 3) + 1e-12)

    def able(self, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Terms with a subset of rows that reaches the bound: the best of each size are the first in order."""
        found = np.zeros(1 << BITS, bool)
        for part in range(ABLE_PARTS):  # so that the sorted copies stay small
            on = np.concatenate([a + np.flatnonzero(term[a:b] % ABLE_PARTS == part) for a, b in stretches(doc)] or [np.zeros(0, np.int64)])
            for sign in (1, -1):
                of, value = term[on], self.left[doc[on]]
                order = np.lexsort((-sign * value, of))
                of, value = of[order], value[order]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                sizes = np.diff(np.append(first, len(of)))
                sums = np.cumsum(value)
                sums -= np.repeat(sums[first] - value[first], sizes)
                count = np.arange(len(of)) - np.repeat(first, sizes) + 1
                found[of[(self.evidence(np.maximum(sign * sums, 0), count) > self.least) & (count >= 2)]] = True
        return np.flatnonzero(found)

    def clear(self, part: int, parts: int) -> np.ndarray:
        """Terms of clear pairs, of the terms at every ``parts``-th place from ``part`` on with any other."""
        k, lengths = len(self.known), np.diff(self.starts)
        rows_of = np.repeat(np.arange(len(lengths)), lengths)
        mine = np.flatnonzero(self.places % parts == part)
        mine = mine[np.argsort(self.places[mine], kind="stable")]
        found = np.zeros(k, bool)
        bounds = np.searchsorted(self.places[mine], np.arange(part, k + parts, parts))
        for at, low, high in zip(range(part, k, parts), bounds[:-1], bounds[1:], strict=False):
            sums, counts = np.zeros(k), np.zeros(k)
            rows = rows_of[mine[low:high]]
            cuts = np.cumsum(lengths[rows]) // PAIR_ENTRIES
            for some in np.split(rows, np.flatnonzero(np.diff(cuts)) + 1):
                size = lengths[some]
                entry = np.repeat(self.starts[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
                other = self.places[entry]
                sums += np.bincount(other, np.repeat(self.left[some], size), k)
                counts += np.bincount(other, minlength=k)
            pairs = (self.evidence(sums, counts) > self.least) & (counts >= 2)
            pairs[at] = False
            if pairs.any():
                found[at] = True
                found |= pairs
        return self.known[found]


def pair_terms(doc: np.ndarray, term: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Terms of the clear pairs of a sample, in this process."""
    return PairSearch.of(doc, term, left).clear(0, 1)


def pair_terms_by_tasks(spark: SparkSession, doc: np.ndarray, term: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The same, dealt to PAIR_TASKS tasks by term; each gets the rows of the sample, which is bounded."""
    search = PairSearch.of(doc, term, left)
    if len(search.known) < 2:
        return search.known[:0]
    shared = spark.sparkContext.broadcast(search)

    def parts(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.clear(part, PAIR_TASKS).astype(np.int32))], names=["term"])

    found = spark.range(0, PAIR_TASKS, 1, PAIR_TASKS).mapInArrow(parts, "term int").distinct().toArrow()
    shared.destroy()
    return np.sort(found["term"].to_numpy().astype(np.int64))


def fit_machine(
    doc: np.ndarray, term: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 1e-3, seed: int = 5, pairs_of: Callable = pair_terms
) -> FactorizationMachine:
    """Fit by Adam on the whole sample; ``doc`` ascends. Without rows of both classes, the score is the share of label 1.

    ``pairs_of`` (doc, term, left) finds the terms of pairs that explain what the first fit leaves.
    """
    size, n = 1 << BITS, len(y)
    share = float((y * weight).sum() / max(weight.sum(), 1e-9)) if n else 0.0
    machine = FactorizationMachine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(size), np.zeros((size, FACTORS)))
    if n == 0 or y.min() == y.max():
        return machine
    p, q = term_counts(doc, term, size, y), term_counts(doc, term, size, 1 - y)
    terms = share_terms(p, q, y.sum(), n - y.sum())
    weight = weight / weight.mean()
    _learn(machine, doc, term, terms, y, weight, steps, rate, l2, seed)
    score = 1 / (1 + np.exp(-np.clip(machine.logits(doc, term, n), -30, 30)))
    # What each row leaves over, as if the classes were sampled as they are weighted.
    pairs = pairs_of(doc, term, (y - score) * weight)
    if len(np.setdiff1d(pairs, terms)):
        machine.w[:], machine.v[:] = 0, 0
        _learn(machine, doc, term, np.union1d(terms, pairs), y, weight, steps, rate, l2, seed)
    return machine


def _learn(machine: FactorizationMachine, doc: np.ndarray, term: np.ndarray, terms: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, rate: float, l2: float, seed: int) -> None:
    if not len(terms):
        return
    n = len(y)
    wanted = np.zeros(1 << BITS, bool)
    wanted[terms] = True
    on = np.concatenate([a + np.flatnonzero(wanted[term[a:b]]) for a, b in stretches(doc)])
    doc, col, k = doc[on].astype(np.int64), np.searchsorted(terms, term[on]), len(terms)
    del on
    rng = np.random.default_rng(seed)
    theta = [np.array([machine.bias]), np.zeros(k), rng.normal(0, 0.01, (k, FACTORS))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for t in range(1, steps + 1):
        b, w, v = theta
        part = FactorizationMachine(b[0], w, v)
        g = (1 / (1 + np.exp(-np.clip(part.logits(doc, col, n), -30, 30))) - y) * weight / n
        grads = [np.array([g.sum()]), np.bincount(col, g[doc], k) + l2 * w / 10, np.empty_like(v)]
        for f in range(FACTORS):
            x = v[col, f]
            total = np.bincount(doc, x, n)
            grads[2][:, f] = np.bincount(col, g[doc] * (total[doc] - x), k) + l2 * v[:, f]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    machine.bias = float(theta[0][0])
    machine.w[terms], machine.v[terms] = theta[1], theta[2]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = training.ROWS_PER_CLASS) -> FactorizationMachine:
    """Fit on at most ``rows_per_class`` labelled rows of each class that aren't held out.

    Terms are counted by Spark, in as many rows as there are buckets; the driver then gets, of these
    rows alone, the terms that more than one of them has (three a word at most, 2^18 in any text).
    """
    rows, weights = training.sample(docs, labels, "toxic", rows_per_class)

    def terms(batches):
        for batch in batches:
            for i, j, data, off in A.slices(batch.column(1)):
                doc, term = term_sets(data, off)
                ends = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))], names=["doc_id", "label", "terms"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType()))])
    sample = saved(rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(terms, schema), "toxicity-terms")
    counts = sample.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
    useful = np.zeros(1 << BITS, bool)
    useful[counts["term"].to_numpy()] = True

    def only_useful(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy()
            on = useful[flat]
            ends = np.concatenate([[0], np.cumsum(on)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[on]))], names=["doc_id", "label", "terms"])

    y, doc, term = sample_arrays(sample.mapInArrow(only_useful, schema).toArrow())
    # The driver's arrays are numpy's from here on; Arrow would keep what it has freed.
    pa.default_memory_pool().release_unused()
    weight = np.array([weights[int(x)] for x in y])
    return fit_machine(doc, term, y, weight, pairs_of=partial(pair_terms_by_tasks, docs.sparkSession))


def sample_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each row, row and term of each entry) of (doc_id, label, terms), rows in order; 32 bits an entry and column."""
    ids, labels = table["doc_id"].to_numpy(), table["label"].to_numpy()
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in table["terms"].chunks] or [np.zeros(0, np.int32)]).astype(np.int64)
    order = np.lexsort((labels, ids))
    sizes_in_order = sizes[order]
    starts = np.empty(len(order), np.int64)
    starts[order] = np.cumsum(sizes_in_order) - sizes_in_order
    term, k = np.empty(int(sizes.sum()), np.int32), 0
    for chunk in table["terms"].chunks:
        flat, at = chunk.flatten().to_numpy(), 0
        for start, n in zip(starts[k : k + len(chunk)].tolist(), sizes[k : k + len(chunk)].tolist()):
            term[start : start + n] = flat[at : at + n]
            at += n
        k += len(chunk)
    return labels[order].astype(float), np.repeat(np.arange(len(order), dtype=np.int32), sizes_in_order), term


def with_scores(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity_score, in one narrow pass.

    Null and empty texts get the score of no terms. Long texts are read whole, a slice at a time. Each
    row is scored by its own text, so repeated rows have equal scores. A column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2^18 buckets, whatever the input
    return A.annotate(docs, text_col, [T.StructField("toxicity_score", T.DoubleType())], lambda column: [pa.array(shared.value.scores(column))])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; rows that repeat an id are each scored.

    Rows whose id is null aren't held out and aren't learnt from; a score equal to the threshold counts
    as toxic. Without labels of both classes every document gets their share of label 1, 0 without any.
    An empty table gives an empty result; other columns are ignored.
    """
    machine = fit(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))
