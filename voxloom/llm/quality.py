"""Quality by random-indexing word vectors and a small network.

Every token bucket has a fixed sparse random index vector. A bucket's word vector is the sum of
the index vectors of its neighbours over the whole corpus, summed by Spark. A document is the
pooled vectors of its tokens (mean, spread, change from token to token), and a two-layer network
with a temperature gives its probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm import arrow_text as A
from voxloom.llm import training

BITS = 13
DIM = 32
THRESHOLD = 0.7
_PUNCTUATION = ~A.ALNUM & A.NON_SPACE
_PUNCTUATION[:] = [bool(x) and (b < 128) for b, x in enumerate(_PUNCTUATION)]
_PUNCTUATION[65:91] = False


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the tokens in order: runs of letters and digits, and runs of punctuation."""
    low = A.LOWER[data]
    ws, we = A.runs(A.ALNUM[low], off)
    ps, pe = A.runs(_PUNCTUATION[low], off)
    starts, ends = np.concatenate([ws, ps]), np.concatenate([we, pe])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return np.searchsorted(off, starts, side="right") - 1, (A.span_hashes(low, starts, ends) >> A.U64(64 - BITS)).astype(np.int64)


def index_vectors() -> np.ndarray:
    """Two entries of +-1 in each bucket's vector, fixed by the bucket."""
    h = A.mix(np.arange(1 << BITS, dtype=A.U64) + A.U64(0xABCDEF))
    out = np.zeros((1 << BITS, DIM), np.int32)
    for k in range(2):
        at = ((h >> A.U64(8 * k)) % A.U64(DIM)).astype(np.int64)
        out[np.arange(1 << BITS), at] += np.where((h >> A.U64(40 + k)) & A.U64(1), 1, -1)
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors of all buckets, from every pair of neighbours of every text.

    Each task sums into one matrix of 2^13 x 32 and sends its rows; Spark adds them up by bucket.
    What reaches the driver is that one matrix, whatever the size of the corpus.
    """
    size = 1 << BITS

    def sums(batches):
        index, total = index_vectors(), np.zeros((size, DIM), np.int64)
        for batch in batches:
            for _, _, data, off in A.slices(batch.column(0)):
                doc, b = tokens(data, off)
                near = doc[1:] == doc[:-1]
                x, y = b[:-1][near], b[1:][near]
                code, n = np.unique(x * size + y, return_counts=True)
                x, y = code // size, code % size
                for a, c in ((x, y), (y, x)):
                    order = np.argsort(a, kind="stable")
                    a, c, m = a[order], c[order], n[order]
                    if len(a):
                        at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                        total[a[at]] += np.add.reduceat(index[c] * m[:, None], at, axis=0)
        on = np.flatnonzero(total.any(axis=1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, DIM * len(on) + 1, DIM, dtype=np.int32)), pa.array(total[on].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(on), flat], names=["bucket", "v"])

    parts = docs.select(text_col).mapInArrow(sums, "bucket long, v array<long>")
    summed = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[d]).alias(f"v{d}") for d in range(DIM)])
    table = summed.toArrow()
    vectors = np.zeros((size, DIM))
    if len(table):
        vectors[table["bucket"].to_numpy()] = np.stack([table[f"v{d}"].to_numpy() for d in range(DIM)], axis=1)
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return (vectors / np.maximum(norm, 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of each text of a slice; those of a text without tokens are zero."""
    n = len(off) - 1
    doc, b = tokens(data, off)
    out = np.zeros((n, 3 * DIM + 3))
    if not len(doc):
        return out
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)
    has = np.flatnonzero(count)
    v = vectors[b]
    by = lambda x: np.add.reduceat(x, first[has], axis=0) / count[has, None]
    mean = by(v)
    step = np.zeros_like(v)
    step[1:] = (v[1:] - v[:-1]) ** 2
    step[first[has]] = 0
    out[has, :DIM] = mean
    out[has, DIM : 2 * DIM] = np.sqrt(np.maximum(by(v * v) - mean**2, 0))
    out[has, 2 * DIM : 3 * DIM] = np.sqrt(by(step))
    out[has, 3 * DIM] = np.log1p(count[has]) / 10
    out[has, 3 * DIM + 1] = np.sqrt((mean**2).sum(axis=1))
    same = np.zeros(len(b))
    same[1:] = (b[1:] == b[:-1]) & (doc[1:] == doc[:-1])
    out[has, 3 * DIM + 2] = by(same[:, None])[:, 0]
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer of tanh, a logit, and its temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, check: np.ndarray, hidden: int = 24, steps: int = 500, rate: float = 0.01, l2: float = 1e-3, seed: int = 3) -> Network:
    """Adam on the rows that aren't in ``check``; the temperature is set on those that are.

    Without rows of both classes the probability is the share of label 1.
    """
    d = x.shape[1]
    share = float((y * weight).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.5
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    fit, held = np.flatnonzero(~check), np.flatnonzero(check)
    if not len(fit) or y[fit].min() == y[fit].max():
        return net
    rng = np.random.default_rng(seed)
    net.shift, net.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net.w1, net.w2 = rng.normal(0, d**-0.5, (d, hidden)), rng.normal(0, hidden**-0.5, hidden)
    z, t, g_w = (x[fit] - net.shift) / net.scale, y[fit], weight[fit] / weight[fit].sum()
    theta = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for k in range(1, steps + 1):
        w1, b1, w2, b2 = theta
        h = np.tanh(z @ w1 + b1)
        g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - t) * g_w
        back = np.outer(g, w2) * (1 - h * h)
        for i, grad in enumerate((z.T @ back + l2 * w1, back.sum(axis=0), h.T @ g + l2 * w2, np.array([g.sum()]))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            theta[i] = theta[i] - rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = theta[0], theta[1], theta[2], float(theta[3][0])
    if len(held):
        logit, target, w = net.logits(x[held]), y[held], weight[held]
        loss = lambda temp: float((w * np.logaddexp(0, np.where(target > 0, -1, 1) * logit / temp)).sum())
        net.temperature = min(np.geomspace(0.5, 4, 43), key=loss)
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    net: Network

    def scores(self, column: pa.Array) -> np.ndarray:
        out = [self.net.probabilities(pooled(self.vectors, data, off)) for _, _, data, off in A.slices(column)]
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = training.ROWS_PER_CLASS) -> QualityModel:
    """Vectors from all documents; the network from at most ``rows_per_class`` rows of each class that aren't held out."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows, weights = training.sample(docs, labels, "quality", rows_per_class)

    def features(batches):
        for batch in batches:
            for i, j, data, off in A.slices(batch.column(1)):
                x = pooled(shared.value, data, off)
                ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))], names=["doc_id", "label", "x"])

    table = rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(features, "doc_id long, label int, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    y = table["label"].to_numpy().astype(float)
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 3 * DIM + 3))
    check = (A.mix(table["doc_id"].to_numpy().astype(np.int64).view(A.U64)) % A.U64(5)) == 0 if len(y) else np.zeros(0, bool)
    return QualityModel(vectors, fit_network(x, y, np.array([weights[int(k)] for k in y]), check))


def with_scores(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score, in one narrow pass. Null and empty texts get the score of no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input
    return A.annotate(docs, text_col, [T.StructField("quality_score", T.DoubleType())], lambda column: [pa.array(shared.value.scores(column))])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; rows that repeat an id are each scored."""
    model = fit(docs, labels)
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
