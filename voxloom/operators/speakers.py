"""Speakers: windows, embeddings, clusters, votes and turns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators import linkage
from voxloom.operators.audio import linear_to_16k
from voxloom.operators.batches import lists, whole_groups
from voxloom.operators.linkage import average_linkage
from voxloom.sources.stored import saved

TWO_SIMILARITY, TWO_MARGIN = 0.5, 0.13
#: Rows of a product of vectors that are held at once.
ROWS = 256
#: Windows of a block of a recording, all pairs of which with another block are one group.
PAIR_BLOCK = 2048


def segment_windows(segments: DataFrame, rate: int, seconds: int = 3) -> DataFrame:
    """(tid, segment_index, start, end) in samples: windows inside each segment, of half a second at least."""
    at = lambda ms: F.floor(F.col(ms) * rate / 1000)
    size = rate * seconds
    rows = segments.select("tid", "segment_index", at("start_ms").alias("s"), at("end_ms").alias("e")).where("e > s")
    rows = rows.withColumn("start", F.explode(F.sequence(F.col("s"), F.col("e") - 1, F.lit(size).cast("long")))).withColumn("end", F.least(F.col("start") + size, F.col("e")))
    return rows.where(F.col("end") - F.col("start") >= rate // 2).select("tid", "segment_index", "start", "end")


def normalize_vectors(rows: DataFrame, name: str = "embedding") -> DataFrame:
    """Unit vectors; those with a value that isn't finite or a tiny norm have ``ok`` false."""
    x = F.col(name)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.withColumn("norm", norm).withColumn("ok", F.coalesce(finite & (F.col("norm") >= 1e-6), F.lit(False)))
    return rows.withColumn("unit", F.when(F.col("ok"), F.transform(x, lambda v: v / F.col("norm"))))


def embed(windows: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(id, embedding, error) of windows (id, samples, rate): resampled to 16 kHz, log energies, then an injected model.

    The model is loaded once a task. A window that is too short, or whose vector is empty or not
    finite, has the error instead.
    """
    from voxloom.operators.audio import speaker_log_mel

    def one(fn, samples, rate: int) -> tuple[np.ndarray | None, str | None]:
        try:
            x = linear_to_16k(np.asarray(samples, np.float64), rate)
            vector = np.asarray(fn(speaker_log_mel(x)), np.float32).reshape(-1)
        except Exception as e:  # noqa: BLE001  any error of the injected model belongs in its row
            return None, str(e) or type(e).__name__
        if not len(vector) or not np.isfinite(vector).all():
            return None, "vector is empty or not finite"
        return vector, None

    def run(batches):
        fn = model()
        for p in batches:
            out = [one(fn, x, int(r)) for x, r in zip(p["samples"], p["rate"])]
            yield pd.DataFrame({"id": p["id"], "embedding": [o[0] for o in out], "error": [o[1] for o in out]})

    return windows.select("id", "samples", "rate").mapInPandas(run, "id string, embedding array<float>, error string")


def window_audio(windows: DataFrame, blocks: DataFrame, rate: int, block: int = 16_384) -> DataFrame:
    """Windows (tid, track, start, end) with their ``samples``; those with less than half a second are left out."""
    from voxloom.operators.vad import slice_audio

    return slice_audio(windows, blocks, block).where(F.size("samples") >= rate // 2)


def _last_max(x: np.ndarray) -> np.ndarray:
    return x.shape[-1] - 1 - np.argmax(x[..., ::-1], axis=-1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 50) -> list[int]:
    """k clusters of centred unit vectors, seeded farthest first; ValueError if one is empty at the end.

    Of equally far seeds and equally close centres, the last counts. A cluster that is empty in a round
    keeps its centre.
    """
    if not 1 <= k <= min(12, len(x)):
        raise ValueError("k is out of range")
    y = x - x.mean(axis=0)
    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-8)
    seeds = [0]
    while len(seeds) < k:
        seeds.append(int(_last_max(-(y @ y[seeds].T).max(axis=1))))
    centres = y[seeds]
    for _ in range(rounds):
        label = _last_max(y @ centres.T)
        for c in set(label.tolist()):
            total = y[label == c].sum(axis=0)
            centres[c] = total / max(float(np.linalg.norm(total)), 1e-8)
    first: dict[int, int] = {}
    labels = [first.setdefault(c, len(first)) for c in label.tolist()]
    if len(first) < k:
        raise ValueError("a cluster is empty")
    return labels


def two_speakers(x: np.ndarray) -> list[int] | None:
    """Two clusters from the least similar pair, or None if they aren't apart.

    Each needs two vectors, and a mean similarity to its centre well above that of the two centres.
    Of equally close centres, the first counts.
    """
    n = len(x)
    if n < 2:
        return None
    lows = []
    for a in range(0, n, ROWS):
        part = x[a : a + ROWS] @ x.T
        part[np.arange(n)[None, :] <= np.arange(a, a + len(part))[:, None]] = np.inf
        at = int(part.argmin())
        lows.append((float(part.flat[at]), a + at // n, at % n))
    centres = x[list(min(lows)[1:])]
    for _ in range(20):
        near = x @ centres.T
        label = (near[:, 1] > near[:, 0]).astype(int)
        sums = np.stack([x[label == c].sum(axis=0) for c in (0, 1)])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        if not 0 < label.sum() < n or (norm < 1e-6).any():
            return None
        centres = sums / norm
    cross = float(centres[0] @ centres[1])
    own = [(x[label == c] @ centres[c]).mean() for c in (0, 1)]
    if min(label.sum(), n - label.sum()) < 2 or cross > TWO_SIMILARITY or min(own) - cross < TWO_MARGIN:
        return None
    return label.tolist()


def cluster(vectors: DataFrame, method: str = "auto", k: int = 2, in_task: int = linkage.IN_TASK, block: int = linkage.BLOCK) -> DataFrame:
    """(tid, window_id, speaker, status) of (tid, window_id, embedding). Status tells what went wrong.

    A recording is one group; with ``auto``, one of more than ``in_task`` windows is clustered by many tasks,
    with the same result. Windows count in the order of window_id.
    """
    if method != "auto":
        return _in_groups(vectors, method, k)
    sizes = saved(vectors.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_task), "linkage-long")
    if sizes.isEmpty():
        return _in_groups(vectors, method, k)
    return _in_groups(vectors.join(sizes, "tid", "left_anti"), method, k).unionByName(_long(vectors.join(sizes.select("tid"), "tid", "left_semi"), block))


def _long(vectors: DataFrame, block: int) -> DataFrame:
    """Clusters of the windows of long recordings; a recording with a ragged or bad vector has its status instead."""
    from voxloom.operators.tree import numbered

    rows = normalize_vectors(vectors.select("tid", "window_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding")))
    checks = rows.groupBy("tid").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("low") != F.col("high"), "ragged").when(~F.col("ok"), "not finite").otherwise("ok")
    checks = saved(checks.select("tid", "n", status.alias("status")), "linkage-checks")
    # Numbers over all long recordings in the order of tid and window; within one they start at its first.
    placed = saved(numbered(rows.select("tid", "window_id", "unit"), "row", F.col("tid"), F.col("window_id")), "linkage-rows")
    first = placed.groupBy("tid").agg(F.min("row").alias("first"))
    placed = placed.join(first, "tid").join(checks, "tid").select("tid", "window_id", "unit", "status", (F.col("row") - F.col("first")).cast("long").alias("place"))
    good = linkage.long_recordings(placed.where("status = 'ok'"), block=block)
    labelled = placed.join(good, ["tid", "place"], "left")
    return labelled.select("tid", "window_id", "speaker", "status")


def _in_groups(vectors: DataFrame, method: str, k: int) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("window_id")
        labels: list[int] | None = None
        status = "ok"
        if p["embedding"].map(len).nunique() > 1:
            status = "ragged"
        else:
            x = np.stack([np.asarray(e, np.float64) for e in p["embedding"]])
            norm = np.linalg.norm(x, axis=1)
            if not np.isfinite(x).all() or (norm < 1e-6).any():
                status = "not finite"
            else:
                x = x / norm[:, None]
                try:
                    labels = {"auto": lambda: average_linkage(x), "k": lambda: spherical_kmeans(x, k), "two": lambda: two_speakers(x)}[method]()
                    status = "ok" if labels is not None else "one speaker"
                except ValueError as e:
                    status = str(e)
        return pd.DataFrame({"tid": p["tid"], "window_id": p["window_id"], "speaker": pd.array(labels if labels is not None else [None] * len(p), "Int32"), "status": status})

    return vectors.select("tid", "window_id", "embedding").groupBy("tid").applyInPandas(run, "tid string, window_id long, speaker int, status string")


def dominant_speaker(votes: DataFrame) -> DataFrame:
    """(tid, segment_index, speaker, n): most votes (tid, segment_index, label), the highest number of equals."""
    counts = votes.groupBy("tid", "segment_index", "label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("tid", "segment_index").agg(F.max(F.struct("n", "label")).alias("x"))
    return top.select("tid", "segment_index", F.concat(F.lit("Speaker "), (F.col("x.label") + 1).cast("string")).alias("speaker"), F.col("x.n").alias("n"))


def label_segments(segments: DataFrame, votes: DataFrame) -> DataFrame:
    """Segments with the dominant speaker of their windows; those without windows keep their label."""
    won = dominant_speaker(votes).select("tid", "segment_index", F.col("speaker").alias("won"))
    return segments.join(won, ["tid", "segment_index"], "left").withColumn("speaker_id", F.coalesce("won", "speaker_id")).drop("won")


def match_speakers(segments: DataFrame, turns: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """(tid, segment_index, speaker): the turn speaker that covers half of a segment and is well ahead of the next.

    Both sides are posted in time buckets; a pair counts in the first bucket it shares.
    """
    spread = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket_ms), F.floor((F.col(b) - 1) / bucket_ms))))
    seg = spread(segments.where("end_ms > start_ms").select("tid", "segment_index", "start_ms", "end_ms"), "start_ms", "end_ms")
    turn = spread(turns.where("end > start").select("tid", "speaker", F.col("start").alias("ts"), F.col("end").alias("te")), "ts", "te")
    once = F.col("bucket") == F.floor(F.greatest("start_ms", "ts") / bucket_ms)
    shared = F.least("end_ms", "te") - F.greatest("start_ms", "ts")
    rows = seg.join(turn, ["tid", "bucket"]).where(once & (shared > 0)).groupBy("tid", "segment_index", "start_ms", "end_ms", "speaker").agg(F.sum(shared).alias("overlap"))
    ranked = rows.groupBy("tid", "segment_index", "start_ms", "end_ms").agg(F.sort_array(F.collect_list(F.struct("overlap", "speaker")), asc=False).alias("x"))
    best, second = F.col("x")[0]["overlap"], F.coalesce(F.get("x", F.lit(1))["overlap"], F.lit(0))
    return ranked.where((best * 2 >= F.col("end_ms") - F.col("start_ms")) & (second * 5 < best * 4)).select("tid", "segment_index", F.col("x")[0]["speaker"].alias("speaker"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pairwise_cosine(vectors: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(tid, a, b, similarity) of all pairs a < b of the windows of a recording: the result is the pairs.

    A recording's windows are dealt to blocks of about ``block``; each pair of blocks is a group of its own, which
    gives the products of :data:`ROWS` rows at once. The similarity to a vector of zeros or another length is null.
    """
    rows = vectors.select("tid", "window_id", "embedding")
    blocks = rows.groupBy("tid").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(blocks.hint("merge"), "tid").withColumn("own", F.pmod(F.xxhash64("window_id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rows.select("tid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "window_id", "embedding")
    keys, kinds = ["tid", "i", "j"], vectors.schema

    def run(batches):
        for batch, starts in whole_groups(batches, keys):
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                group = batch.slice(int(a), int(b - a))
                tid, ids = group.column("tid").slice(0, 1), group.column("window_id")
                x, size = padded(group.column("embedding"))
                norms = (x * x).sum(axis=1)
                alone = group.column("i")[0] == group.column("j")[0]
                first = len(x) if alone else int((~group.column("second").to_numpy(zero_copy_only=False)).sum())
                begin = 0 if alone else first
                for at in range(0, first, ROWS):
                    left, right = np.divmod(np.arange((min(at + ROWS, first) - at) * (len(x) - begin)), max(len(x) - begin, 1))
                    left, right = left + at, right + begin
                    p, q = ids.take(pa.array(left)), ids.take(pa.array(right))
                    both = norms[left] * norms[right]
                    known = (both > 0) & (size[left] == size[right])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        values = (x[at : at + ROWS][: first - at] @ x[begin:].T).reshape(-1) / np.sqrt(both)
                    out = pa.RecordBatch.from_arrays([tid.take(pa.array(np.zeros(len(left), np.int64))), p, q, pa.array(values, mask=~(known | np.isnan(both)))], names=["tid", "a", "b", "similarity"])
                    if alone:
                        yield out.filter(pc.less(p, q))
                    else:
                        swap = pc.greater(p, q)
                        yield pa.RecordBatch.from_arrays([out.column(0), pc.if_else(swap, q, p), pc.if_else(swap, p, q), out.column(3)], names=out.schema.names)

    schema = T.StructType([T.StructField("tid", kinds["tid"].dataType), *(T.StructField(c, kinds["window_id"].dataType) for c in "ab"), T.StructField("similarity", T.DoubleType())])
    return pairs.repartition(*keys).sortWithinPartitions(*keys, "second").mapInArrow(run, schema)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one matrix, filled up with zeros, and their lengths, -1 for a null."""
    offsets, values = lists(column)
    size = np.diff(offsets)
    x = np.zeros((len(size), int(size.max(initial=0))))
    x[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(offsets[:-1], size)] = values
    return x, np.where(column.is_null().to_numpy(zero_copy_only=False), -1, size)


def window_experiment(windows: DataFrame, reference: DataFrame, bucket: int = 160_000) -> DataFrame:
    """(setting, windows, inside, dominant): of windows (setting, tid, start, end, label), how many lie inside a
    reference interval (tid, start, end, speaker), and how many of those have their speaker's commonest label.

    Intervals are posted in buckets of time; a window meets them in the bucket that it starts in.
    """
    n = windows.groupBy("setting").agg(F.count(F.lit(1)).alias("windows"))
    known = reference.where("end > start").select("tid", F.col("start").alias("rs"), F.col("end").alias("re"), "speaker")
    known = known.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("rs") / bucket), F.floor((F.col("re") - 1) / bucket))))
    placed = windows.withColumn("bucket", F.floor(F.col("start") / bucket))
    inside = placed.join(known, ["tid", "bucket"]).where("start >= rs and end <= re")
    counts = inside.groupBy("setting", "speaker", "label").agg(F.count(F.lit(1)).alias("k"))
    top = counts.groupBy("setting", "speaker").agg(F.sum("k").alias("all"), F.max("k").alias("top")).groupBy("setting").agg(F.sum("all").alias("inside"), F.sum("top").alias("dominant"))
    return n.join(top, "setting", "left")
