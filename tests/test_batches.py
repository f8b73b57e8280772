"""Operators over batches of many groups: groups cut by batches, and plans without a Python call for each group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import audio, speakers, vad


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[1, 3, 10_000])
def batch_rows(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


def test_resampling_in_batches(spark, batch_rows):
    r, rows, tracks = np.random.default_rng(7), [], {}
    for t in range(12):
        rate, x, at = (48, 16, 8)[t % 3], r.normal(size=t * 9 + 1).astype(np.float32), 0
        tracks[f"t{t}"] = (x, rate)
        while at < len(x):
            k = int(r.integers(1, 20))
            rows.append((f"t{t}", "file", at, x[at : at + k].tolist(), rate))
            at += k
    d = audio.resample_tracks(spark.createDataFrame(rows, "tid string, track string, block_start long, samples array<float>, rate int"), 16, 10)
    assert "FlatMapGroups" not in plan(d)
    got = {}
    for row in d.collect():
        got.setdefault(row["tid"], {})[row["block_start"]] = row["samples"]
    for t, (x, rate) in tracks.items():
        want = audio.resample_exact(x.astype(np.float64), rate, 16).tolist()
        assert [v for _, s in sorted(got.get(t, {}).items()) for v in s] == want


@pytest.mark.parametrize("mode", ["sum", "mean"])
def test_mixing_in_batches(spark, batch_rows, mode):
    r, rows, want = random.Random(3), [], {}
    for t in range(6):
        n = t % 3 + 1
        for k in range(n):
            offset = r.choice([0.0, 0.75, 2.5])
            for start in range(0, 12, 4):
                x = [r.randint(-8, 8) / 16 for _ in range(r.randint(0, 4))]
                rows.append((f"t{t}", f"m{k}", start, x, offset))
                for i, v in enumerate(x):
                    at = (f"t{t}", start + int(offset * 4) + i)
                    want[at] = want.get(at, 0) + v / (n if mode == "mean" else 1)
    d = audio.mix_tracks(spark.createDataFrame(rows, "tid string, track string, block_start long, samples array<double>, offset_s double"), 4, mode, 5)
    assert "FlatMapGroups" not in plan(d)
    got = {(x["tid"], x["block_start"] + i): v for x in d.collect() for i, v in enumerate(x["samples"]) if v}
    assert got == pytest.approx({k: max(-1, min(1, v)) for k, v in want.items() if v})


def test_scores_in_batches(spark, batch_rows):
    def scorer():
        def score(frame, state):
            total = (state or 0.0) + float(frame.sum())
            return total, total

        return score

    r, rows, want = np.random.default_rng(5), [], []
    for t in range(5):
        x, at = r.integers(0, 9, size=400 * t + 1).astype(np.float32), 0
        while at < len(x):
            k = int(r.integers(1, 900))
            rows.append((f"t{t}", "file", at, x[at : at + k].tolist()))
            at += k
        n = -(-len(x) // 512)
        padded = np.concatenate([np.zeros(64, np.float32), x, np.zeros(n * 512 - len(x), np.float32)])
        want += zip([f"t{t}"] * n, range(n), np.cumsum([padded[i * 512 : i * 512 + 576].sum() for i in range(n)]).tolist())
    r.shuffle(rows)
    d = vad.score_vad(spark.createDataFrame([(a, b, int(c), x) for a, b, c, x in [(str(a), str(b), c, list(x)) for a, b, c, x in rows]], "tid string, track string, block_start long, samples array<float>"), scorer)
    assert "FlatMapGroups" not in plan(d)
    assert sorted((x["tid"], x["frame"], x["prob"]) for x in d.collect()) == want


def regions(probs, length):
    """Regions of frames {frame: probs}, one frame after the other."""
    found, start, sil = [], None, None
    for f in sorted(probs):
        if any(p >= 0.5 for p in probs[f]):
            start, sil = (f * 512 if start is None else start), None
        if any(p < 0.35 for p in probs[f]) and start is not None:
            sil = f * 512 if sil is None else sil
            if f * 512 - sil >= 1600:
                found, start, sil = [*found, (start, sil)], None, None
    found += [(start, length)] if start is not None else []
    return [x for x in found if x[1] - x[0] >= 3200]


def test_regions_in_batches(spark, batch_rows):
    r, rows, lengths, want = random.Random(11), [], [], set()
    for t in range(8):
        n, probs, p = r.choice([5, 300, 2500]), {}, 0.0
        for f in range(n):
            p = p if r.random() < (0.5, 0.9, 0.99)[t % 3] else r.choice([0.1, 0.4, 0.9])
            if r.random() < 0.97:
                probs[f] = [p] if r.random() < 0.97 else [p, 0.2]
        rows += [(f"t{t}", "file", f, p) for f, ps in probs.items() for p in ps]
        lengths.append((f"t{t}", "file", n * 512))
        want |= {(f"t{t}", a, b) for a, b in regions(probs, n * 512)}
    r.shuffle(rows)
    frames = spark.createDataFrame(rows, "tid string, track string, frame long, prob double")
    d = vad.speech_regions(frames, spark.createDataFrame(lengths, "tid string, track string, audio_len long"))
    # Frames are gathered before they are dealt.
    assert "partial_bit_or" in plan(d) and "Broadcast" not in plan(d)
    assert {(x["tid"], x["start"], x["end"]) for x in d.collect()} == want and len(want) > 20


def test_regions_of_a_long_track(spark):
    n = 3 * vad.WORD * vad.WORDS // 2
    frames = spark.range(n).select(F.lit("t").alias("tid"), F.lit("file").alias("track"), F.col("id").alias("frame"), F.when(F.col("id") % 1_000_000 < 999_990, 0.9).otherwise(0.1).alias("prob"))
    d = vad.speech_regions(frames, spark.createDataFrame([("t", "file", n * 512)], "tid string, track string, audio_len long"))
    ends = [(999_990 + k * 1_000_000) * 512 for k in range(n // 1_000_000)]
    assert sorted((x["start"], x["end"]) for x in d.collect()) == list(zip([0, *(e + 10 * 512 for e in ends)], [*ends, n * 512]))


def test_pairs_in_blocks(spark, batch_rows):
    r = np.random.default_rng(2)
    rows = [(f"r{k % 3}", int(i), (r.normal(size=4) * (k != 7)).astype(np.float32).tolist()) for k, i in enumerate(r.permutation(60))] + [("lone", 1, [1.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "tid string, window_id long, embedding array<float>")
    want = {(t, a, b): None if not any(x) or not any(y) else float(np.dot(np.float64(x), y) / np.sqrt(np.dot(np.float64(x), x) * np.dot(np.float64(y), y))) for t, a, x in rows for u, b, y in rows if t == u and a < b}
    for block in (4, 2048):
        d = speakers.pairwise_cosine(vectors, block)
        # A recording is more than one group, and no row a pair is joined.
        assert plan(d).count("Join") == 1
        got = [tuple(x) for x in d.collect()]
        assert len(got) == len(want) and {x[:3]: x[3] for x in got} == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want.items()}
