"""Streams over files; results equal those of the batch operators."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import journal, vad
from voxloom.streaming import jobs as S


def drain(df, spark, tmp_path, mode="append", name="out"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_blocks_are_split(spark, tmp_path):
    good = {"version": 1, "session_id": "s", "track_id": "m", "seq": 0, "idempotency_key": "s:m:0", "sample_rate": 48000, "absolute_sample_start": 0, "duration_samples": 480}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(x) for x in (good, good | {"seq": -1}, good | {"version": 2})))
    S.stream_blocks(spark, str(tmp_path / "in"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["position", "version"]


def test_durable_cursor(spark, tmp_path):
    b = spark.createDataFrame([("s", "m", q) for q in (3, 0, 1, 5, 2)], "session_id string, track_id string, seq long")
    b.write.parquet(str(tmp_path / "b"))
    out = drain(S.stream_durable_cursor(spark.readStream.schema(b.schema).parquet(str(tmp_path / "b"))), spark, tmp_path, "update", "cursor").agg(F.max("durable").alias("d")).head()["d"]
    assert out == journal.durable_prefix(b).head()["durable"] == 3


def test_vad_stream_is_like_the_batch(spark, tmp_path):
    probs = [0.9 if 10 <= i < 40 or 60 <= i < 90 else 0.0 for i in range(120)]
    f = spark.createDataFrame([("t", "file", i, p, i == 119) for i, p in enumerate(probs)], "tid string, track string, frame int, prob double, final boolean")
    f.repartition(3).write.parquet(str(tmp_path / "f"))
    out = drain(S.stream_vad_segments(spark.readStream.schema(f.schema).parquet(str(tmp_path / "f"))), spark, tmp_path, name="vad")
    n = spark.createDataFrame([("t", "file", 120 * 512)], "tid string, track string, audio_len long")
    batch = vad.chunk_regions(vad.pad_and_merge_regions(vad.speech_regions(f.drop("final"), n), n))
    assert sorted((r["start"], r["end"]) for r in out.collect()) == sorted((r["start"], r["end"]) for r in batch.collect())


def test_many_frames_are_like_each():
    r = random.Random(8)
    for _ in range(60):
        probs = []
        while len(probs) < 4000:
            probs += [r.choice([0.1, 0.4, 0.9])] * r.choice([1, 2, 4, 5, 30, 600, 900])
        one, many, want, got = S.Scanner(), S.Scanner(), [], []
        at = 0
        while at < len(probs):
            n = r.choice([1, 50, 3000])
            for p in probs[at : at + n]:
                want += one.push(p)
            got += many.push_all(np.array(probs[at : at + n]))
            assert many.state() == one.state()
            at += n
        assert got + many.finish() == want + one.finish()


def test_frames_are_dealt_together(spark, tmp_path):
    f = spark.range(1000).selectExpr("'t' AS tid", "'file' AS track", "cast(id AS int) AS frame", "if(id % 100 < 50, 0.9D, 0.1D) AS prob", "id = 999 AS final")
    f.coalesce(1).write.parquet(str(tmp_path / "f"))
    runs = S._frame_runs(spark.read.parquet(str(tmp_path / "f")), False).collect()
    assert [(x["first"], len(x["probs"]), x["last"]) for x in runs] == [(0, 1000, 999)]
    # Out of order, a part of the frames missing at first, and with times.
    timed = f.withColumn("ts", F.timestamp_seconds(F.col("frame") % 10 + 1_000_000))
    for k, part in enumerate((timed.where("frame >= 500"), timed.where("frame < 500").orderBy(F.desc("frame")), timed.where("frame = 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    for name, source in (("whole", "f"), ("parts", "g")):
        stream = spark.readStream.schema(f.schema if source == "f" else timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / source))
        out = drain(S.stream_vad_segments(stream), spark, tmp_path, name=name).collect()
        scanner = S.Scanner()
        want = [c for k in range(1000) for c in scanner.push(0.9 if k % 100 < 50 else 0.1)] + scanner.finish()
        assert sorted((x["start"], x["end"]) for x in out) == want and len(want) > 1


def test_tracks_end_with_the_watermark(spark, tmp_path):
    f = spark.range(100).selectExpr("'file' AS track", "cast(id AS int) AS frame", "if(id BETWEEN 10 AND 59, 0.9D, 0.4D) AS prob", "false AS final")
    for tid, at in (("a", 1_000_000), ("b", 1_010_000), ("b", 1_020_000), ("c", 1_030_000)):
        part = f.withColumn("tid", F.lit(tid)).withColumn("ts", F.timestamp_seconds(F.lit(at)))
        part.where("tid <> 'a' or frame <> 80").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    out = drain(S.stream_vad_segments(stream), spark, tmp_path, name="late").collect()
    assert {(x["tid"], x["start"], x["end"]) for x in out} == {(t, 10 * 512 - vad.PAD, 100 * 512) for t in "ab"}


def test_upserts(spark, tmp_path):
    c = spark.createDataFrame([("s", "a", 0, 1, "x"), ("s", "a", 1, 3, "y"), ("s", "a", 2, 3, "z"), ("s", "b", 3, 1, "w")], "session_id string, change_id string, arrival long, revision long, payload string")
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    S.stream_upsert_segments(spark.readStream.schema(c.schema).parquet(str(tmp_path / "c")), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "t" / "version=0"))
    want = journal.upsert_segments(c)
    assert sorted((r["change_id"], r["payload"]) for r in got.collect()) == sorted((r["change_id"], r["payload"]) for r in want.collect()) == [("a", "y"), ("b", "w")]


def test_levels_and_sessions(spark):
    p = spark.sql("SELECT 's' AS session_id, 'm' AS track_id, timestamp_seconds(id * 5 + if(id > 3, 100, 0)) AS ts, 4.0D AS power, 1L AS n, 0L AS gap_ms, false AS resync FROM range(6)")
    assert S.stream_levels(p).count() == 3
    assert sorted(r["packets"] for r in S.session_activity(p).collect()) == [2, 4]
