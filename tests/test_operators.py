"""Small inputs with known results, one group per module."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import columns as C
from voxloom.operators import audio, decode, export, jobs, journal, quality, snapshots, speakers, transcript, tree, vad
from voxloom.sources import readers


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head()["x"]


def test_timestamps(spark):
    assert one(spark, C.format_timestamp(F.lit(3661.007), ",")) == "01:01:01,007"
    assert one(spark, C.format_timestamp(F.lit(1.9996))) == "00:00:02.000"
    assert one(spark, C.format_timestamp(F.lit(360000.0))) == "100:00:00.000"
    assert one(spark, C.archive_timestamp(F.lit(0))) == "19700101-000000"


def test_upper_letters(spark):
    for text, want in {"straße é": "STRAẞE É", "ŉa": "ŉA", "": "", "ﬁx ñ": "ﬁX Ñ", "a\nb": "A\nB"}.items():
        assert one(spark, C.upper_letters(F.lit(text))) == want
    # As in the SQL of x4_echo_text_matches, a sentence matches itself in upper case.
    assert one(spark, C.echo_text_matches(F.lit("Pfber heißkeit dem."), C.upper_letters(F.lit("Pfber heißkeit dem."))))


def test_late_timestamps(spark):
    assert one(spark, C.archive_timestamp(F.lit(8_999_999 * 86_399_000))) == "266101116-200001"
    assert one(spark, C.archive_timestamp(F.lit(-62_000_000_000_000))) == "00050419-094640"


@pytest.mark.parametrize(("new", "old", "want"), [("v1.10.0", "1.9.9", True), ("1.2.3-rc1", "1.0.0", False), ("x", "1.0.0", False), ("1.0.0", "1.0.0", False)])
def test_versions(spark, new, old, want):
    assert one(spark, C.newer_stable_version(F.lit(new), F.lit(old))) is want


def test_sql_functions(spark):
    C.register_sql_functions(spark)
    assert spark.sql("SELECT format_timestamp(3661.007D, ',') AS x, normalized_text('Да, É!') AS y, normalized_words('a, B') AS z").head() == ("01:01:01,007", "даé", ["a", "b"])


def segments(spark, *items):
    data = [(t, i, s, e, x, k, None) for t, i, s, e, x, k in items]
    return spark.createDataFrame(data, "tid string, segment_index long, start_ms long, end_ms long, text string, source_track string, speaker_id string")


def test_labelled_text(spark):
    s = segments(spark, ("t", 0, 65125, 67500, "Привет", "microphone"), ("t", 1, 68000, 69000, "Ответ", "system"))
    assert export.export_txt(s).head()["document"] == "[00:01:05.125] Микрофон: Привет\n[00:01:08.000] Система: Ответ"
    assert export.export_srt(s).head()["document"].startswith("1\n00:01:05,125 --> 00:01:07,500\n")
    assert export.export_vtt(s).head()["document"].startswith("WEBVTT\n\n00:01:05.125")


def test_echo(spark):
    copy, other = "мы начинаем новый проект сегодня", "совсем другие слова здесь были"
    s = segments(spark, ("t", 0, 0, 2000, copy, "system"), ("t", 1, 300, 2100, copy + " да", "microphone"), ("t", 2, 0, 2000, other, "microphone"), ("t", 3, 5800, 7000, copy, "microphone"), ("u", 0, 0, 1, copy, "microphone"))
    assert rows(transcript.suppress_microphone_echo(s), "tid", "segment_index") == [("t", 0), ("t", 2), ("t", 3), ("u", 0)]


def test_echo_of_joined_candidates(spark):
    s = segments(spark, ("t", 0, 0, 1000, "one two three", "system"), ("t", 1, 1000, 2000, "four five six", "system"), ("t", 2, 0, 2000, "one two three four five six", "microphone"))
    assert rows(transcript.suppress_microphone_echo(s), "segment_index") == [(0,), (1,)]


def test_join_phrases(spark):
    s = segments(spark, ("t", 0, 0, 1000, "начало", "file"), ("t", 1, 1000, 2000, "конец.", "file"), ("t", 2, 2000, 3000, "next", "file"), ("t", 3, 5000, 6000, "far", "file"))
    assert rows(transcript.join_phrases(s), "segment_index", "end_ms", "text") == [(0, 2000, "начало конец."), (2, 3000, "next"), (3, 6000, "far")]
    assert rows(transcript.join_phrases(s, most_bytes=14), "segment_index") == [(0,), (1,), (2,), (3,)]


def test_validate_events(spark):
    e = spark.createDataFrame([(1, "s", "a", "k", 0, 0, 0.0, 1.0), (1, "s", "a", "k", 0, 0, 0.0, 0.0), (2, "s", "a", "k", 0, 0, 0.0, 1.0)], "version int, session_id string, segment_id string, idempotency_key string, seq long, revision long, start_seconds double, end_seconds double")
    assert [r["reason"] for r in transcript.validate_events(e).collect()] == [None, "time", "version"]


def frames(spark, probs, tid="t"):
    return spark.createDataFrame([(tid, "file", i, float(p)) for i, p in enumerate(probs)], "tid string, track string, frame int, prob double"), spark.createDataFrame([(tid, "file", len(probs) * 512)], "tid string, track string, audio_len long")


def test_regions(spark):
    f, n = frames(spark, [0.9 if 10 <= i < 40 else 0 for i in range(100)])
    assert rows(vad.pad_and_merge_regions(vad.speech_regions(f, n), n), "start", "end") == [(10 * 512 - 1920, 40 * 512 + 1920)]
    f, n = frames(spark, [0.9] * 8)
    assert rows(vad.pad_and_merge_regions(vad.speech_regions(f, n), n), "start", "end") == [(0, 4096)]


def test_regions_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    for k in range(4):
        probs = np.round(rng.random(300) ** (1 + k), 2)
        want, start, sil = [], -1, -1
        for i, p in enumerate(probs):
            if p >= 0.5:
                start, sil = (i * 512 if start < 0 else start), -1
            elif p < 0.35 and start >= 0:
                sil = i * 512 if sil < 0 else sil
                if i * 512 - sil >= 1600:
                    if sil - start >= 3200:
                        want.append((start, sil))
                    start = sil = -1
        if start >= 0 and 300 * 512 - start >= 3200:
            want.append((start, 300 * 512))
        f, n = frames(spark, probs)
        assert rows(vad.speech_regions(f, n), "start", "end") == want


def test_every_order_is_a_recording(spark, tmp_path):
    from voxloom.plans import registry

    keys = range(1, 12)
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    want, chunks = set(), set()
    for k in keys:
        probs = [(k * 31 + f // 12 * 17) % 100 for f in range(200)]
        length, start, quiet, found = 200 * 512 - k % 512, None, None, []
        for f, p in enumerate(probs):
            if p >= 50:
                start, quiet = (f * 512 if start is None else start), None
            elif p < 35 and start is not None:
                quiet = f * 512 if quiet is None else quiet
                if f * 512 - quiet >= 1600:
                    found.append((start, quiet))
                    start = quiet = None
        found += [(start, length)] if start is not None else []
        found = [x for x in found if x[1] - x[0] >= 3200]
        want |= {(f"o{k}", *x) for x in found}
        padded = []
        for s, e in ((max(s - 1920, 0), min(e + 1920, length)) for s, e in found):
            if padded and s <= padded[-1][1]:
                padded[-1] = (padded[-1][0], max(e, padded[-1][1]))
            else:
                padded.append((s, e))
        chunks |= {(f"o{k}", *x) for x in vad.repair_short_chunks(vad.chunks_of(padded))}
    assert {tuple(r) for r in registry.QUERIES["v2_all_speech_regions"](spark, str(tmp_path)).collect()} == want and len({x[0] for x in want}) == 11
    assert {(r["tid"], r["start"], r["end"]) for r in registry.QUERIES["v4_all_chunks"](spark, str(tmp_path)).collect()} == chunks


def test_chunks():
    s = 16_000
    assert vad.chunks_of([(0, 16 * s), (17 * s, 20 * s)]) == [(0, 16 * s), (17 * s, 20 * s)]
    assert vad.repair_short_chunks(vad.chunks_of([(0, 352_319)])) == [(0, 352_319)]
    assert vad.repair_short_chunks([(0, 100)]) == []


def test_slice_audio(spark):
    blocks = spark.createDataFrame([("t", "m", 0, [0.0, 1.0, 2.0, 3.0]), ("t", "m", 4, [4.0, 5.0])], "tid string, track string, block_start long, samples array<float>")
    spans = spark.createDataFrame([("t", "m", 2, 5)], "tid string, track string, start long, end long")
    assert vad.slice_audio(spans, blocks, 4).head()["samples"] == [2, 3, 4]
    # However small its estimate, no side goes through the driver.
    assert "Broadcast" not in vad.slice_audio(spans, blocks, 4)._jdf.queryExecution().executedPlan().toString()


def test_ctc(spark):
    vocab = spark.createDataFrame([(0, "<blk>"), (1, " да"), (2, "."), (3, " нет"), (4, "?")], "token_id int, token string")
    ids = [1, 1, 2, 0, 3, 4, 0]
    f = spark.createDataFrame([("c", i, [1.0 if k == t else 0.0 for k in range(5)]) for i, t in enumerate(ids)], "chunk_id string, frame int, scores array<double>")
    assert decode.ctc_decode(f, vocab).head()["text"] == "да. нет?"
    p = decode.ctc_phrases(f, vocab, spark.createDataFrame([("c", 7.0, 7)], "chunk_id string, duration double, n_frames int")).orderBy("phrase").collect()
    assert [(r["text"], r["start"]) for r in p] == [("да.", 0.0), ("нет?", p[0]["end"])] and p[0]["end"] == 3.5
    tie = spark.createDataFrame([("c", 0, [1.0, 1.0, 1.0])], "chunk_id string, frame int, scores array<double>")
    assert decode.ctc_decode(tie, vocab).head()["text"] == "."


def test_clusters():
    eye = np.eye(4)
    x = np.repeat(eye, 2, axis=0) + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert speakers.average_linkage(x) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert speakers.average_linkage(np.array([[1, 0], [0.99, 0.1], [0.98, 0.15]]) / 1.0) == [0, 0, 0]
    assert speakers.spherical_kmeans(x, 4) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert speakers.two_speakers(np.array([[1, 0], [0.99, 0.14], [0, 1], [0.14, 0.99]])) == [0, 0, 1, 1]
    assert speakers.two_speakers(np.ones((6, 2)) / 2**0.5) is None


def test_votes_and_matches(spark):
    votes = spark.createDataFrame([("t", 0, x) for x in (0, 1, 1, 1)] + [("t", 1, 0), ("t", 1, 1)], "tid string, segment_index long, label int")
    assert rows(speakers.dominant_speaker(votes), "segment_index", "speaker") == [(0, "Speaker 2"), (1, "Speaker 2")]
    turns = spark.createDataFrame([("t", 0, 0, 1000), ("t", 1, 1000, 2000)], "tid string, speaker int, start long, end long")
    s = segments(spark, ("t", 0, 0, 900, "a", "file"), ("t", 1, 500, 1500, "b", "file"))
    assert rows(speakers.match_speakers(s, turns), "segment_index", "speaker") == [(0, 0)]


def test_offsets_and_gaps(spark):
    p = spark.createDataFrame([("s", "microphone", 0, 0), ("s", "microphone", 1, 10_000_000), ("s", "system", 2, 30_000_000)], "session string, track string, arrival long, ticks long")
    assert rows(audio.track_start_offset(p), "track", "offset_s") == [("microphone", 0.0), ("system", 2.0)]
    g = spark.createDataFrame([("s", "m", 0, 0.249, 480)], "session string, track string, arrival long, offset_s double, n int")
    assert rows(audio.gap_diagnostics(g), "gap_ms", "resyncs") == [(249, 0)]


def test_audio_expressions(spark):
    x = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.5, 0.5, 9.0)])
    assert one(spark, audio.downmix(x, F.lit(2))) == [0.5, 0.5]
    assert one(spark, audio.apply_gain(x, F.lit(4.0), F.lit("microphone"))) == [1.0, 0.0, 1.0, 1.0, 1.0]
    assert one(spark, audio.apply_gain(x, F.lit(4.0), F.lit("system"))) == [1.0, 0.0, 0.5, 0.5, 9.0]
    assert one(spark, audio.rms_level(F.array(F.lit(3.0), F.lit(4.0)), 1)) == 4.0


def test_mix(spark):
    t = spark.createDataFrame([("t", "a", 0, [0.75, 0.75], 0.0), ("t", "b", 0, [0.5, 0.25, 0.25], 1 / 48000)], "tid string, track string, block_start long, samples array<double>, offset_s double")
    out = {r["block_start"]: r["samples"] for r in audio.mix_tracks(t, block=2).collect()}
    assert out == {0: [0.75, 1.0], 2: [0.25, 0.25]}
    assert audio.mix_tracks(t, mode="mean", block=8).head()["samples"] == [0.375, 0.625, 0.125, 0.125]


def test_resampling_and_spectra():
    x = np.sin(np.arange(4800) * 0.02)
    y = audio.resample_exact(x, 48_000, 16_000)
    assert len(y) == 1600 and np.abs(y[50:-50] - x[::3][50:-50]).max() < 0.01
    assert audio.speaker_log_mel(np.random.default_rng(0).normal(size=16_000)).shape == (98, 80)
    assert audio.asr_log_mel(np.zeros(320)).shape == (1, 64)
    with pytest.raises(ValueError):
        audio.asr_log_mel(np.zeros(319))


def test_heads(spark):
    schema = "original_id string, revision string, parent_revision string, merge_a string, merge_b string"
    s = spark.createDataFrame([("o", "base", None, None, None), ("o", "left", "base", None, None), ("o", "right", "base", None, None)], schema)
    assert rows(snapshots.conflict_heads(s), "revision") == [("left",), ("right",)]
    m = s.union(spark.createDataFrame([("o", "merged", "left", "left", "right")], schema))
    assert rows(snapshots.snapshot_branches(m).where("is_head"), "revision", "concurrent") == [("merged", False)]


def test_revision_cycle(spark):
    schema = "original_id string, revision string, parent_revision string, merge_a string, merge_b string, manifest string"
    s = spark.createDataFrame([("o", "a", "b", None, None, "x"), ("o", "b", "a", None, None, "x"), ("p", "a", "gone", None, None, "x"), ("q", "a", None, None, None, "x"), ("q", "a", None, None, None, "y")], schema)
    assert rows(snapshots.validate_revision_graph(s), "original_id", "reason") == [("o", "cycle"), ("q", "duplicate")]


def nodes(spark, *items):
    return spark.createDataFrame(list(items), "id string, kind string, parent_id string, name string, position long")


def test_tree(spark):
    n = nodes(spark, ("f", "folder", None, "F", 0), ("g", "folder", "f", "G", 0), ("a", "recording", "g", "A", 0), ("b", "recording", None, "B", 1))
    assert [r["id"] for r in tree.visible_tree(n).orderBy("row").collect()] == ["f", "g", "a", "b"]
    assert [r["id"] for r in tree.visible_tree(n, ["g"]).orderBy("row").collect()] == ["f", "g", "b"]
    assert rows(tree.folder_paths(n), "path") == [("F",), ("F / G",)]
    assert rows(tree.move_nodes(n, ["a"], None, 0).where("parent_id is null"), "position", "id") == [(0, "a"), (1, "f"), (2, "b")]
    with pytest.raises(ValueError):
        tree.move_nodes(n, ["f"], "g", 0)
    cyclic = nodes(spark, ("x", "folder", "y", "X", 0), ("y", "folder", "x", "Y", 0))
    assert rows(tree.validate_tree(cyclic), "id", "reason") == [("x", "cycle"), ("y", "cycle")]


def test_split_and_summaries(spark):
    t = spark.createDataFrame([("a", "x" * 24_001), ("b", " ")], "id string, text string")
    assert rows(export.split_text(t), "id", "piece") == [("a", 0), ("a", 1), ("a", 2)]
    assert rows(export.summarize_map_reduce(t, lambda s: f"note{len(s)}"), "id", "summary") == [("a", "note27")]

    def fail(_):
        raise RuntimeError("no model")

    assert rows(export.summarize_map_reduce(t, fail), "id", "summary", "error") == [("a", None, "no model")]


def test_jobs(spark):
    j = spark.createDataFrame([("a", "live", "completed", None), ("b", "live", "failed", "x.wav"), ("c", "file", "transcribing", None)], "id string, kind string, status string, audio_path string")
    done = jobs.reset_for_retry(j, j.select("id"))
    assert rows(done, "id", "kind", "status", "reset") == [("a", "live", "completed", False), ("b", "file", "queued", True), ("c", "file", "transcribing", False)]


def test_durable_prefix(spark):
    b = spark.createDataFrame([("s", "m", q) for q in (0, 2, 1, 1, 4)] + [("t", "m", 1)], "session_id string, track_id string, seq long")
    assert rows(journal.durable_prefix(b), "session_id", "durable", "duplicates") == [("s", 2, 1), ("t", -1, 0)]


def test_cer(spark):
    a = segments(spark, ("t", 0, 0, 1, "Привет, мир", "file"))
    assert rows(quality.cer(a, a.withColumn("text", F.lit("привет мор"))), "distance", "length") == [(1, 9)]


def test_cer_of_whole_transcripts(spark, tmp_path):
    from voxloom.plans import registry

    turns = [(c, k, ("user", "assistant")[k % 2], f"Turn {k}, of {c}: É{'x' * (k + c)}") for c in range(3) for k in range(8)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plain = lambda t: "".join(x for x in t.lower() if x.isalnum())

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    lengths, edits = {}, {}
    for c in range(3):
        mine = sorted([(4000 * k + 100 * (c % 5) + 100 * echo, 2 * k + echo, plain(t)) for x, k, role, t in turns for echo in (0, 1) if x == c and (not echo or (role == "assistant" and (c + k) % 3 == 0))])
        ref = "".join(t for _, _, t in mine)
        hyp = "".join(t for _, i, t in mine if i % 2 == 0)
        lengths[f"c{c}"] = (len(ref) - len(hyp), len(ref))
        edits[f"c{c}"] = (distance(ref, "".join(t for _, i, t in mine if i % 7 != 6)), len(ref))
    assert {r["tid"]: (r["fewer"], r["length"]) for r in registry.QUERIES["e1_cer_whole_lengths"](spark, str(tmp_path)).collect()} == lengths
    got = {r["tid"]: r.asDict() for r in registry.QUERIES["e1_cer"](spark, str(tmp_path)).collect()}
    assert {t: x["cer"] for t, x in got.items()} == pytest.approx({t: a / n for t, (a, n) in edits.items()})


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(40_000) * 0.05)[:, None].repeat(2, axis=1) * 0.5
    (tmp_path / "a.wav").write_bytes(readers.wav_bytes(x, 16_000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    got = readers.read_wav_blocks(spark, str(tmp_path))
    assert rows(got.where("error is null"), "block_start") == [(0,), (16_384,), (32_768,)]
    assert got.where("error is not null").count() == 1
    assert abs(got.where("block_start = 0").head()["samples"][100] - x[100, 0]) < 1e-3
    assert rows(readers.inventory_files(spark, str(tmp_path), "m"), "source_filename", "status") == [("a.wav", "queued"), ("bad.wav", "queued")]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"version":1,"revision":"r","recording":{"id":"x"},"segments":[],"audio":[]}')
    (tmp_path / "m" / "b.json").write_text("{")
    assert rows(readers.read_manifests(spark, str(tmp_path / "m")).fillna({"reason": ""}), "reason") == [("",), ("malformed",)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "tracks.json").write_text('[{"file":"microphone.wav","offset_seconds":-1},{"file":"x-system.wav"},{"file":"mixed.wav"}]')
    assert rows(readers.read_track_offsets(spark, str(tmp_path / "t")), "track", "offset_seconds") == [("microphone", 0.0), ("system", 0.0)]
    log = spark.createDataFrame([("r", "rtf=0.16"), ("r", "noise"), ("r", "load_ms=12")], "run string, value string")
    assert rows(readers.parse_metric_log(log, ["rtf", "load_ms"]), "rtf", "load_ms") == [(0.16, 12.0)]
