"""Whole jobs on small inputs."""

from voxloom.operators import workflows

CHANGES = "tid string, track_order int, segment_index int, revision int, arrival int, deleted boolean, start_ms long, end_ms long, text string"
TRACKS = "tid string, track_order int, track string, offset_ms long"


def test_live_sessions(spark):
    changes = spark.createDataFrame([
        ("a", 0, 0, 2, 1, False, 0, 900, "Hello there."), ("a", 0, 0, 1, 5, False, 0, 900, "hello"),  # the draft comes late
        ("a", 0, 1, 1, 2, False, 2000, 2900, "we repeat what you say"), ("a", 1, 0, 1, 3, False, 1900, 2800, "We repeat what you say."),  # an echo
        ("a", 1, 1, 1, 4, False, 9000, 9900, "gone"), ("a", 1, 1, 2, 6, True, 9000, 9900, ""),
        ("b", 2, 0, 1, 1, False, 0, 500, "alone"),
    ], CHANGES)
    tracks = spark.createDataFrame([("a", 0, "microphone", 0), ("a", 1, "system", 100), ("b", 2, "file", 0)], TRACKS)
    merged = sorted((r.tid, r.segment_index, r.start_ms, r.text) for r in workflows.merged_sessions(changes, tracks).collect())
    assert merged == [("a", 0, 0, "Hello there."), ("a", 1, 2000, "we repeat what you say"), ("a", 2, 2000, "We repeat what you say."), ("b", 0, 0, "alone")]
    got = {r.tid: (r.document.split("\n"), r.passages) for r in workflows.live_sessions(changes, tracks).collect()}
    assert len(got["a"][0]) == 2 and got["a"][0][1].endswith("We repeat what you say.") and got["a"][1] == ["Hello there.", "We repeat what you say."]
    assert got["b"][1] == ["alone"]
    assert workflows.live_sessions(changes.limit(0), tracks).count() == 0


def test_labelled_recordings(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    vectors = spark.createDataFrame([(t, i, i // 2, v) for t in ("a", "b") for i, v in enumerate([x, x, y, y, x, x])], "tid string, window_id long, segment_index int, embedding array<double>")
    segments = spark.createDataFrame([(t, i, f"s{i}", i * 10, i * 10 + 9, "old") for t in ("a", "b", "c") for i in range(4)], "tid string, segment_index int, text string, start_ms long, end_ms long, speaker_id string")
    jobs = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "completed")], "id string, status string")
    got = {(r.tid, r.segment_index): (r.speaker_id, r.applied) for r in workflows.labelled_recordings(jobs, segments, vectors).collect()}
    assert [got["a", i] for i in range(4)] == [("Speaker 1", True), ("Speaker 2", True), ("Speaker 1", True), ("old", False)]
    assert all(got[t, i] == ("old", False) for t in ("b", "c") for i in range(4))


def test_snapshot_catalogue(spark):
    remote = spark.createDataFrame([
        ("f1", "o", "r1", None, None, None, "m"), ("f2", "o", "r2", "r1", None, None, "m"), ("f3", "o", "r3", "r1", None, None, "m"),
        ("f4", "loop", "p", "q", None, None, "m"), ("f5", "loop", "q", "p", None, None, "m"), ("f6", "blank", " ", None, None, None, "m"),
        ("f7", "two", "r", None, None, None, "m"), ("f8", "two", "r", None, None, None, "n"),
    ], "remote_id string, original_id string, revision string, parent_revision string, merge_a string, merge_b string, manifest string")
    local = spark.createDataFrame([("l", "o", "r2")], "id string, original_id string, revision string")
    none = spark.createDataFrame([], "remote_id string, id string")
    got = {r.remote_id: (r.is_head, r.concurrent, r.known, r.restore) for r in workflows.snapshot_catalogue(remote, local, none).collect()}
    assert got == {"f1": (False, False, False, False), "f2": (True, True, True, False), "f3": (True, True, False, True)}
