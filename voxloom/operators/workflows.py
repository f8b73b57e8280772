"""Whole jobs made of the other operators: live sessions, speaker labels, the catalogue of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import export, journal, snapshots, speakers, transcript


def merged_sessions(changes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Segments of all tracks of each session on one timeline, as they are after their last revision.

    ``changes`` is (tid, track_order, segment_index, revision, arrival, deleted, start_ms, end_ms, text) in any
    order, ``tracks`` (tid, track_order, track, offset_ms). Deleted segments have no place.
    """
    now = journal.upsert_segments(changes, ("tid", "track_order", "segment_index")).where("not deleted")
    return transcript.merge_tracks(now, tracks).withColumn("speaker_id", F.lit(None).cast("string"))


def live_sessions(changes: DataFrame, tracks: DataFrame, document=export.export_txt) -> DataFrame:
    """(tid, document, passages) of each session, without echo; stored segments keep theirs.

    ``document`` is one of the exports; passages are the groups of sentences in order.
    """
    shown = transcript.suppress_microphone_echo(merged_sessions(changes, tracks))
    groups = transcript.group_sentences(shown).groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("group_id", "text"))).alias("g"))
    return document(shown).join(groups.select("tid", F.transform("g", lambda g: g["text"]).alias("passages")), "tid", "left")


def labelled_recordings(jobs: DataFrame, segments: DataFrame, vectors: DataFrame, method: str = "auto", k: int = 2) -> DataFrame:
    """Segments with the speaker that most of their windows have, and ``applied``, for completed recordings.

    ``vectors`` is (tid, window_id, segment_index, embedding). A recording whose segments are no longer as they
    were is left as it is, and so are those that aren't completed or have no clusters.
    """
    done = jobs.where("status = 'completed'").select(F.col("id").alias("tid"))
    chosen = vectors.join(done, "tid", "left_semi")
    found = speakers.cluster(chosen, method, k).where("speaker is not null").select("tid", "window_id", F.col("speaker").alias("label"))
    votes = chosen.select("tid", "window_id", "segment_index").join(found, ["tid", "window_id"])
    won = speakers.dominant_speaker(votes).select("tid", "segment_index", F.col("speaker").alias("new_speaker"))
    before = segments.select("tid", "segment_index", "text", "start_ms", "end_ms", F.col("speaker_id").alias("old_speaker"))
    return journal.set_speakers_if_unchanged(segments, before.join(won, ["tid", "segment_index"]))


def snapshot_catalogue(remote: DataFrame, local: DataFrame, restored: DataFrame) -> DataFrame:
    """(remote_id, original_id, revision, is_head, concurrent, known, restore) of the snapshots of sound histories.

    ``remote`` is (remote_id, original_id, revision, parent_revision, merge_a, merge_b, manifest), ``local`` (id,
    original_id, revision), ``restored`` (remote_id, id). Originals with a blank revision, a revision of two contents
    or a cycle are left out; heads that no local recording holds are to be restored.
    """
    bad = snapshots.validate_revision_graph(remote).select("original_id").distinct()
    sound = remote.join(bad, "original_id", "left_anti")
    known = snapshots.match_local_snapshots(sound, local, restored).select("remote_id").distinct().withColumn("known", F.lit(True))
    rows = sound.select("remote_id", "original_id", "revision").join(snapshots.snapshot_branches(sound), ["original_id", "revision"]).join(known, "remote_id", "left")
    rows = rows.withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.select("remote_id", "original_id", "revision", "is_head", "concurrent", "known", (F.col("is_head") & ~F.col("known")).alias("restore"))
