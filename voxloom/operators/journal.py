"""Revisioned segments, the sync journal, conditional edits and archive integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIRE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20


def journal_entries(changes: DataFrame, key: tuple[str, ...] = ("session_id", "change_id")) -> DataFrame:
    """The changes that were applied: those with a revision above all that arrived before for their key.

    A hot session is spread, as the change id is in the key.
    """
    before = F.max("revision").over(W.partitionBy(*key).orderBy("arrival").rowsBetween(W.unboundedPreceding, -1))
    return changes.withColumn("before", before).where(F.col("before").isNull() | (F.col("revision") > F.col("before"))).drop("before")


def upsert_segments(changes: DataFrame, key: tuple[str, ...] = ("session_id", "change_id")) -> DataFrame:
    """The latest state by key: the highest revision, the first to arrive of equals. Partial aggregates, no sort."""
    rest = [c for c in changes.columns if c not in key]
    best = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col("revision"), -F.col("arrival"))).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def changes_since(changes: DataFrame, cursors: DataFrame) -> DataFrame:
    """Changes above the cursor (session_id, cursor); sessions without one get all."""
    return changes.join(cursors, "session_id", "left").where(F.col("revision") > F.coalesce("cursor", F.lit(-1))).drop("cursor")


def sync_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Last writer by revision of each change; of equal revisions the local one. Tombstones are changes like others."""
    rows = local.withColumn("side", F.lit(1)).unionByName(remote.withColumn("side", F.lit(0)))
    rest = [c for c in local.columns if c not in ("session_id", "change_id")]
    best = rows.groupBy("session_id", "change_id").agg(F.max_by(F.struct(*rest), F.struct("revision", "side", -F.col("arrival"))).alias("x"))
    return best.select("session_id", "change_id", *[F.col(f"x.{c}").alias(c) for c in rest])


def journal_cursor(changes: DataFrame) -> DataFrame:
    """Applied changes with their running number within the session, the cursor of a pull."""
    entries = journal_entries(changes)
    return entries.withColumn("cursor", F.row_number().over(W.partitionBy("session_id").orderBy("arrival")))


def conditional_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (tid, segment_index, expected, new_text) apply where the text still is the expected one; ``applied`` says so.

    Of several edits of a segment whose expectation holds, the smallest new text counts.
    """
    now = rows.select("tid", "segment_index", F.col("text").alias("now"))
    holds = edits.where("new_text is not null").join(now, ["tid", "segment_index"]).where(F.col("now").eqNullSafe(F.col("expected")))
    one = holds.groupBy("tid", "segment_index").agg(F.min_by(F.struct("expected", "new_text"), "new_text").alias("e"))
    out = rows.join(one.select("tid", "segment_index", "e.*"), ["tid", "segment_index"], "left")
    go = F.coalesce(F.col("new_text").isNotNull() & F.col("text").eqNullSafe(F.col("expected")), F.lit(False))
    return out.withColumn("applied", go).withColumn("text", F.when(go, F.col("new_text")).otherwise(F.col("text"))).drop("expected", "new_text")


def group_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """All or nothing by request (request, tid, segment_index, expected, new_text): the first segment takes the text, the others none.

    Of several requests that hold for a segment, the smallest one counts.
    """
    met = edits.join(rows.select("tid", "segment_index", F.col("text").alias("now")), ["tid", "segment_index"], "left")
    ok = met.groupBy("request").agg(F.bool_and(F.col("now").isNotNull() & (F.col("now") == F.col("expected"))).alias("ok"), F.min("segment_index").alias("first"))
    put = F.when(F.col("segment_index") == F.col("first"), F.col("new_text")).otherwise("")
    go = edits.join(ok.where("ok"), "request").groupBy("tid", "segment_index").agg(F.min_by(put, F.struct("request", "new_text")).alias("put"))
    return rows.join(go, ["tid", "segment_index"], "left").withColumn("applied", F.col("put").isNotNull()).withColumn("text", F.coalesce("put", "text")).drop("put")


def set_speakers_if_unchanged(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """All or nothing by recording: (tid, segment_index, text, start_ms, end_ms, old_speaker, new_speaker) must all still hold."""
    now = rows.select("tid", "segment_index", F.col("text").alias("t"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("speaker_id").alias("sp"))
    met = wanted.join(now, ["tid", "segment_index"], "left")
    same = F.col("t").eqNullSafe(F.col("text")) & F.col("s").eqNullSafe(F.col("start_ms")) & F.col("e").eqNullSafe(F.col("end_ms")) & F.col("sp").eqNullSafe(F.col("old_speaker"))
    ok = met.groupBy("tid").agg(F.bool_and(same).alias("ok")).where("ok").select("tid")
    go = wanted.join(ok, "tid", "left_semi").groupBy("tid", "segment_index").agg(F.min("new_speaker").alias("new_speaker"), F.lit(True).alias("applied"))
    out = rows.join(go, ["tid", "segment_index"], "left")
    return out.withColumn("speaker_id", F.when(F.col("applied"), F.col("new_speaker")).otherwise(F.col("speaker_id"))).withColumn("applied", F.coalesce("applied", F.lit(False))).drop("new_speaker")


def rename_speaker(rows: DataFrame, tid: str, track: str, old: str | None, new: str | None) -> DataFrame:
    hit = (F.col("tid") == tid) & (F.col("source_track") == track) & F.col("speaker_id").eqNullSafe(F.lit(old))
    return rows.withColumn("speaker_id", F.when(hit, F.lit(new)).otherwise(F.col("speaker_id")))


def verify_checksums(blocks: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``valid`` to blocks (payload binary, sha256): the digest and the size limit hold."""
    return blocks.withColumn("valid", F.coalesce((F.sha2("payload", 256) == F.lower("sha256")) & (F.octet_length("payload") <= most), F.lit(False)))


def durable_prefix(blocks: DataFrame) -> DataFrame:
    """(session_id, track_id, durable, stored, duplicates): the last block before the first gap, whatever the arrival order; -1 without one."""
    once = blocks.groupBy("session_id", "track_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("session_id", "track_id").orderBy("seq")) - 1
    rows = once.withColumn("in_order", F.col("seq") == place)
    return rows.groupBy("session_id", "track_id").agg(F.coalesce(F.max(F.when(F.col("in_order"), F.col("seq"))), F.lit(-1)).cast("long").alias("durable"), F.count(F.lit(1)).alias("stored"), F.sum(F.col("n") - 1).alias("duplicates"))


def pending_replay(blocks: DataFrame, cursors: DataFrame) -> DataFrame:
    """Blocks after the durable cursor (session_id, track_id, durable), with their place in the replay."""
    rows = blocks.join(cursors.select("session_id", "track_id", "durable"), ["session_id", "track_id"], "left").where(F.col("seq") > F.coalesce("durable", F.lit(-1))).drop("durable")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("track_id", "seq")))


def archive_ranges(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Blocks (session_id, track_id, seq, bytes) with their byte offset and whether the range is valid in its file (file_bytes)."""
    w = W.partitionBy("session_id", "track_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = blocks.withColumn("offset", F.coalesce(F.sum("bytes").over(w), F.lit(0)).cast("long"))
    ok = F.col("bytes").between(1, BLOCK_BYTES)
    if files is None:
        return rows.withColumn("valid", ok)
    rows = rows.join(files.select("session_id", "track_id", "file_bytes"), ["session_id", "track_id"], "left")
    return rows.withColumn("valid", ok & (F.col("offset") + F.col("bytes") <= F.col("file_bytes")))


def finalize_archive(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(session_id, tracks, bytes, duration): sums of the committed blocks (bytes, n); the duration is the longest track's.

    With the track files (session_id, track_id, content), ``ok`` tells whether every file's size is
    what its blocks sum to, and content_hash is the digest of the only hashed file, else empty.
    """
    tracks = blocks.groupBy("session_id", "track_id").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    sums = [F.count(F.lit(1)).alias("tracks"), F.sum("bytes").alias("bytes"), F.max("n").alias("duration")]
    if files is not None:
        sizes = files.select("session_id", "track_id", F.octet_length("content").alias("size"))
        tracks = tracks.join(sizes, ["session_id", "track_id"], "left").join(content_hashes(files), ["session_id", "track_id"], "left")
        sums.append(F.bool_and(F.coalesce(F.col("size") == F.col("bytes"), F.lit(False))).alias("ok"))
        sums.append(F.when(F.count("sha256") == 1, F.max("sha256")).otherwise("").alias("content_hash"))
    return tracks.groupBy("session_id").agg(*sums)


def content_hashes(files: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(session_id, track_id, sha256) of whole track files (content binary) up to ``most`` bytes; larger ones have none."""
    return files.select("session_id", "track_id", F.when(F.octet_length("content") <= most, F.sha2("content", 256)).alias("sha256"))
