"""Segments: numbering, ordering, merging tracks, echo removal, joining and grouping.

Segments have tid, segment_index, start_ms, end_ms, text, source_track and speaker_id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import columns as C

ECHO_MS = 750
GAP_MS, JOIN_BYTES = 1000, 8192
GROUP_GAP_MS, GROUP_CHARS = 2000, 240


def order_segments(segments: DataFrame) -> DataFrame:
    """Adds ``position``, the place of a segment by start, then by index."""
    return segments.withColumn("position", F.row_number().over(W.partitionBy("tid").orderBy("start_ms", "segment_index")))


def make_segments(phrases: DataFrame) -> DataFrame:
    """(tid, segment_index, id, start_ms, end_ms, text, ok) from phrases (tid, chunk_start_ms, phrase_start_ms, phrase_end_ms, text).

    Accepted phrases are numbered within a recording by chunk, then place in it; rejected ones (times
    that are null, negative or out of order, blank tid) have no index and no id.
    """
    start, end = F.col("chunk_start_ms") + F.col("phrase_start_ms"), F.col("chunk_start_ms") + F.col("phrase_end_ms")
    rows = phrases.withColumn("start_ms", start).withColumn("end_ms", end)
    ok = F.coalesce((F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms")) & (F.trim("tid") != ""), F.lit(False))
    rows = rows.withColumn("ok", ok)
    place = F.row_number().over(W.partitionBy("tid", "ok").orderBy("chunk_start_ms", "phrase_start_ms", "phrase_end_ms", "text")) - 1
    index = F.when(F.col("ok"), place)
    rows = rows.withColumn("segment_index", index)
    return rows.select("tid", "segment_index", F.when(F.col("ok"), F.concat_ws(":", "tid", "segment_index")).alias("id"), "start_ms", "end_ms", "text", "ok")


def echo_segments(segments: DataFrame, tolerance_ms: int = ECHO_MS) -> DataFrame:
    """(tid, segment_index) of microphone segments that repeat what the system track says.

    System segments are posted in buckets of time, so the interval join is an equi-join however long
    a recording is. A microphone segment is dropped if one candidate matches or if all candidates
    together, in order, do.
    """
    width = 8 * tolerance_ms
    words = segments.withColumn("words", C.normalized_words(F.col("text")))
    mic = words.where("source_track = 'microphone'").select("tid", F.col("segment_index").alias("m"), F.col("start_ms").alias("ms"), F.col("end_ms").alias("me"), F.col("words").alias("mw"))
    mic = mic.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("ms") / width), F.floor(F.greatest("ms", "me") / width))))
    system = words.where("source_track = 'system'").select("tid", F.col("segment_index").alias("s"), F.col("start_ms").alias("ss"), F.col("end_ms").alias("se"), F.col("words").alias("sw"))
    low, high = F.floor((F.col("ss") - tolerance_ms) / width), F.floor((F.greatest("ss", "se") + tolerance_ms) / width)
    system = system.withColumn("bucket", F.explode(F.sequence(low, high)))
    near = (F.col("ss") <= F.col("me") + tolerance_ms) & (F.col("se") >= F.col("ms") - tolerance_ms)
    # A pair may meet in several buckets; only the first one counts.
    once = F.col("bucket") == F.greatest(F.floor(F.col("ms") / width), low)
    pairs = mic.join(system, ["tid", "bucket"]).where(near & once)
    heard = pairs.groupBy("tid", "m").agg(
        F.max(C.echo_words_match(F.col("mw"), F.col("sw"))).alias("one"), F.first("mw").alias("mw"), F.count(F.lit(1)).alias("n"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ss", "s", "sw"))), lambda x: x["sw"])).alias("all"),
    )
    # One candidate alone has been compared.
    together = (F.col("n") > 1) & C.echo_words_match(F.col("mw"), F.col("all"))
    return heard.where(F.col("one") | together).select("tid", F.col("m").alias("segment_index"))


def suppress_microphone_echo(segments: DataFrame, tolerance_ms: int = ECHO_MS) -> DataFrame:
    return segments.join(echo_segments(segments, tolerance_ms), ["tid", "segment_index"], "left_anti")


def merge_tracks(segments: DataFrame, tracks: DataFrame) -> DataFrame:
    """Segments of all tracks (tid, track_order, segment_index, ...) with times moved by (tid, track_order, track, offset_ms)."""
    at = segments.join(tracks, ["tid", "track_order"])
    index = F.row_number().over(W.partitionBy("tid").orderBy("track_order", "segment_index")) - 1
    return at.select("tid", index.cast("long").alias("segment_index"), (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("offset_ms")).alias("end_ms"), "text", F.col("track").alias("source_track"))


def join_phrases(segments: DataFrame, gap_ms: int = GAP_MS, most_bytes: int = JOIN_BYTES) -> DataFrame:
    """Phrases of one sentence made one segment: same track and speaker, a small gap, no sentence end before.

    Islands between hard breaks are found by windows; only those of more than ``most_bytes`` are cut by a fold.
    """
    w = W.partitionBy("tid").orderBy("segment_index")
    before = lambda c: F.lag(c).over(w)
    gap = F.col("start_ms") - before("end_ms")
    joins = ~C.ends_sentence(before("text")) & (before("source_track") == F.col("source_track")) & before("speaker_id").eqNullSafe(F.col("speaker_id")) & gap.between(0, gap_ms)
    rows = segments.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).drop("new")
    # No longer than this when joined: each join adds a blank at most.
    size = F.sum(F.octet_length("text") + 1).over(W.partitionBy("tid", "island"))
    rows = rows.withColumn("size", size)
    short = rows.where(F.col("size") <= most_bytes).withColumn("piece", F.lit(0))
    cut = rows.where(F.col("size") > most_bytes).groupBy("tid", "island").applyInPandas(lambda p: _cut(p, most_bytes), rows.withColumn("piece", F.lit(0)).schema)
    parts = F.sort_array(F.collect_list(F.struct("segment_index", "text")))
    joined = lambda acc, x: F.concat(C.trimmed_end(acc), F.lit(" "), C.trimmed_start(x["text"]))
    text = F.aggregate(parts, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x["text"]).otherwise(joined(acc, x)))
    return short.unionByName(cut).groupBy("tid", "island", "piece").agg(
        F.min("segment_index").alias("segment_index"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "segment_index").alias("end_ms"), text.alias("text"), F.first("source_track").alias("source_track"), F.first("speaker_id").alias("speaker_id")
    ).drop("island", "piece")


def _cut(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Adds ``piece``: a phrase joins while the joined text so far and it have at most ``most`` bytes."""
    rows = rows.sort_values("segment_index")
    size = lambda t: len(t.encode("utf-8"))
    piece, total, tail, out = -1, 0, 0, []
    for text in rows["text"].fillna(""):
        if piece >= 0 and total + size(text) <= most:
            # What is blank at the end of the joined text goes, a blank and the trimmed phrase come.
            kept = total - tail + 1
            body = text.lstrip()
            total = kept + size(body)
            tail = size(body) - size(body.rstrip()) if body.strip() else 1 + size(body)
        else:
            piece, total, tail = piece + 1, size(text), size(text) - size(text.rstrip())
        out.append(piece)
    return rows.assign(piece=out)


def group_sentences(segments: DataFrame, gap_ms: int = GROUP_GAP_MS, chars: int = GROUP_CHARS) -> DataFrame:
    """Groups of segments for reading: (tid, group_id, first_index, n, text).

    A new group begins on a change of track or speaker, after a gap, or at a sentence end once the
    group is long. Blank segments are left out. Hard breaks come from a window; the length rule is a
    fold over each run between them.
    """
    w = W.partitionBy("tid").orderBy("segment_index")
    rows = segments.withColumn("text", C.trimmed_start(C.trimmed_end(F.col("text")))).where("text <> ''")
    before = lambda c: F.lag(c).over(w)
    gap = F.coalesce(F.col("start_ms") - before("end_ms"), F.lit(0))
    same = (before("source_track") == F.col("source_track")) & before("speaker_id").eqNullSafe(F.col("speaker_id")) & (gap <= gap_ms)
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    item = F.struct("segment_index", "text", (C.utf16_length(F.col("text")) + 1).alias("n"), F.col("text").rlike(r"""[.!?…][»”"')\]]*$""").alias("ended"))
    runs = rows.groupBy("tid", "run").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("total"), F.lit(False).alias("ended"), F.array().cast("array<int>").alias("ids"))

    def step(acc, x):
        new = (acc["total"] >= chars) & acc["ended"]
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(g.alias("g"), F.when(new, x["n"]).otherwise(acc["total"] + x["n"]).alias("total"), x["ended"].alias("ended"), F.concat(acc["ids"], F.array(g)).alias("ids"))

    folded = runs.withColumn("ids", F.aggregate("items", start, step, lambda acc: acc["ids"]))
    flat = folded.select("tid", "run", F.explode(F.arrays_zip("items", "ids")).alias("x"))
    grouped = flat.groupBy("tid", "run", F.col("x.ids").alias("g")).agg(F.min("x.items.segment_index").alias("first_index"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("x.items.segment_index", "x.items.text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    group_id = F.row_number().over(W.partitionBy("tid").orderBy("first_index"))
    return grouped.select("tid", group_id.alias("group_id"), "first_index", "n", text.alias("text"))


def timeline_check(segments: DataFrame, durations: DataFrame, tolerance_ms: int = 0) -> DataFrame:
    """(tid, ok): segments follow one another, are not empty, and end within the duration."""
    w = W.partitionBy("tid").orderBy("segment_index")
    rows = segments.join(durations, "tid")
    ok = (F.coalesce(F.lag("end_ms").over(w), F.lit(0)) <= F.col("start_ms")) & (F.col("end_ms") > F.col("start_ms")) & (F.col("start_ms") >= 0) & (F.col("end_ms") <= F.col("duration_ms") + tolerance_ms)
    return rows.withColumn("fine", ok).groupBy("tid").agg(F.bool_and("fine").alias("ok"))


def with_speaker_labels(segments: DataFrame) -> DataFrame:
    return segments.withColumn("label", C.speaker_label(F.col("speaker_id"), F.col("source_track"))).withColumn("speaker_key", C.speaker_key(F.col("speaker_id"), F.col("source_track")))


def duration_by_recording(segments: DataFrame) -> DataFrame:
    return segments.groupBy("tid").agg(F.max("end_ms").alias("duration_ms"))


def validate_events(events: DataFrame) -> DataFrame:
    """Adds ``reason``, null for a valid segment event; the first broken rule names it."""
    reason = (
        F.when(~F.col("version").eqNullSafe(F.lit(1)), "version").when(F.coalesce(F.trim("session_id"), F.lit("")) == "", "session")
        .when(F.coalesce(F.trim("segment_id"), F.lit("")) == "", "segment").when(F.coalesce(F.trim("idempotency_key"), F.lit("")) == "", "key")
        .when(F.coalesce(F.col("seq"), F.lit(-1)) < 0, "seq").when(F.coalesce(F.col("revision"), F.lit(-1)) < 0, "revision")
        .when(F.isnan("start_seconds") | F.isnan("end_seconds") | (F.col("start_seconds") < 0) | (F.col("end_seconds") <= F.col("start_seconds")) | F.col("start_seconds").isNull() | F.col("end_seconds").isNull(), "time")
    )
    return events.withColumn("reason", reason)
