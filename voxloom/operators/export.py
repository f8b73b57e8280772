"""Transcripts as text, SRT, WebVTT and JSON, and their summaries. One row a recording."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.columns import format_timestamp_ms

#: Fixed labels of the two tracks.
LABELS = {"microphone": "Микрофон: ", "system": "Система: "}
SPLIT_CHARS, MOST_CHARS = 12_000, 1_000_000


def label_text(segments: DataFrame) -> DataFrame:
    """Adds ``labelled``: the text with its track, if the recording has both a microphone and a system track."""
    w = W.partitionBy("tid")
    both = F.bool_or(F.col("source_track") == "microphone").over(w) & F.bool_or(F.col("source_track") == "system").over(w)
    label = F.when(both & (F.col("source_track") == "microphone"), LABELS["microphone"]).when(both & (F.col("source_track") == "system"), LABELS["system"]).otherwise("")
    return segments.withColumn("labelled", F.concat(label, F.col("text")))


def _document(segments: DataFrame, line: Column, between: str, head: str = "") -> DataFrame:
    rows = label_text(segments).select("tid", F.struct("start_ms", "segment_index", line.alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return rows.groupBy("tid").agg(F.concat(F.lit(head), F.array_join(lines, between)).alias("document"))


def export_txt(segments: DataFrame) -> DataFrame:
    return _document(segments, F.concat(F.lit("["), format_timestamp_ms(F.col("start_ms")), F.lit("] "), F.col("labelled")), "\n")


def export_srt(segments: DataFrame) -> DataFrame:
    times = F.concat(format_timestamp_ms(F.col("start_ms"), ","), F.lit(" --> "), format_timestamp_ms(F.col("end_ms"), ","))
    return _document(segments, F.concat_ws("\n", (F.col("segment_index") + 1).cast("string"), times, "labelled"), "\n\n")


def export_vtt(segments: DataFrame) -> DataFrame:
    times = F.concat(format_timestamp_ms(F.col("start_ms")), F.lit(" --> "), format_timestamp_ms(F.col("end_ms")))
    return _document(segments, F.concat_ws("\n", times, "labelled"), "\n\n", "WEBVTT\n\n")


def export_json(segments: DataFrame) -> DataFrame:
    item = F.struct("start_ms", "segment_index", F.struct("segment_index", "start_ms", "end_ms", "text", "source_track", "speaker_id").alias("s"))
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"])
    return segments.groupBy("tid").agg(F.to_json(items, {"ignoreNullFields": "false"}).alias("document"))


def extractive_summary(segments: DataFrame, n: int = 6) -> DataFrame:
    """(tid, summary, source_ids) from the first ``n`` segments; recordings with an invalid segment are left out."""
    bad = (F.col("end_ms") <= F.col("start_ms")) | (F.col("start_ms") < 0) | F.col("text").isNull() | F.col("start_ms").isNull() | F.col("end_ms").isNull()
    rank = F.row_number().over(W.partitionBy("tid").orderBy("start_ms", "segment_index"))
    rows = segments.withColumn("bad", F.bool_or(bad).over(W.partitionBy("tid"))).withColumn("rank", rank).where((F.col("rank") <= n) & ~F.col("bad"))
    first = rows.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("rank", "segment_index", "text"))).alias("x"))
    return first.select("tid", F.array_join(F.transform("x", lambda s: s["text"]), " ").alias("summary"), F.array_join(F.transform("x", lambda s: F.concat_ws(":", F.col("tid"), s["segment_index"])), ",").alias("source_ids"))


def split_text(texts: DataFrame, n: int = SPLIT_CHARS, most: int = MOST_CHARS) -> DataFrame:
    """(id, piece, text): consecutive pieces of ``n`` characters; blank texts and those over ``most`` are rejected."""
    size = F.char_length("text")
    rows = texts.where((F.trim("text") != "") & (size <= most)).withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / n).cast("int"))))
    return rows.select("id", "piece", F.expr(f"substring(text, piece * {n} + 1, {n})").alias("text"))


def summarize_map_reduce(texts: DataFrame, fn: Callable[[str], str], n: int = SPLIT_CHARS) -> DataFrame:
    """(id, summary, error) with an injected function: pieces first, then the joined notes if they are short, else sections.

    ``fn`` runs on the executors, in batches; what it raises is kept in the row.
    """

    def apply(batches):
        for rows in batches:
            out = [_guarded(fn, t) for t in rows["text"]]
            yield rows.assign(note=[o[0] for o in out], error=[o[1] for o in out])

    pieces = split_text(texts, n)
    noted = pieces.mapInPandas(apply, "id string, piece int, text string, note string, error string")
    joined = noted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", "note"))).alias("notes"), F.count(F.lit(1)).alias("k"), F.max("error").alias("error"))
    notes = F.transform("notes", lambda x: x["note"])
    joined = joined.withColumn("text", F.array_join(notes, "\n\n"))
    done = joined.where((F.col("k") == 1) | F.col("error").isNotNull()).select("id", F.when(F.col("error").isNull(), F.col("text")).alias("summary"), "error")
    sections = F.array_join(F.transform("notes", lambda x: F.concat(F.lit("## Часть "), (x["piece"] + 1).cast("string"), F.lit("\n"), x["note"])), "\n\n")
    many = joined.where((F.col("k") > 1) & F.col("error").isNull())
    long = many.where(F.char_length("text") > n).select("id", sections.alias("summary"), "error")
    short = many.where(F.char_length("text") <= n).select("id", F.lit(0).alias("piece"), "text").mapInPandas(apply, "id string, piece int, text string, note string, error string")
    return done.unionByName(long).unionByName(short.select("id", F.col("note").alias("summary"), "error"))


def _guarded(fn: Callable[[str], str], text: str) -> tuple[str | None, str | None]:
    try:
        return fn(text), None
    except Exception as e:  # noqa: BLE001  any error of the injected function belongs in its row
        return None, str(e) or type(e).__name__
