"""Sources and sinks: media files, raw audio, tables with rules, manifests, offsets, metric logs, documents."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators import export
from voxloom.operators.jobs import ACTIVE, TERMINAL
from voxloom.sources.stored import removed, saved

MEDIA = ("wav", "mp3", "flac", "ogg", "opus", "webm", "m4a", "mp4", "aac")
BLOCK = 16_384

SEGMENTS = "id string, transcription_id string, segment_index long, start_seconds double, end_seconds double, text string, source_track string, speaker_id string, state string"
TRANSCRIPTIONS = (
    "id string, kind string, source_filename string, source_path string, source_size_bytes long, source_modified_ms long, created_ms long, started_ms long, completed_ms long, status string, "
    "duration_seconds double, model_version string, error string, audio_path string, completed_chunks long, total_chunks long, queue_visible boolean, start_requested boolean, cancel_requested boolean"
)
MANIFEST = (
    "version int, revision string, original_recording_id string, device_id string, parent_revision string, merge_parents array<string>, recording struct<id:string,source_filename:string,status:string,duration_seconds:double>, "
    "segments array<struct<segment_index:long,start_seconds:double,end_seconds:double,text:string,source_track:string,speaker_id:string>>, tracks array<struct<file:string,offset_seconds:double>>, "
    "audio array<struct<original_filename:string,sha256:string,bytes:long,file_id:string>>, local_folder_mappings map<string,string>, _corrupt string"
)


def inventory_files(spark: SparkSession, path: str, model_version: str) -> DataFrame:
    """One queued job per media file; contents aren't read."""
    return media_jobs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime"), model_version)


def media_jobs(files: DataFrame, model_version: str) -> DataFrame:
    """The jobs of files (path, length, modificationTime) with a media extension."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*MEDIA))
    return rows.select(F.sha2(F.col("path").cast("binary"), 256).alias("id"), F.lit("file").alias("kind"), name.alias("source_filename"), F.col("path").alias("source_path"), F.col("length").alias("source_size_bytes"), F.unix_millis("modificationTime").alias("source_modified_ms"), F.lit("queued").alias("status"), F.lit(model_version).alias("model_version"))


@dataclass(frozen=True)
class Wav:
    """What a WAV file's header says; ``data`` and ``size`` are the place of its samples in bytes, in whole frames."""

    kind: int
    channels: int
    rate: int
    bits: int
    data: int
    size: int

    @property
    def frame(self) -> int:
        return self.bits // 8 * self.channels


def wav_header(read: Callable[[int, int], bytes], length: int) -> Wav:
    """The header of a file of ``length`` bytes by ``read(offset, size)``; ValueError if it isn't PCM or 32-bit float."""
    at, fmt, data = 12, None, None
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= length:
        chunk = read(at, 8)
        size = int.from_bytes(chunk[4:8], "little")
        if chunk[:4] == b"fmt ":
            fmt = read(at + 8, min(size, 64))
        elif chunk[:4] == b"data":
            data = at + 8, min(size, length - at - 8)
        at += 8 + size + size % 2
    if fmt is None or data is None or len(fmt) < 16:
        raise ValueError("no format or data chunk")
    kind, channels, rate, bits = (int.from_bytes(fmt[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
    kind = int.from_bytes(fmt[24:26], "little") if kind == 0xFFFE and len(fmt) >= 26 else kind
    width = bits // 8
    if channels == 0 or rate == 0 or width == 0:
        raise ValueError("no channels or rate")
    if not (kind == 3 and bits == 32) and not (kind == 1 and bits in (8, 16, 24, 32)):
        raise ValueError(f"format {kind} with {bits} bits")
    return Wav(kind, channels, rate, bits, data[0], data[1] // (width * channels) * width * channels)


def wav_values(data: bytes, wav: Wav) -> np.ndarray:
    """[frames, channels] floats of whole frames; ValueError if one isn't finite."""
    width = wav.bits // 8
    if wav.kind == 3:
        x = np.frombuffer(data, "<f4").astype(np.float32)
        if not np.isfinite(x).all():
            raise ValueError("sample is not finite")
        x = np.clip(x, -1, 1)
    else:
        raw = np.frombuffer(data, np.uint8).reshape(-1, width)
        if wav.bits == 8:
            x = (raw[:, 0].astype(np.float32) - 128) / 128
        else:
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, 4 - width :] = raw
            x = ((wide.view("<i4")[:, 0] >> (32 - wav.bits)) / float(1 << (wav.bits - 1))).astype(np.float32)
    return x.reshape(-1, wav.channels)


def wav_samples(content: bytes) -> tuple[np.ndarray, int]:
    """[frames, channels] floats and the rate of a PCM or 32-bit float WAV file; ValueError if it isn't one."""
    wav = wav_header(lambda at, size: content[at : at + size], len(content))
    return wav_values(content[wav.data : wav.data + wav.size], wav), wav.rate


def read_wav_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(path, rate, block_start, duration, samples, error): mono blocks of each file; a bad file is one row with its error."""
    return wav_blocks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content"), block)


def wav_blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of WAV files (path, content), as ``read_wav_blocks``."""

    def run(batches):
        for p in batches:
            for name, content in zip(p["path"], p["content"]):
                try:
                    x, rate = wav_samples(bytes(content))
                except (ValueError, wave.Error) as e:
                    yield pd.DataFrame({"path": [name], "rate": [None], "block_start": [None], "duration": [None], "samples": [None], "error": [str(e)]})
                    continue
                mono = x.mean(axis=1)
                starts = list(range(0, len(mono), block)) or [0]
                for k in range(0, len(starts), 64):
                    part = starts[k : k + 64]
                    yield pd.DataFrame({"path": name, "rate": rate, "block_start": part, "duration": len(mono) / rate, "samples": [mono[s : s + block] for s in part], "error": None})

    return files.mapInPandas(run, "path string, rate int, block_start long, duration double, samples array<float>, error string")


def read_raw_f32(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(path, block_start, samples) of little-endian f32 archives."""
    return raw_blocks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), block)


def raw_blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of archives (path, content), as ``read_raw_f32``."""

    def run(batches):
        for p in batches:
            for name, content in zip(p["path"], p["content"]):
                x = np.frombuffer(content, "<f4", len(content) // 4)
                for s in range(0, len(x), block):
                    yield pd.DataFrame({"path": [name], "block_start": [s], "samples": [x[s : s + block]]})

    return files.mapInPandas(run, "path string, block_start long, samples array<float>")


def checked_segments(rows: DataFrame) -> DataFrame:
    """Adds ``violation``, null for rows that keep the table's rules (checks and the unique key)."""
    from pyspark.sql import Window as W

    copies = F.count(F.lit(1)).over(W.partitionBy("transcription_id", "segment_index"))
    v = (
        F.when(F.col("transcription_id").isNull() | F.col("text").isNull(), "null").when(F.col("segment_index").isNull() | (F.col("segment_index") < 0), "index")
        .when(F.col("start_seconds").isNull() | F.isnan("start_seconds") | (F.col("start_seconds") < 0), "start").when(F.col("end_seconds").isNull() | F.isnan("end_seconds") | (F.col("end_seconds") <= F.col("start_seconds")), "end")
        .when(~F.coalesce("source_track", F.lit("")).isin("file", "microphone", "system"), "track").when(~F.coalesce("state", F.lit("")).isin("provisional", "final"), "state").when(copies > 1, "unique")
    )
    return rows.withColumn("violation", v)


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations) of a Parquet table of segments."""
    rows = checked_segments(spark.read.schema(SEGMENTS).parquet(path))
    return rows.where("violation is null").drop("violation"), rows.where("violation is not null")


def write_segments(rows: DataFrame, path: str) -> None:
    checked_segments(rows).where("violation is null").drop("violation").write.mode("overwrite").parquet(path)


def checked_transcriptions(rows: DataFrame) -> DataFrame:
    """Adds ``violation``, null for recordings that keep the table's rules (closed sets, counts, the unique id)."""
    from pyspark.sql import Window as W

    copies = F.count(F.lit(1)).over(W.partitionBy("id"))
    missing = F.lit(False)
    for c in ("id", "source_filename", "source_path", "created_ms", "model_version"):
        missing = missing | F.col(c).isNull()
    v = (
        F.when(missing, "null").when(~F.coalesce("kind", F.lit("")).isin("file", "live"), "kind")
        .when(~F.coalesce("status", F.lit("")).isin("queued", *ACTIVE, *TERMINAL), "status")
        .when(F.coalesce("source_size_bytes", F.lit(-1)) < 0, "size").when((F.col("duration_seconds") < 0) | F.isnan("duration_seconds"), "duration")
        .when((F.col("completed_chunks") < 0) | (F.col("total_chunks") < 0), "chunks").when(copies > 1, "unique")
    )
    return rows.withColumn("violation", v)


def read_transcriptions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violations) of a Parquet table of recordings."""
    rows = checked_transcriptions(spark.read.schema(TRANSCRIPTIONS).parquet(path))
    return rows.where("violation is null").drop("violation"), rows.where("violation is not null")


def write_transcriptions(rows: DataFrame, path: str) -> None:
    checked_transcriptions(rows).where("violation is null").drop("violation").write.mode("overwrite").parquet(path)


def timed(segments: DataFrame) -> DataFrame:
    """Segments of the table above in the columns that the operators use: tid, segment_index, start_ms, end_ms, ..."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return segments.select(F.col("transcription_id").alias("tid"), "segment_index", ms("start_seconds").alias("start_ms"), ms("end_seconds").alias("end_ms"), "text", "source_track", "speaker_id")


def stored_segments(segments: DataFrame, state: str = "final") -> DataFrame:
    """The operators' segments (tid, segment_index, start_ms, end_ms, text, ...) in the columns of the table."""
    has = lambda c, other: F.col(c) if c in segments.columns else other
    return segments.select(
        F.concat_ws(":", "tid", "segment_index").alias("id"), F.col("tid").alias("transcription_id"), F.col("segment_index").cast("long").alias("segment_index"),
        (F.col("start_ms") / 1000).alias("start_seconds"), (F.col("end_ms") / 1000).alias("end_seconds"), "text",
        has("source_track", F.lit("file")).alias("source_track"), has("speaker_id", F.lit(None).cast("string")).alias("speaker_id"), F.lit(state).alias("state"),
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, one a file; those that don't parse have ``reason`` set."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    m = text.select("value", F.from_json("value", T.StructType.fromDDL(MANIFEST), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    return m.select("m.*", F.when(F.col("m._corrupt").isNotNull() | F.col("m.version").isNull(), "malformed").alias("reason")).drop("_corrupt")


def read_track_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(path, track_order, file, offset_seconds, track) of tracks.json lists with two tracks or more; mixes are left out."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    rows = files.select("path", F.posexplode(F.from_json("value", "array<struct<file:string,offset_seconds:double>>")).alias("i", "t")).where(~F.col("t.file").startswith("mixed."))
    track = F.when(F.col("t.file").startswith("microphone"), "microphone").when(F.col("t.file").contains("system"), "system").otherwise("file")
    rows = rows.select("path", F.col("i").alias("track_order"), F.col("t.file").alias("file"), F.greatest(F.coalesce("t.offset_seconds", F.lit(0.0)), F.lit(0.0)).alias("offset_seconds"), track.alias("track"))
    enough = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("path")
    return rows.join(enough, "path", "left_semi")


def parse_metric_log(lines: DataFrame, names: list[str]) -> DataFrame:
    """One row a run of (run, value) lines ``name=number``, with a column for each of ``names``."""
    pattern = r"^(\w+)=([\d.]+)$"
    rows = lines.where(F.col("value").rlike(pattern)).select("run", F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("number"))
    return rows.groupBy("run").pivot("name", names).agg(F.max("number"))


KINDS = {"txt": export.export_txt, "srt": export.export_srt, "vtt": export.export_vtt, "json": export.export_json}
#: Bytes of documents that one packed file holds, about.
PACK_BYTES = 128 << 20


def write_transcripts(segments: DataFrame, path: str, kind: str = "txt") -> None:
    """One document per recording below ``path``/tid=.../; kinds txt, srt, vtt and json."""
    documents = KINDS[kind](segments)
    documents.select("tid", F.col("document").alias("value")).write.mode("overwrite").partitionBy("tid").option("lineSep", "\n").text(path)


def write_packed_transcripts(segments: DataFrame, path: str, kind: str = "txt", pack_bytes: int = PACK_BYTES) -> None:
    """The same documents packed into files by ranges of tid, sorted within; a file holds about ``pack_bytes``.

    The files' own statistics are the index: :func:`read_packed_transcripts` skips those that can't hold an id.
    """
    documents = saved(KINDS[kind](segments).select("tid", "document"), "transcripts")
    size = documents.agg(F.sum(F.octet_length("document"))).first()[0] or 0
    packed = documents.repartitionByRange(1 + size // pack_bytes, "tid").sortWithinPartitions("tid")
    packed.write.mode("overwrite").option("parquet.block.size", min(pack_bytes, 16 << 20)).parquet(path)
    removed(documents)


def read_packed_transcripts(spark: SparkSession, path: str, tids: list[str] | None = None) -> DataFrame:
    """(tid, document) of all packed transcripts, or of those of ``tids``."""
    rows = spark.read.schema("tid string, document string").parquet(path)
    return rows if tids is None else rows.where(F.col("tid").isin(*tids))


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit PCM WAV file of [frames, channels] floats, for tests and fixtures."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()
