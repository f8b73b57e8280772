"""Registered queries over sources, audio, voice activity, recognition and speakers, with their DuckDB SQL.

Samples are made of whole numbers from the given tables, so sums are the same in both engines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import columns as C
from voxloom.operators import audio, decode, speakers, transcript, vad
from voxloom.plans.adapters import cte, view
from voxloom.plans.catalog import ORACLES, query, table
from voxloom.plans.registry import ALL_REGIONS, LABELLED, WORDS, _match, _ts
from voxloom.sources import readers
from voxloom.sources.stored import new_path


def joined(values: Column, times: float = 1) -> Column:
    """An array of numbers as text of whole numbers."""
    return F.array_join(F.transform(values, lambda x: F.round(x * times).cast("long").cast("string")), ",")


def joined_sql(values: str, times: float = 1) -> str:
    return f"array_to_string(list_transform({values}, lambda x: CAST(CAST(round(x * {times}) AS BIGINT) AS VARCHAR)), ',')"


# --- samples -----------------------------------------------------------------------------------

SAMPLES = """samples AS (SELECT l_orderkey AS k, list(floor(l_quantity) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS s FROM lineitem GROUP BY l_orderkey)"""


def _samples(spark, d) -> DataFrame:
    """(k, s): the quantities of each order as samples."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    values = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.floor(x["l_quantity"]).cast("double"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(values.alias("s"))


@query(f"""WITH {SAMPLES} SELECT k, {joined_sql("list_transform(range(1, len(s) // (1 + k % 3) + 1), lambda i: list_sum(s[CAST((i - 1) * (1 + k % 3) + 1 AS INT) : CAST(i * (1 + k % 3) AS INT)]) / (1 + k % 3))", 6)} AS mono FROM samples""")
def a1_downmix(spark, d):
    return _samples(spark, d).select("k", joined(audio.downmix(F.col("s"), (F.col("k") % 3 + 1).cast("int")), 6).alias("mono"))


@query(f"""WITH {SAMPLES} SELECT k, {joined_sql("list_transform(range(0, len(s) * 2 // 3), lambda i: s[CAST(3 * i // 2 + 1 AS INT)] * (2 - 3 * i % 2) + s[CAST(least(3 * i // 2 + 1, len(s) - 1) + 1 AS INT)] * (3 * i % 2))")} AS halves FROM samples""")
def a2_resample_linear(spark, d):
    values = audio.resample_linear(F.col("s").cast("array<float>"), F.lit(3), F.lit(2))
    return _samples(spark, d).select("k", joined(values, 2).alias("halves"))


@query(f"WITH {SAMPLES} SELECT concat('o', k) AS tid, CAST(CASE WHEN k % 2 = 0 THEN len(s) ELSE round(len(s) * 2 / 3) END AS BIGINT) AS n FROM samples")
def a3_resample_exact(spark, d):
    rate = F.when(F.col("k") % 2 == 0, 2).otherwise(3)
    blocks = _samples(spark, d).select(F.concat(F.lit("o"), "k").alias("tid"), F.lit("file").alias("track"), F.lit(0).cast("long").alias("block_start"), F.col("s").cast("array<float>").alias("samples"), rate.alias("rate"))
    return audio.resample_tracks(blocks, 2).groupBy("tid").agg(F.sum(F.size("samples")).alias("n"))


GAIN = "CASE k % 5 WHEN 1 THEN 0.25 WHEN 2 THEN 2.0 WHEN 3 THEN 12.0 ELSE 1.0 END"


@query(f"""WITH {SAMPLES} SELECT k, {joined_sql(f"list_transform(s, lambda v: CASE WHEN k % 2 = 0 THEN least(v / 64 * {GAIN}, 1.0) ELSE v / 64 END)", 256)} AS louder FROM samples""")
def a4_apply_gain(spark, d):
    k = F.col("k") % 5
    gain = F.when(k == 1, 0.1).when(k == 2, 2.0).when(k == 3, 50.0).when(k == 4, float("nan"))
    track = F.when(F.col("k") % 2 == 0, "microphone").otherwise("system")
    quiet = F.transform("s", lambda x: x / 64)
    return _samples(spark, d).select("k", joined(audio.apply_gain(quiet, gain, track), 256).alias("louder"))


@query(f"WITH {SAMPLES} SELECT k, CAST(round(1000 * sqrt(list_sum(list_transform(s[greatest(len(s) - 2, 1) :], lambda x: x * x)) / least(len(s), 3))) AS BIGINT) AS level FROM samples")
def a5_rms_level(spark, d):
    return _samples(spark, d).select("k", F.round(audio.rms_level(F.col("s"), 3) * 1000).cast("long").alias("level"))


MIX = """WITH p AS (SELECT l_orderkey AS k, l_linenumber % 2 AS t, floor(l_quantity) AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem),
  n AS (SELECT k, count(DISTINCT t) AS tracks FROM p GROUP BY k)
  SELECT concat('o', p.k) AS tid, i + CASE WHEN t = 1 THEN p.k % 3 ELSE 0 END AS pos, CAST(round({v}) AS BIGINT) AS v FROM p JOIN n ON n.k = p.k GROUP BY 1, 2"""


def _mixed(spark, d, mode: str, times: int) -> DataFrame:
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    values = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.floor(x["l_quantity"]).cast("double") / 64)
    tracks = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("t")).agg(values.alias("samples"))
    offset = F.when(F.col("t") == 1, (F.col("l_orderkey") % 3) / 4.0).otherwise(0.0)
    tracks = tracks.select(F.concat(F.lit("o"), "l_orderkey").alias("tid"), F.col("t").cast("string").alias("track"), F.lit(0).cast("long").alias("block_start"), "samples", offset.alias("offset_s"))
    mix = audio.mix_tracks(tracks, 4, mode, 4).select("tid", "block_start", F.posexplode("samples").alias("i", "v"))
    return mix.where("v <> 0").select("tid", (F.col("block_start") + F.col("i")).alias("pos"), F.round(F.col("v") * times).cast("long").alias("v"))


@query(MIX.format(v="least(sum(v), 64)"))
def a8_mix_tracks(spark, d):
    return _mixed(spark, d, "sum", 64)


@query(MIX.format(v="sum(v) * 2 / first(tracks)"))
def a9_mix_mean(spark, d):
    return _mixed(spark, d, "mean", 128)


@query(
    """+ t AS (SELECT session_id, track_id, n, row_number() OVER (PARTITION BY session_id, track_id ORDER BY seq) AS k, count(*) OVER (PARTITION BY session_id, track_id) AS ks FROM v_blocks),
    f(s, t, k, ks, h, w) AS (SELECT session_id, track_id, k, ks, CAST(n AS BIGINT), 0 FROM t WHERE k = 1
      UNION ALL SELECT f.s, f.t, t.k, f.ks, CASE WHEN f.h >= 3000 THEN 0 ELSE f.h END + t.n, f.w + CASE WHEN f.h >= 3000 THEN 1 ELSE 0 END FROM f JOIN t ON t.session_id = f.s AND t.track_id = f.t AND t.k = f.k + 1)
    SELECT s AS tid, t AS track, CAST(w AS BIGINT) AS "window", h AS n FROM f WHERE h >= 3000 OR k = ks""",
    "v_blocks",
)
def a11_fixed_windows(spark, d):
    blocks = view(spark, d, "v_blocks").select(F.col("session_id").alias("tid"), F.col("track_id").alias("track"), "seq", "n")
    return audio.fixed_windows(blocks, 1000, 3)


def _waves(spark, d) -> DataFrame:
    """(id, samples): as many samples as a document has characters."""
    n = F.char_length("text")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.transform(index, lambda i: ((i * 7) % 11 - 5) / 8).cast("array<float>").alias("samples"))


def _log_mel_sql(window: int, error: str) -> str:
    return f"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN length(text) >= {window} THEN (length(text) - {window}) // 160 + 1 ELSE 0 END AS frames, CASE WHEN length(text) < {window} THEN '{error}' END AS error FROM documents WHERE text IS NOT NULL"


@query(_log_mel_sql(320, "audio is shorter than a window"))
def a12_asr_log_mel(spark, d):
    return audio.log_mel(_waves(spark, d)).select("id", F.greatest(F.size("features"), F.lit(0)).cast("long").alias("frames"), "error")


@query(_log_mel_sql(400, "audio is too short or not finite"))
def a13_speaker_log_mel(spark, d):
    return audio.log_mel(_waves(spark, d), "speaker").select("id", F.greatest(F.size("features"), F.lit(0)).cast("long").alias("frames"), "error")


# --- sources -----------------------------------------------------------------------------------

@query("""SELECT sha256(concat('/in/', p_partkey, '/', p_name, ext)) AS id, concat(p_name, ext) AS source_filename, p_partkey AS source_size_bytes, p_partkey * 10 AS source_modified_ms, 'queued' AS status
  FROM (SELECT *, ['.wav', '.MP3', '.txt', '.flac', ''][p_partkey % 5 + 1] AS ext FROM part) WHERE ext IN ('.wav', '.MP3', '.flac')""")
def s1_inventory_files(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".MP3", ".txt", ".flac", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/in/"), F.col("p_partkey").cast("string"), F.lit("/"), "p_name", ext)
    files = table(spark, d, "part").select(path.alias("path"), F.col("p_partkey").alias("length"), F.timestamp_millis(F.col("p_partkey") * 10).alias("modificationTime"))
    return readers.media_jobs(files, "m").select("id", "source_filename", "source_size_bytes", "source_modified_ms", "status")


#: A WAV header of one channel, 8 bits, 16 kHz, up to the size of the data.
WAV_HEADER = "524946460000000057415645666D74201000000001000100803E0000803E00000100080064617461"


@query("""WITH x AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)
  SELECT CAST(doc_id AS VARCHAR) AS path, CAST(16384 * b AS BIGINT) AS block_start, least(16384, n - 16384 * b) AS n, NULL AS error FROM x, LATERAL (SELECT unnest(range(greatest(1, (n + 16383) // 16384))) AS b) WHERE doc_id % 7 <> 0
  UNION ALL SELECT CAST(doc_id AS VARCHAR), -1, 0, 'not a WAV file' FROM x WHERE doc_id % 7 = 0""")
def s2_read_wav(spark, d):
    body = F.coalesce("text", F.lit("")).cast("binary")
    n = F.octet_length(body)
    size = F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255).cast("long")), 2, "0") for k in range(4)])
    header = F.when(F.col("doc_id") % 7 == 0, F.lit("00")).otherwise(F.lit(WAV_HEADER))
    content = F.concat(F.unhex(F.concat(header, size)), body)
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return readers.wav_blocks(files).select("path", F.coalesce("block_start", F.lit(-1)).cast("long").alias("block_start"), F.greatest(F.size("samples"), F.lit(0)).cast("long").alias("n"), "error")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CAST(1024 * b AS BIGINT) AS block_start, least(1024, n - 1024 * b) AS n FROM (SELECT doc_id, strlen(coalesce(text, '')) // 4 AS n FROM documents), LATERAL (SELECT unnest(range((n + 1023) // 1024)) AS b)""")
def s3_read_raw(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return readers.raw_blocks(files, 1024).select("path", "block_start", F.size("samples").cast("long").alias("n"))


@query("""SELECT concat('o', l_orderkey, ':', l_linenumber) AS id, CASE WHEN l_partkey % 11 = 0 THEN 'end' WHEN l_partkey % 13 = 0 THEN 'track' WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'unique' ELSE 'kept' END AS kept FROM lineitem""")
def s4_segments_table(spark, d):
    state = F.when(F.col("l_partkey") % 13 == 0, "radio").otherwise("file")
    end = F.when(F.col("l_partkey") % 11 == 0, F.col("l_linenumber") * 1.0).otherwise(F.col("l_linenumber") + 0.5)
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey", F.lit(":"), "l_linenumber").alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("transcription_id"), F.col("l_linenumber").cast("long").alias("segment_index"),
        (F.col("l_linenumber") * 1.0).alias("start_seconds"), end.alias("end_seconds"), F.col("l_returnflag").alias("text"), state.alias("source_track"), F.lit(None).cast("string").alias("speaker_id"), F.lit("final").alias("state"),
    )
    path = new_path(spark, "segments")
    rows.write.parquet(path)
    kept, bad = readers.read_segments(spark, path)
    return kept.select("id", F.lit("kept").alias("kept")).union(bad.select("id", "violation"))


@query("""SELECT id, CASE WHEN arrival % 10 = 0 THEN 'kind' WHEN arrival % 10 = 1 THEN 'status' WHEN arrival % 10 = 2 THEN 'size' WHEN arrival % 10 = 3 THEN 'null' ELSE 'kept' END AS kept FROM v_recordings""", "v_recordings")
def s4_transcriptions_table(spark, d):
    k = F.col("arrival") % 10
    rows = view(spark, d, "v_recordings").withColumns({
        "kind": F.when(k == 0, "tape").otherwise(F.col("kind")), "status": F.when(k == 1, "lost").otherwise(F.col("status")), "source_size_bytes": F.when(k == 2, -1).otherwise(5).cast("long"),
        "source_path": F.when(k == 3, F.lit(None)).otherwise(F.col("source_path")), "source_modified_ms": F.lit(0).cast("long"), "model_version": F.lit("m"),
    })
    kinds = readers.T.StructType.fromDDL(readers.TRANSCRIPTIONS)
    path = new_path(spark, "transcriptions")
    rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.parquet(path)
    kept, bad = readers.read_transcriptions(spark, path)
    return kept.select("id", F.lit("kept").alias("kept")).union(bad.select("id", "violation"))


@query("""SELECT concat('r', s_suppkey) AS revision, s_name AS recording, CASE WHEN s_suppkey % 6 = 0 THEN 'malformed' END AS reason FROM supplier WHERE s_suppkey % 6 <> 0 UNION ALL SELECT NULL, NULL, 'malformed' FROM supplier WHERE s_suppkey % 6 = 0""")
def s5_read_manifests(spark, d):
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.concat(F.lit("r"), "s_suppkey").alias("revision"), F.struct(F.col("s_name").alias("id")).alias("recording")))
    text = F.when(F.col("s_suppkey") % 6 == 0, F.substring(body, 1, 9)).otherwise(body)
    path = new_path(spark, "manifests")
    table(spark, d, "supplier").select("s_suppkey", text.alias("value")).repartition("s_suppkey").write.partitionBy("s_suppkey").text(path)
    return readers.read_manifests(spark, path).select("revision", F.col("recording.id").alias("recording"), "reason")


@query("""SELECT 'microphone-' || s_suppkey || '.wav' AS file, 0.0::DOUBLE AS offset_seconds, 'microphone' AS track FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT s_suppkey || '-system.wav', CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 4.0 ELSE 0.0 END, 'system' FROM supplier WHERE s_suppkey % 3 <> 0""")
def s6_track_offsets(spark, d):
    one = F.concat(F.lit('[{"file":"microphone-'), "s_suppkey", F.lit('.wav","offset_seconds":-1},{"file":"mixed.wav"}'))
    two = F.concat(F.lit(',{"file":"'), "s_suppkey", F.lit('-system.wav"'), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(',"offset_seconds":'), F.col("s_suppkey") / 4)).otherwise(""), F.lit("}"))
    text = F.concat(one, F.when(F.col("s_suppkey") % 3 != 0, two).otherwise(""), F.lit("]"))
    path = new_path(spark, "offsets")
    table(spark, d, "supplier").select("s_suppkey", text.alias("value")).repartition("s_suppkey").write.partitionBy("s_suppkey").text(path)
    return readers.read_track_offsets(spark, path).select("file", "offset_seconds", "track")


@query("""SELECT l_orderkey AS run, max(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey / 4.0 END) AS rtf, max(CASE WHEN l_linenumber % 2 = 1 AND l_suppkey % 5 <> 0 THEN l_suppkey * 1.0 END) AS load_ms FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_linenumber % 2 = 0 OR l_suppkey % 5 <> 0 THEN 1 END) > 0""")
def s7_metric_log(spark, d):
    good = F.concat(F.lit("load_ms="), "l_suppkey")
    line = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("rtf="), (F.col("l_partkey") / 4.0).cast("decimal(18,2)"))).when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("note: "), good)).otherwise(good)
    return readers.parse_metric_log(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), line.alias("value")), ["rtf", "load_ms"])


@query("+" + LABELLED.format(t="v_segments") + """ SELECT tid, CAST(sum(length(labelled) - length(replace(labelled, chr(10), '')) + 1) AS BIGINT) AS lines, CAST(sum(length(replace(labelled, chr(10), '')) + 15) AS BIGINT) AS chars FROM lab GROUP BY tid""", "v_segments")
def s8_write_transcripts(spark, d):
    path = new_path(spark, "transcripts")
    readers.write_transcripts(view(spark, d, "v_segments"), path)
    lines = spark.read.schema("value string, tid string").option("basePath", path).text(path)
    return lines.groupBy("tid").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("value")).alias("chars"))


@query("+" + LABELLED.format(t="v_segments") + f"SELECT tid, string_agg('[' || {_ts('start_ms', '.')} || '] ' || labelled, chr(10) ORDER BY start_ms, segment_index) AS document FROM lab GROUP BY tid", "v_segments")
def s8_packed_transcripts(spark, d):
    path = new_path(spark, "packed")
    readers.write_packed_transcripts(view(spark, d, "v_segments"), path, pack_bytes=1 << 16)
    return readers.read_packed_transcripts(spark, path)


# --- voice activity ----------------------------------------------------------------------------

def _counting_scorer():
    """A scorer whose state is the sum of all samples so far, in sixteenths."""

    def score(frame, state):
        total = (state or 0) + int(round(float(frame.sum()) * 16))
        return (total % 100) / 100, total

    return score


def _customer_blocks(spark, d, size: int, count: Column) -> DataFrame:
    """(tid, track, block_start, samples, k): ``count`` blocks of ``size`` samples ((place * key) % 17) / 16."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), count - 1)).alias("b"))
    values = F.transform(F.sequence(F.col("b") * size, F.col("b") * size + size - 1), lambda i: ((i * F.col("k")) % 17) / 16)
    return rows.select(F.concat(F.lit("c"), "k").alias("tid"), F.lit("file").alias("track"), (F.col("b") * size).cast("long").alias("block_start"), values.cast("array<float>").alias("samples"), "k")


@query("""WITH v AS (SELECT c_custkey AS k, (2 + c_custkey % 3) * 300 AS n, unnest(range((2 + c_custkey % 3) * 300)) AS i FROM customer),
  f AS (SELECT k, i // 512 AS f, (i * k) % 17 AS v FROM v UNION ALL SELECT k, i // 512 + 1, (i * k) % 17 FROM v WHERE i % 512 >= 448 AND (i // 512 + 1) * 512 < n),
  s AS (SELECT k, f, sum(v) AS v FROM f GROUP BY k, f)
  SELECT concat('c', k) AS tid, CAST(f AS INT) AS frame, CAST(sum(v) OVER (PARTITION BY k ORDER BY f) AS BIGINT) % 100 AS permille FROM s""")
def v1_score_vad(spark, d):
    blocks = _customer_blocks(spark, d, 300, (F.col("c_custkey") % 3 + 2).cast("int"))
    return vad.score_vad(blocks.drop("k"), _counting_scorer).select("tid", "frame", F.round(F.col("prob") * 100).cast("long").alias("permille"))


CHUNKS = "raw AS (SELECT concat('o', l_orderkey) AS tid, l_linenumber * 400000 AS start, l_linenumber * 400000 + l_partkey % 700 AS \"end\", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 400000, l_linenumber * 400000 + l_partkey % 700) AS k, count(*) OVER (PARTITION BY l_orderkey) AS ks FROM lineitem)"


@query(f"""WITH RECURSIVE {CHUNKS}, f(tid, k, ks, out, carried) AS (
    SELECT tid, 0, min(ks), CAST([] AS STRUCT(s BIGINT, e BIGINT)[]), CAST(NULL AS BIGINT) FROM raw GROUP BY tid
    UNION ALL SELECT f.tid, CAST(f.k + 1 AS INT), f.ks,
      CASE WHEN r."end" - coalesce(carried, r.start) >= 320 THEN list_append(out, {{'s': CAST(coalesce(carried, r.start) AS BIGINT), 'e': CAST(r."end" AS BIGINT)}})
           WHEN len(out) > 0 AND r."end" - out[-1].s <= 480000 THEN list_append(out[1 : len(out) - 1], {{'s': out[-1].s, 'e': CAST(r."end" AS BIGINT)}}) ELSE out END,
      CASE WHEN r."end" - coalesce(carried, r.start) >= 320 OR (len(out) > 0 AND r."end" - out[-1].s <= 480000) THEN NULL
           WHEN n."end" - coalesce(carried, r.start) <= 480000 THEN coalesce(carried, r.start) END
    FROM f JOIN raw r ON r.tid = f.tid AND r.k = f.k + 1 LEFT JOIN raw n ON n.tid = f.tid AND n.k = f.k + 2)
  SELECT tid, x.s AS start, x.e AS "end" FROM (SELECT tid, unnest(out) AS x FROM f WHERE k = ks)""")
def v5_repair_short_chunks(spark, d):
    start = F.col("l_linenumber").cast("long") * 400_000
    chunks = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("tid"), F.lit("file").alias("track"), start.alias("start"), (start + F.col("l_partkey") % 700).alias("end"))
    return vad.repaired_chunks(chunks).select("tid", "start", "end")


CURSORS = """c AS (SELECT concat('o', l_orderkey) AS tid, l_linenumber * 40000 AS start, l_linenumber * 40000 + l_partkey * 150 % 400000 + 1 AS "end", l_orderkey AS k FROM lineitem),
  e AS (SELECT * FROM c WHERE "end" > CASE WHEN k % 4 = 0 THEN 0 ELSE k * 13 % 200000 END AND (100000 + k * 31 % 300000 - "end" > 3200 OR "end" - start >= 352000 OR k % 7 = 0))"""


def _cursors(spark, d) -> tuple[DataFrame, DataFrame]:
    start = F.col("l_linenumber").cast("long") * 40_000
    chunks = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("tid"), F.lit("file").alias("track"), start.alias("start"), (start + F.col("l_partkey") * 150 % 400_000 + 1).alias("end"))
    k = F.col("o_orderkey")
    cursors = table(spark, d, "orders").select(F.concat(F.lit("o"), k).alias("tid"), F.lit("file").alias("track"), F.when(k % 4 != 0, k * 13 % 200_000).alias("emitted"), (k * 31 % 300_000 + 100_000).alias("audio_end"), (k % 7 == 0).alias("flush"))
    return chunks, cursors


@query(f'WITH {CURSORS} SELECT tid, start, "end" FROM e')
def v7_ready_chunks(spark, d):
    return vad.ready_chunks(*_cursors(spark, d)).select("tid", "start", "end")


@query(f"""WITH {CURSORS} SELECT concat('o', o_orderkey) AS tid, coalesce(greatest(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 13 % 200000 END, (SELECT max("end") FROM e WHERE e.tid = concat('o', o_orderkey))), -1) AS emitted FROM orders""")
def v7_advanced_cursors(spark, d):
    chunks, cursors = _cursors(spark, d)
    return vad.advanced_cursors(cursors, vad.ready_chunks(chunks, cursors)).select("tid", F.coalesce("emitted", F.lit(-1)).alias("emitted"))


def _spans(spark, d, start: Column, length: int) -> DataFrame:
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("tid"), F.lit("file").alias("track"), start.cast("long").alias("start"))
    return rows.withColumn("end", F.col("start") + length)


def _sums(rows: DataFrame) -> DataFrame:
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("tid", "start", F.size("samples").cast("long").alias("n"), F.round(total * 16).cast("long").alias("total"))


@query("SELECT concat('c', k) AS tid, s AS start, count(*) AS n, CAST(sum(i * k % 17) AS BIGINT) AS total FROM (SELECT c_custkey AS k, c_custkey % 200 AS s, unnest(range(c_custkey % 200, c_custkey % 200 + 150)) AS i FROM customer) GROUP BY k, s")
def v8_slice_audio(spark, d):
    blocks = _customer_blocks(spark, d, 100, F.lit(5)).drop("k")
    return _sums(vad.slice_audio(_spans(spark, d, F.col("c_custkey") % 200, 150), blocks, 100))


@query("SELECT concat('c', k) AS tid, s AS start, count(*) AS n, CAST(sum(i * k % 17) AS BIGINT) AS total FROM (SELECT c_custkey AS k, c_custkey % 450 AS s, unnest(range(c_custkey % 450, least(500, c_custkey % 450 + 80))) AS i FROM customer) GROUP BY k, s HAVING count(*) >= 75")
def d2_window_audio(spark, d):
    blocks = _customer_blocks(spark, d, 100, F.lit(5)).drop("k")
    return _sums(speakers.window_audio(_spans(spark, d, F.col("c_custkey") % 450, 80), blocks, 150, 100))


GREEDY = """, p AS (SELECT g.tid, greatest(start - 1920, 0) AS s, least("end" + 1920, audio_len) AS e FROM regions g JOIN v_all_vad_len l ON l.tid = g.tid),
  b AS (SELECT *, max(e) OVER (PARTITION BY tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM p),
  n AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY s, e) AS k FROM b),
  m AS (SELECT tid, min(s) AS s, max(e) AS e, row_number() OVER (PARTITION BY tid ORDER BY min(s)) AS i FROM n GROUP BY tid, k),
  w(tid, i, s, e, done) AS (
    SELECT tid, i, CAST(s + 352000 * greatest((e - s - 1) // 352000, 0) AS BIGINT), CAST(e AS BIGINT), list_transform(range(greatest((e - s - 1) // 352000, 0)), lambda x: {'s': CAST(s + 352000 * x AS BIGINT), 'e': CAST(s + 352000 * (x + 1) AS BIGINT)}) FROM m WHERE i = 1
    UNION ALL SELECT w.tid, m.i,
      CASE WHEN w.e - w.s < 240000 AND m.e - w.s <= 352000 THEN w.s ELSE CAST(m.s + 352000 * greatest((m.e - m.s - 1) // 352000, 0) AS BIGINT) END, CAST(m.e AS BIGINT),
      CASE WHEN w.e - w.s < 240000 AND m.e - w.s <= 352000 THEN done ELSE list_concat(list_append(done, {'s': w.s, 'e': w.e}), list_transform(range(greatest((m.e - m.s - 1) // 352000, 0)), lambda x: {'s': CAST(m.s + 352000 * x AS BIGINT), 'e': CAST(m.s + 352000 * (x + 1) AS BIGINT)})) END
    FROM w JOIN m ON m.tid = w.tid AND m.i = w.i + 1),
  z AS (SELECT tid, unnest(list_append(done, {'s': s, 'e': e})) AS x FROM w WHERE (tid, i) IN (SELECT (tid, max(i)) FROM m GROUP BY tid))
  SELECT tid, 'file' AS track, x.s AS start, x.e AS "end" FROM z WHERE x.e - x.s >= 320"""


ORACLES["v4_chunks"] = cte("v_all_frames", "v_all_vad_len") + ", " + (ALL_REGIONS + GREEDY).lstrip("+")


@query(ALL_REGIONS + GREEDY, "v_all_frames", "v_all_vad_len")
def v4_all_chunks(spark, d):
    frames = view(spark, d, "v_all_frames").select("tid", F.lit("file").alias("track"), "frame", (F.col("p100") / 100).alias("prob"))
    lengths = view(spark, d, "v_all_vad_len").select("tid", F.lit("file").alias("track"), F.col("audio_len").cast("long").alias("audio_len"))
    return vad.chunk_regions(vad.pad_and_merge_regions(vad.speech_regions(frames, lengths), lengths))


# --- recognition -------------------------------------------------------------------------------

@query("SELECT CAST(p_partkey + 1 AS INT) AS token_id, concat(p_name, ' ', p_partkey % 3) AS token FROM part UNION ALL SELECT 0, '<blk>'")
def t1_load_vocab(spark, d):
    lines = table(spark, d, "part").select(F.concat("p_name", F.lit("▁"), F.col("p_partkey") % 3, F.lit(" "), F.col("p_partkey") + 1).alias("value"))
    path = new_path(spark, "vocab")
    lines.union(spark.sql("SELECT '<blk> 0'")).write.text(path)
    return decode.load_vocab(spark, path)


VOCAB = (("<blk>", 0), ("a", 1), (" b", 2), (".", 3), (" c!", 4))
EMITTED = """f AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS frame, CASE WHEN l_suppkey % 4 = 0 AND l_partkey % 5 < 4 THEN l_partkey % 5 + 1 ELSE l_partkey % 5 END AS id FROM lineitem),
  g AS (SELECT *, lag(id) OVER (PARTITION BY k ORDER BY frame) AS b FROM f),
  t AS (SELECT k, frame, ['<blk>', 'a', ' b', '.', ' c!'][CAST(id + 1 AS INT)] AS token FROM g WHERE (b IS NULL OR b <> id) AND id <> 0)"""


def _ctc(spark, d) -> tuple[DataFrame, DataFrame]:
    vocab = spark.createDataFrame([(i, t) for t, i in VOCAB], "token_id int, token string")
    best, tie = F.col("l_partkey") % 5, F.col("l_suppkey") % 4 == 0
    scores = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when((i == best) | (tie & (i == best + 1)), 1.0).otherwise(0.0))
    frame = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    frames = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"), frame.alias("frame"), scores.alias("scores"))
    return frames, vocab


@query(f"""WITH {EMITTED}, x AS (SELECT k, trim(regexp_replace(string_agg(token, '' ORDER BY frame), '\\s+', ' ', 'g')) AS text FROM t GROUP BY k)
  SELECT concat('o', k) AS chunk_id, coalesce(text, '') AS text FROM (SELECT DISTINCT k FROM f) LEFT JOIN x USING (k)""")
def t2_ctc_decode(spark, d):
    return decode.ctc_decode(*_ctc(spark, d))


@query(f"""WITH {EMITTED}, n AS (SELECT *, coalesce(lead(frame) OVER w, 40) AS next, regexp_matches(token, '[.!]$') AS ender FROM t WINDOW w AS (PARTITION BY k ORDER BY frame)),
  p AS (SELECT *, coalesce(sum(CAST(ender AS INT)) OVER (PARTITION BY k ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS phrase FROM n),
  q AS (SELECT k, phrase, trim(regexp_replace(string_agg(token, '' ORDER BY frame), '\\s+', ' ', 'g')) AS text, max(CASE WHEN ender THEN (frame + 1 + next) / 2.0 / 40 * 10 END) AS stop FROM p GROUP BY k, phrase),
  r AS (SELECT k, phrase, text, coalesce(lag(stop) OVER (PARTITION BY k ORDER BY phrase), 0) AS start, coalesce(stop, 10) AS stop FROM q)
  SELECT concat('o', k) AS chunk_id, CAST(round(start * 1000) AS BIGINT) AS start_ms, CAST(round(stop * 1000) AS BIGINT) AS end_ms, text, NULL AS error FROM r WHERE k % 10 <> 3 AND text <> ''
  UNION ALL SELECT DISTINCT concat('o', k), -1, -1, NULL, 'duration' FROM f WHERE k % 10 = 3""")
def t3_ctc_phrases(spark, d):
    frames, vocab = _ctc(spark, d)
    bad = F.substring("chunk_id", 2, 99).cast("long") % 10 == 3
    durations = frames.select("chunk_id").distinct().select("chunk_id", F.when(bad, 0.0).otherwise(10.0).alias("duration"), F.lit(40).alias("n_frames"))
    ms = lambda c: F.coalesce(F.round(F.col(c) * 1000).cast("long"), F.lit(-1))
    return decode.ctc_phrases(frames, vocab, durations).select("chunk_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "text", "error")


@query("""WITH x AS (SELECT concat('o', l_orderkey) AS tid, l_linenumber * 1000 AS c, CASE WHEN l_suppkey % 9 = 0 THEN -90000 ELSE l_partkey % 700 END AS p, l_partkey % 5 * 100 AS n, l_returnflag AS text FROM lineitem),
  y AS (SELECT *, c + p >= 0 AND n > 0 AS ok FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY tid, ok ORDER BY c, p, p + n, text) - 1 AS i FROM y)
  SELECT tid, CASE WHEN ok THEN concat(tid, ':', i) END AS id, c + p AS start_ms, c + p + n AS end_ms, text, ok FROM z""")
def t4_make_segments(spark, d):
    p = F.when(F.col("l_suppkey") % 9 == 0, -90_000).otherwise(F.col("l_partkey") % 700)
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("tid"), (F.col("l_linenumber").cast("long") * 1000).alias("chunk_start_ms"), p.alias("phrase_start_ms"), (p + F.col("l_partkey") % 5 * 100).alias("phrase_end_ms"), F.col("l_returnflag").alias("text"))
    return transcript.make_segments(rows).select("tid", "id", "start_ms", "end_ms", "text", "ok")


def _step_model():
    """A model of four tokens whose frame i says token (2 i + frames) % 4."""

    def fn(features):
        n = len(features)
        return np.eye(4, dtype=np.float32)[(2 * np.arange(n) + n) % 4]

    return fn


@query("""WITH x AS (SELECT c_custkey AS k, (200 + c_custkey % 6 * 160 - 320) // 160 + 1 AS n FROM customer)
  SELECT concat('c', k) AS chunk_id, CASE WHEN k % 6 > 0 THEN trim(array_to_string(list_transform(range(n), lambda i: ['', 'a', 'b', ' c'][CAST((2 * i + n) % 4 + 1 AS INT)]), '')) END AS text,
  CASE WHEN k % 6 = 0 THEN 'audio is shorter than a window' END AS error FROM x""")
def t5_recognize(spark, d):
    k = F.col("c_custkey")
    samples = F.transform(F.sequence(F.lit(1), (k % 6 * 160 + 200).cast("int")), lambda i: ((i * k) % 17) / 16).cast("array<float>")
    chunks = table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("chunk_id"), samples.alias("samples"))
    vocab = spark.createDataFrame([(0, "<blk>"), (1, "a"), (2, "b"), (3, " c")], "token_id int, token string")
    return decode.recognize(chunks, _step_model, vocab, phrases=False)


# --- echo and events ---------------------------------------------------------------------------

PAIRS = f"""t AS (SELECT conv_id, turn, text AS a, CASE WHEN turn % 3 = 0 THEN concat(lower(text), ' extra words') WHEN turn % 3 = 1 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) ELSE upper(text) END AS b FROM conversations),
  w AS (SELECT *, {WORDS.format(t="coalesce(a, '')")} AS x, {WORDS.format(t="coalesce(b, '')")} AS y FROM t)"""


def _pairs(spark, d) -> DataFrame:
    last = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    b = F.when(F.col("turn") % 3 == 0, F.concat(F.lower("text"), F.lit(" extra words"))).when(F.col("turn") % 3 == 1, last).otherwise(C.upper_letters(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {_match('x', 'y')} AS same FROM w")
def x4_echo_text_matches(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", C.echo_text_matches(F.col("a"), F.col("b")).alias("same"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, {_match('x', 'y')} AS same FROM w")
def u3_sql_functions(spark, d):
    C.register_sql_functions(spark)
    return spark.sql("SELECT conv_id, turn, echo_text_matches(a, b) AS same FROM {pairs}", pairs=_pairs(spark, d))


EVENT = """e AS (SELECT arrival, session_id, change_id, CASE WHEN arrival % 11 = 0 THEN NULL WHEN arrival % 13 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN arrival % 17 = 0 THEN ' ' ELSE session_id END AS session, CASE WHEN arrival % 19 = 0 THEN NULL ELSE 'k' END AS key,
  CASE WHEN arrival % 7 = 0 THEN NULL ELSE arrival % 50 - 1 END AS seq, CASE WHEN arrival % 23 = 0 THEN NULL ELSE revision END AS revision, arrival % 100 / 10.0 AS s, arrival % 100 / 10.0 + arrival % 4 / 2.0 AS t FROM v_changes)"""


@query(f"""+ {EVENT} SELECT arrival, CASE WHEN version IS NULL OR version <> 1 THEN 'version' WHEN trim(session) = '' THEN 'session' WHEN key IS NULL THEN 'key' WHEN seq IS NULL OR seq < 0 THEN 'seq' WHEN revision IS NULL THEN 'revision' WHEN t <= s THEN 'time' END AS reason FROM e""", "v_changes")
def x8_validate_events(spark, d):
    a = F.col("arrival")
    events = view(spark, d, "v_changes").select(
        a, F.when(a % 11 == 0, F.lit(None)).when(a % 13 == 0, 2).otherwise(1).cast("int").alias("version"), F.when(a % 17 == 0, " ").otherwise(F.col("session_id")).alias("session_id"), F.col("change_id").alias("segment_id"),
        F.when(a % 19 != 0, "k").alias("idempotency_key"), F.when(a % 7 != 0, a % 50 - 1).alias("seq"), F.when(a % 23 != 0, F.col("revision")).alias("revision"), (a % 100 / 10.0).alias("start_seconds"), (a % 100 / 10.0 + a % 4 / 2.0).alias("end_seconds"),
    )
    return transcript.validate_events(events).select("arrival", "reason")


# --- speakers ----------------------------------------------------------------------------------

def _frame_count_model():
    """A model whose vector is the number of frames, empty if there are two."""
    return lambda features: np.array([len(features), 80] if len(features) != 2 else [], np.float32)


@query("""WITH x AS (SELECT c_custkey AS k, 2 * (100 + c_custkey % 8 * 100) AS n FROM customer)
  SELECT concat('c', k) AS id, CASE WHEN n >= 400 AND (n - 400) // 160 + 1 <> 2 THEN (n - 400) // 160 + 1 ELSE 0 END AS frames,
  CASE WHEN n < 400 THEN 'audio is too short or not finite' WHEN (n - 400) // 160 + 1 = 2 THEN 'vector is empty or not finite' END AS error FROM x""")
def d3_embed(spark, d):
    k = F.col("c_custkey")
    samples = F.transform(F.sequence(F.lit(1), (k % 8 * 100 + 100).cast("int")), lambda i: ((i * k) % 17) / 16).cast("array<float>")
    windows = table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("id"), samples.alias("samples"), F.lit(8000).alias("rate"))
    return speakers.embed(windows, _frame_count_model).select("id", F.coalesce(F.col("embedding")[0].cast("long"), F.lit(0)).alias("frames"), "error")


@query("""WITH w AS (SELECT l_linenumber % 2 AS setting, l_orderkey AS k, l_partkey % 100 * 1000 AS s, l_partkey % 100 * 1000 + 3000 AS e, l_suppkey % 3 AS label FROM lineitem),
  i AS (SELECT setting, o_orderkey % 2 AS speaker, label, count(*) AS n FROM w JOIN orders ON o_orderkey = k WHERE s >= o_orderkey % 50 * 1000 AND e <= o_orderkey % 50 * 1000 + 60000 GROUP BY ALL),
  t AS (SELECT setting, CAST(sum(a) AS BIGINT) AS inside, CAST(sum(m) AS BIGINT) AS dominant FROM (SELECT setting, speaker, sum(n) AS a, max(n) AS m FROM i GROUP BY ALL) GROUP BY setting)
  SELECT w.setting, count(*) AS windows, first(inside) AS inside, first(dominant) AS dominant FROM w LEFT JOIN t ON t.setting = w.setting GROUP BY w.setting""")
def d11_window_experiment(spark, d):
    start = F.col("l_partkey") % 100 * 1000
    windows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("setting"), F.concat(F.lit("o"), "l_orderkey").alias("tid"), start.alias("start"), (start + 3000).alias("end"), (F.col("l_suppkey") % 3).alias("label"))
    k = F.col("o_orderkey")
    reference = table(spark, d, "orders").select(F.concat(F.lit("o"), k).alias("tid"), (k % 50 * 1000).alias("start"), (k % 50 * 1000 + 60_000).alias("end"), (k % 2).alias("speaker"))
    return speakers.window_experiment(windows, reference, 16_000)
