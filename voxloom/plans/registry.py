"""Registered queries over the reference operators, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions import columns as C
from voxloom.operators import audio, export, jobs, journal, quality, snapshots, speakers, text_index, transcript, tree, vad
from voxloom.plans.adapters import view
from voxloom.plans.catalog import ORACLES, QUERIES, query  # noqa: F401


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_segments")


# --- transcripts -----------------------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"


def _bag(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0)"


def _match(a: str, b: str) -> str:
    n = f"least(len({a}), len({b}))"
    return f"(len({a}) > 0 AND len({b}) > 0 AND ({a} = {b} OR ({n} >= 3 AND {_bag(a, b)} * 5 >= {n} * 4 AND {_bag(a, b)} * 200 >= (len({a}) + len({b})) * 72)))"


ECHO = f"""
+ words AS (SELECT *, {WORDS.format(t="text")} AS w FROM v_segments),
pairs AS (
  SELECT m.tid, m.segment_index, m.w AS mw, s.w AS sw, s.start_ms AS ss, s.segment_index AS si FROM words m JOIN words s ON m.tid = s.tid
  WHERE m.source_track = 'microphone' AND s.source_track = 'system' AND s.start_ms <= m.end_ms + 750 AND s.end_ms >= m.start_ms - 750),
heard AS (SELECT tid, segment_index, bool_or({_match("mw", "sw")}) AS one, first(mw) AS mw, flatten(list(sw ORDER BY ss, si)) AS alls FROM pairs GROUP BY tid, segment_index),
kept AS (SELECT * FROM v_segments WHERE (tid, segment_index) NOT IN (SELECT (tid, segment_index) FROM heard WHERE one OR {_match("mw", "alls")}))
"""


@query(ECHO + "SELECT tid, segment_index, start_ms, end_ms, text, source_track FROM kept", "v_segments")
def x5_suppress_echo(spark, d):
    return transcript.suppress_microphone_echo(_segments(spark, d)).select("tid", "segment_index", "start_ms", "end_ms", "text", "source_track")


@query("SELECT tid, segment_index, CAST(row_number() OVER (PARTITION BY tid ORDER BY start_ms, segment_index) AS INT) AS position FROM v_segments", "v_segments")
def x3_order_segments(spark, d):
    return transcript.order_segments(_segments(spark, d)).select("tid", "segment_index", "position")


@query("SELECT tid, segment_index, regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', '', 'g') AS norm FROM v_segments", "v_segments")
def x7_normalized_text(spark, d):
    return _segments(spark, d).select("tid", "segment_index", C.normalized_text(F.col("text")).alias("norm"))


@query("SELECT tid, segment_index, coalesce(speaker_id, CASE WHEN source_track IN ('microphone', 'system') THEN source_track END, '') AS label, source_track || ':' || coalesce(speaker_id, '') AS speaker_key FROM v_segments", "v_segments")
def x10_speaker_label(spark, d):
    return transcript.with_speaker_labels(_segments(spark, d)).select("tid", "segment_index", "label", "speaker_key")


@query("SELECT tid, max(end_ms) AS duration_ms FROM v_segments GROUP BY tid", "v_segments")
def x11_duration(spark, d):
    return transcript.duration_by_recording(_segments(spark, d))


@query(
    """SELECT tid, bool_and(prev <= start_ms AND end_ms > start_ms AND start_ms >= 0 AND end_ms <= top) AS ok
    FROM (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY tid ORDER BY segment_index), 0) AS prev, max(end_ms) OVER (PARTITION BY tid) AS top FROM v_segments) GROUP BY tid""",
    "v_segments",
)
def x9_timeline_check(spark, d):
    s = _segments(spark, d)
    return transcript.timeline_check(s, transcript.duration_by_recording(s))


@query(
    """+ t AS (SELECT *, CASE source_track WHEN 'microphone' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS o FROM v_segments)
    SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY o, segment_index) - 1 AS segment_index, start_ms + o * 250 AS start_ms, end_ms + o * 250 AS end_ms, text, source_track FROM t""",
    "v_segments",
)
def x2_merge_tracks(spark, d):
    order = F.when(F.col("source_track") == "microphone", 0).when(F.col("source_track") == "system", 1).otherwise(2)
    s = _segments(spark, d).withColumn("track_order", order)
    tracks = s.select("tid", "track_order", F.col("source_track").alias("track"), (F.col("track_order") * 250).alias("offset_ms")).distinct()
    return transcript.merge_tracks(s.drop("source_track"), tracks)


@query(
    r"""+ r AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(regexp_replace(lag(text) OVER w, '\s+$', ''), '["''»)\]]+$', ''), '[.!?…]$') IS FALSE AND lag(source_track) OVER w = source_track
      AND lag(speaker_id) OVER w IS NOT DISTINCT FROM speaker_id AND start_ms - lag(end_ms) OVER w BETWEEN 0 AND 1000 THEN 0 ELSE 1 END AS new
      FROM v_segments WINDOW w AS (PARTITION BY tid ORDER BY segment_index)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY segment_index) AS island FROM r)
    SELECT tid, min(segment_index) AS segment_index, min(start_ms) AS start_ms, arg_max(end_ms, segment_index) AS end_ms, string_agg(trim(text), ' ' ORDER BY segment_index) AS text FROM i GROUP BY tid, island""",
    "v_segments",
)
def x1_join_phrases(spark, d):
    joined = transcript.join_phrases(_segments(spark, d))
    return joined.select("tid", "segment_index", "start_ms", "end_ms", F.trim("text").alias("text"))


GROUPS = r"""t AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY segment_index) AS k, lag(source_track) OVER w AS pt, lag(speaker_id) OVER w AS ps, lag(end_ms) OVER w AS pe
      FROM (SELECT * REPLACE (regexp_replace(text, '^\s+|\s+$', '', 'g') AS text) FROM v_segments) WHERE text <> '' WINDOW w AS (PARTITION BY tid ORDER BY segment_index)),
    f(tid, k, g, total, ended) AS (
      SELECT tid, k, 1, length(text) + 1, regexp_matches(text, '[.!?…][»”"'')\]]*$') FROM t WHERE k = 1
      UNION ALL
      SELECT t.tid, t.k, CASE WHEN b THEN f.g + 1 ELSE f.g END, CASE WHEN b THEN length(t.text) + 1 ELSE f.total + length(t.text) + 1 END, regexp_matches(t.text, '[.!?…][»”"'')\]]*$')
      FROM f JOIN t ON t.tid = f.tid AND t.k = f.k + 1, LATERAL (SELECT (f.total >= 240 AND f.ended) OR t.pt <> t.source_track OR t.ps IS DISTINCT FROM t.speaker_id OR t.start_ms - t.pe > 2000 AS b)),
    grouped AS (SELECT f.tid, CAST(g AS INT) AS group_id, min(segment_index) AS first_index, count(*) AS n, string_agg(text, ' ' ORDER BY segment_index) AS text FROM f JOIN t ON f.tid = t.tid AND f.k = t.k GROUP BY f.tid, g)"""


@query("+" + GROUPS + " SELECT * FROM grouped", "v_segments")
def x6_group_sentences(spark, d):
    return transcript.group_sentences(_segments(spark, d))


# --- export ----------------------------------------------------------------------------------

def _ts(ms: str, sep: str) -> str:
    return f"(CASE WHEN {ms} // 3600000 < 100 THEN lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') ELSE CAST({ms} // 3600000 AS VARCHAR) END || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '{sep}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'))"


LABELLED = """lab AS (SELECT *, CASE WHEN bool_or(source_track = 'microphone') OVER p AND bool_or(source_track = 'system') OVER p THEN
  CASE source_track WHEN 'microphone' THEN 'Микрофон: ' WHEN 'system' THEN 'Система: ' ELSE '' END ELSE '' END || text AS labelled FROM {t} WINDOW p AS (PARTITION BY tid))"""


@query(ECHO + ", " + LABELLED.format(t="kept") + f"SELECT tid, string_agg('[' || {_ts('start_ms', '.')} || '] ' || labelled, chr(10) ORDER BY start_ms, segment_index) AS document FROM lab GROUP BY tid", "v_segments")
def k2_export_txt(spark, d):
    return export.export_txt(transcript.suppress_microphone_echo(_segments(spark, d)))


@query("+" + LABELLED.format(t="v_segments") + f"SELECT tid, string_agg(CAST(segment_index + 1 AS VARCHAR) || chr(10) || {_ts('start_ms', ',')} || ' --> ' || {_ts('end_ms', ',')} || chr(10) || labelled, chr(10) || chr(10) ORDER BY start_ms, segment_index) AS document FROM lab GROUP BY tid", "v_segments")
def k3_export_srt(spark, d):
    return export.export_srt(_segments(spark, d))


@query("+" + LABELLED.format(t="v_segments") + f"SELECT tid, 'WEBVTT' || chr(10) || chr(10) || string_agg({_ts('start_ms', '.')} || ' --> ' || {_ts('end_ms', '.')} || chr(10) || labelled, chr(10) || chr(10) ORDER BY start_ms, segment_index) AS document FROM lab GROUP BY tid", "v_segments")
def k4_export_vtt(spark, d):
    return export.export_vtt(_segments(spark, d))


@query("""SELECT tid, CAST(to_json(list({'segment_index': segment_index, 'start_ms': start_ms, 'end_ms': end_ms, 'text': text, 'source_track': source_track, 'speaker_id': speaker_id} ORDER BY start_ms, segment_index)) AS VARCHAR) AS document FROM v_segments GROUP BY tid""", "v_segments")
def k5_export_json(spark, d):
    return export.export_json(_segments(spark, d))


@query(
    """+ r AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY start_ms, segment_index) AS k, bool_or(end_ms <= start_ms OR start_ms < 0 OR text IS NULL) OVER (PARTITION BY tid) AS bad FROM v_segments)
    SELECT tid, string_agg(text, ' ' ORDER BY k) AS summary, string_agg(tid || ':' || segment_index, ',' ORDER BY k) AS source_ids FROM r WHERE k <= 6 AND NOT bad GROUP BY tid""",
    "v_segments",
)
def k7_extractive_summary(spark, d):
    return export.extractive_summary(_segments(spark, d))


@query("SELECT id, CAST(piece AS INT) AS piece, substr(text, CAST(piece AS INT) * 1000 + 1, 1000) AS text FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text, unnest(range((length(text) - 1) // 1000 + 1)) AS piece FROM documents WHERE trim(text) <> '' AND length(text) <= 1000000)")
def k8_split_text(spark, d):
    return export.split_text(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text"), 1000)


@query("SELECT o_orderkey AS id, strftime(make_timestamp(o_orderkey * 86399000 * 1000), '%Y%m%d-%H%M%S') AS stamp FROM orders")
def k10_archive_timestamp(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), C.archive_timestamp(F.col("o_orderkey") * 86_399_000).alias("stamp"))


@query("SELECT o_orderkey AS id, (o_custkey % 7, o_orderkey % 11, o_orderkey % 13) > (o_orderkey % 5, o_custkey % 9, o_custkey % 3) AND o_orderkey % 10 <> 0 AS newer FROM orders")
def k11_newer_version(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    mod = lambda c, n: (F.col(c) % n).cast("string")
    new = F.concat(F.lit("v"), F.concat_ws(".", mod("o_custkey", 7), mod("o_orderkey", 11), mod("o_orderkey", 13)), F.when(F.col("o_orderkey") % 10 == 0, "-rc1").otherwise(""))
    old = F.concat_ws(".", mod("o_orderkey", 5), mod("o_custkey", 9), mod("o_custkey", 3))
    return o.select(F.col("o_orderkey").alias("id"), C.newer_stable_version(new, old).alias("newer"))


# --- jobs and search -------------------------------------------------------------------------

def _jobs(spark, d):
    return view(spark, d, "v_jobs").withColumn("created_ms", (F.col("arrival") * 7919) % 100_003)


JOBS = "+ jobs AS (SELECT *, (arrival * 7919) % 100003 AS created_ms FROM v_jobs) "


@query(JOBS + """SELECT id, owner, rank FROM (SELECT id, owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY created_ms, arrival) AS INT) AS rank FROM jobs
  WHERE queue_visible AND kind = 'file' AND status = 'queued' AND start_requested AND owner NOT IN (SELECT owner FROM jobs WHERE status IN ('preparing', 'transcribing'))) WHERE rank <= 2""", "v_jobs")
def q2_claim_next(spark, d):
    return jobs.claim_next(_jobs(spark, d), 2).select("id", "owner", "rank")


@query(JOBS + "SELECT id, created_ms FROM jobs WHERE queue_visible", "v_jobs")
def q1_queue_view(spark, d):
    return jobs.queue_view(_jobs(spark, d)).select("id", "created_ms")


@query("""+ c AS (SELECT owner, arrival, status, lag(status) OVER (PARTITION BY owner ORDER BY arrival) AS b FROM v_jobs)
  SELECT owner, arrival, CASE WHEN b IS NULL THEN status = 'queued' ELSE (b || '>' || status) IN (%s) END AS allowed FROM c""" % ", ".join(f"'{a}>{b}'" for a, b in jobs.TRANSITIONS), "v_jobs")  # fmt: skip
def q3_validate_transitions(spark, d):
    rows = view(spark, d, "v_jobs").select(F.col("owner").alias("id"), F.col("arrival").alias("seq"), "status")
    return jobs.validate_transitions(rows).select(F.col("id").alias("owner"), F.col("seq").alias("arrival"), "allowed")


@query("""SELECT id, CASE WHEN arrival % 4 = 0 AND status = 'queued' THEN 'cancelled' ELSE status END AS status, cancel_requested OR (arrival % 4 = 0 AND status IN ('preparing', 'transcribing')) AS cancel_requested,
  coalesce(CASE WHEN arrival % 4 = 0 AND status = 'queued' THEN 777 ELSE completed_ms END, -1) AS completed_ms FROM v_recordings""", "v_recordings")
def q5_apply_cancel(spark, d):
    j = view(spark, d, "v_recordings")
    return jobs.apply_cancel(j, j.where("arrival % 4 = 0").select("id"), 777).select("id", "status", "cancel_requested", F.coalesce("completed_ms", F.lit(-1)).alias("completed_ms"))


@query("""+ a AS (SELECT *, status = 'transcribing' AND NOT cancel_requested AND arrival % 3 <> 2 AS go, arrival % 3 = 0 AS ok FROM v_recordings)
  SELECT id, go AS applied, CASE WHEN go AND ok THEN 'completed' WHEN go THEN 'failed' ELSE status END AS status, CASE WHEN go AND ok THEN NULL WHEN go THEN concat('bad ', arrival) ELSE error END AS error,
  coalesce(CASE WHEN go THEN 777 ELSE completed_ms END, -1) AS completed_ms, coalesce(CASE WHEN go AND ok THEN arrival % 50 + 0.5 ELSE duration_seconds END, -1) AS duration_seconds FROM a""", "v_recordings")
def q6_complete_or_fail(spark, d):
    j = view(spark, d, "v_recordings")
    result = ["id", (F.col("arrival") % 3 == 0).alias("ok"), F.concat(F.lit("bad "), "arrival").alias("error"), (F.col("arrival") % 50 + 0.5).alias("duration_seconds")]
    results = j.where("arrival % 3 <> 2").select(*result)
    # A second result of a job: a success counts, else the last error by its text.
    second = results.where("ok").select("id", F.lit(False).alias("ok"), F.lit("zz").alias("error"), "duration_seconds")
    ended = jobs.complete_or_fail(j, results.unionByName(second), 777)
    return ended.select("id", "applied", "status", "error", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("completed_ms", "duration_seconds")])


@query("""SELECT id, CASE WHEN status IN ('preparing', 'transcribing') THEN 'interrupted' ELSE status END AS status, CASE WHEN status IN ('preparing', 'transcribing') THEN 'Application stopped during transcription' ELSE error END AS error,
  coalesce(CASE WHEN status IN ('preparing', 'transcribing') THEN 777 ELSE completed_ms END, -1) AS completed_ms FROM v_recordings""", "v_recordings")
def q7_recover_interrupted(spark, d):
    return jobs.recover_interrupted(view(spark, d, "v_recordings"), 777).select("id", "status", "error", F.coalesce("completed_ms", F.lit(-1)).alias("completed_ms"))


@query("SELECT id, CASE WHEN arrival % 3 = 0 THEN 'failed' WHEN arrival % 3 = 1 THEN 'completed' ELSE 'failed' END AS state, CASE WHEN arrival % 3 = 0 THEN 777 ELSE arrival END AS updated_ms FROM v_jobs", "v_jobs")
def q7_recover_finalizations(spark, d):
    state = F.element_at(F.array(F.lit("finalizing"), F.lit("completed"), F.lit("failed")), (F.col("arrival") % 3 + 1).cast("int"))
    open_ = view(spark, d, "v_jobs").select("id", state.alias("state"), F.col("arrival").alias("updated_ms"))
    return jobs.recover_finalizations(open_, 777)


RESET = """+ g AS (SELECT *, arrival % 2 = 0 AND status IN ('completed', 'cancelled', 'failed', 'interrupted') AND (kind = 'file' OR coalesce(audio_path, '') <> '') AS go FROM v_recordings) """


@query(RESET + """SELECT id, go AS reset, CASE WHEN go THEN 'file' ELSE kind END AS kind, CASE WHEN go THEN 'queued' ELSE status END AS status, CASE WHEN go AND kind = 'live' THEN audio_path ELSE source_path END AS source_path,
  CASE WHEN go THEN NULL ELSE error END AS error, coalesce(CASE WHEN go THEN NULL ELSE started_ms END, -1) AS started_ms, coalesce(CASE WHEN go THEN NULL ELSE completed_ms END, -1) AS completed_ms,
  coalesce(CASE WHEN go THEN NULL ELSE duration_seconds END, -1) AS duration_seconds, CASE WHEN go THEN 0 ELSE completed_chunks END AS completed_chunks, coalesce(CASE WHEN go THEN NULL ELSE total_chunks END, -1) AS total_chunks,
  cancel_requested AND NOT go AS cancel_requested, start_requested AND NOT go AS start_requested, queue_visible OR go AS queue_visible FROM g""", "v_recordings")
def q8_reset_for_retry(spark, d):
    j = view(spark, d, "v_recordings")
    out = jobs.reset_for_retry(j, j.where("arrival % 2 = 0").select("id"))
    numbers = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("started_ms", "completed_ms", "duration_seconds", "total_chunks")]
    return out.select("id", "reset", "kind", "status", "source_path", "error", *numbers, "completed_chunks", "cancel_requested", "start_requested", "queue_visible")


@query(RESET + "SELECT concat('o', l_orderkey) AS tid, l_linenumber AS segment_index FROM lineitem WHERE concat('o', l_orderkey) NOT IN (SELECT id FROM g WHERE go)", "v_recordings")
def q8_segments_after_reset(spark, d):
    j = view(spark, d, "v_recordings")
    s = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("o"), "l_orderkey").alias("tid"), F.col("l_linenumber").alias("segment_index"))
    return jobs.segments_after_reset(s, jobs.reset_for_retry(j, j.where("arrival % 2 = 0").select("id")))


@query("SELECT id, CASE WHEN arrival % 5 = 1 AND status = 'queued' THEN 'cancelled' ELSE status END AS status, queue_visible AND NOT (arrival % 5 = 1 AND status IN ('completed', 'cancelled', 'failed', 'interrupted', 'queued')) AS queue_visible FROM v_jobs", "v_jobs")
def q9_hide_from_queue(spark, d):
    j = view(spark, d, "v_jobs")
    return jobs.hide_from_queue(j, j.where("arrival % 5 = 1").select("id")).select("id", "status", "queue_visible")


@query("SELECT o_orderkey AS tid, completed, completed + CAST(ceil(greatest(300 - processed, 0) / 22.0::DOUBLE) AS BIGINT) AS estimate FROM (SELECT l_orderkey AS o_orderkey, max(l_linenumber) + 1 AS completed, max(l_linenumber) * 22 AS processed FROM lineitem GROUP BY l_orderkey)")
def q10_progress(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("tid"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_linenumber") * 22).alias("end_s"))
    return jobs.progress(rows, rows.select("tid", F.lit(300).alias("duration_s")).distinct())


@query("""SELECT j.id, CASE WHEN kind = 'live' AND arrival % 2 = 0 THEN f.p ELSE CASE WHEN arrival % 2 = 1 THEN 'own.wav' END END AS audio_path
  FROM v_jobs j LEFT JOIN (SELECT concat('o', l_orderkey) AS id, min(concat('p', l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.txt' ELSE '.flac' END)) AS p FROM lineitem WHERE l_linenumber % 3 <> 1 GROUP BY 1) f ON j.id = f.id""", "v_jobs")
def q11_backfill_audio(spark, d):
    j = view(spark, d, "v_jobs").withColumn("audio_path", F.when(F.col("arrival") % 2 == 1, "own.wav"))
    ext = F.when(F.col("l_linenumber") % 3 == 0, ".WAV").when(F.col("l_linenumber") % 3 == 1, ".txt").otherwise(".flac")
    files = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("o"), "l_orderkey").alias("id"), F.concat(F.lit("p"), "l_linenumber", ext).alias("path"))
    return jobs.backfill_audio_path(j, files).select("id", "audio_path")


@query("""+ c AS (SELECT DISTINCT tid AS id, 'Talk_' || tid || '_50%.wav' AS source_filename FROM v_segments)
  SELECT id, source_filename FROM c WHERE contains(lower(source_filename), 'c1') OR id IN (SELECT tid FROM v_segments WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the on'))""", "v_segments")
def q12_search(spark, d):
    s = _segments(spark, d)
    names = s.select(F.col("tid").alias("id")).distinct().withColumn("source_filename", F.concat(F.lit("Talk_"), "id", F.lit("_50%.wav")))
    by_text = jobs.search(names, s, "The ON")
    return by_text.unionByName(jobs.search(names, s.limit(0), "C1")).distinct()


# Nine characters out of every segment, and parts of names, are searched for.
@query("""+ c AS (SELECT DISTINCT tid AS id, 'Talk_' || tid || '_50%.wav' AS source_filename FROM v_segments),
  q AS (SELECT tid || ':' || segment_index AS query_id, upper(substring(text, 5 + segment_index % 7, 9)) AS query FROM v_segments UNION ALL SELECT DISTINCT 'name:' || tid, tid || '_5' FROM v_segments UNION ALL SELECT 'odd', '_50%' UNION ALL SELECT 'two', 'Zz' UNION ALL SELECT 'no', NULL),
  t AS (SELECT tid AS id, text AS x FROM v_segments UNION ALL SELECT id, source_filename FROM c),
  f AS (SELECT id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM t)
  SELECT DISTINCT query_id, id FROM q JOIN f ON contains(x, translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))""", "v_segments")
def q12_search_many(spark, d):
    s = view(spark, d, "v_segments")
    names = s.select(F.col("tid").alias("id")).distinct().withColumn("source_filename", F.concat(F.lit("Talk_"), "id", F.lit("_50%.wav")))
    spoken = s.select(F.concat_ws(":", "tid", "segment_index").alias("query_id"), C.upper_letters(F.expr("substring(text, 5 + segment_index % 7, 9)")).alias("query"))
    named = names.select(F.concat(F.lit("name:"), "id").alias("query_id"), F.concat("id", F.lit("_5")).alias("query"))
    fixed = spark.createDataFrame([("odd", "_50%"), ("two", "Zz"), ("no", None)], "query_id string, query string")
    return text_index.search_many(text_index.build_index(names, s), spoken.unionByName(named).unionByName(fixed))


@query("SELECT id FROM v_jobs WHERE contains(lower(source_filename), '-high')", "v_jobs")
def q13_search_unicode(spark, d):
    return jobs.search_unicode(view(spark, d, "v_jobs"), "-High").select("id")


@query("SELECT concat('o', o_orderkey + 1) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'completed' ELSE 'interrupted' END AS status FROM orders WHERE concat('o', o_orderkey + 1) NOT IN (SELECT id FROM v_jobs WHERE arrival % 2 = 0)", "v_jobs")
def q14_recovered_sessions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    state = F.when(F.col("o_orderkey") % 3 == 0, "failed").when(F.col("o_orderkey") % 3 == 1, "completed").otherwise("recording")
    archives = o.select(F.concat(F.lit("o"), F.col("o_orderkey") + 1).alias("id"), state.alias("session_state"))
    return jobs.recovered_sessions(archives, view(spark, d, "v_jobs").where("arrival % 2 = 0"))


# --- trees -----------------------------------------------------------------------------------

WALK = """+ walk(id, depth, sort_key, names) AS (
  SELECT id, 0, [{'p': position, 'i': id}], [name] FROM v_nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.id, w.depth + 1, list_append(w.sort_key, {'p': n.position, 'i': n.id}), list_append(w.names, n.name) FROM walk w JOIN v_nodes n ON n.parent_id = w.id) """


@query(WALK + "SELECT id, depth, CAST(row_number() OVER (ORDER BY sort_key) AS INT) AS row FROM walk", "v_nodes")
def o3_visible_tree(spark, d):
    return tree.visible_tree(view(spark, d, "v_nodes"))


@query(WALK + "SELECT id, array_to_string(names, ' / ') AS path FROM walk WHERE id IN (SELECT id FROM v_nodes WHERE kind = 'folder')", "v_nodes")
def o4_folder_paths(spark, d):
    return tree.folder_paths(view(spark, d, "v_nodes"))


@query("SELECT id, CASE WHEN position % 50 = 3 THEN 'name' ELSE 'parent' END AS reason FROM v_nodes WHERE (position % 50 = 3 AND kind = 'folder') OR (position % 50 = 7 AND NOT (position % 50 = 3 AND kind = 'folder'))", "v_nodes")
def o2_validate_tree(spark, d):
    n = view(spark, d, "v_nodes")
    bad = n.withColumn("name", F.when((F.col("position") % 50 == 3) & (F.col("kind") == "folder"), " ").otherwise(F.col("name")))
    bad = bad.withColumn("parent_id", F.when(F.col("position") % 50 == 7, "nowhere").otherwise(F.col("parent_id")))
    return tree.validate_tree(bad)


@query("""+ m AS (SELECT id, kind, name, position, CASE WHEN id = 'n2' THEN 'nowhere' ELSE parent_id END AS parent_id, position % 3 = 0 AS c, position % 5 = 0 AS l FROM v_nodes),
  t AS (SELECT id, kind, parent_id, CASE WHEN c AND NOT l THEN name || '?' WHEN l THEN name || '!' ELSE name END AS name, c AND l AS conflict FROM m),
  up AS (SELECT id, parent_id FROM t UNION SELECT up.id, t.parent_id FROM up JOIN t ON up.parent_id = t.id)
  SELECT id, name, conflict, id IN (SELECT up.id FROM up WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM t WHERE kind = 'folder')) AS broken FROM t""", "v_nodes")
def o10_merge_trees(spark, d):
    n = view(spark, d, "v_nodes").withColumn("parent_id", F.when(F.col("id") == "n2", "nowhere").otherwise(F.col("parent_id")))
    mark = lambda k, x: n.withColumn("name", F.when(F.col("position") % k == 0, F.concat("name", F.lit(x))).otherwise(F.col("name")))
    return tree.merge_trees(n, mark(3, "?"), mark(5, "!")).select("id", "node.name", "conflict", "broken")


@query("""+ x AS (SELECT *, CASE WHEN position % 4 = 0 THEN name || '~' ELSE name END AS ln, CASE WHEN position % 6 = 0 THEN position + 1 ELSE position END AS lp FROM v_nodes)
  SELECT id, CASE WHEN position % 4 = 0 THEN ln ELSE name || '+' END AS name, CASE WHEN position % 6 = 0 THEN lp ELSE position + 100 END AS position, CASE WHEN position % 6 <> 0 AND id LIKE 's%' THEN 'n0' ELSE parent_id END AS parent_id,
  false AS imported, name || '+' AS base_name, position + 100 AS base_position FROM x""", "v_nodes")
def o11_reconcile_folders(spark, d):
    n = view(spark, d, "v_nodes")
    to = F.when(F.col("id").startswith("s"), "n0").otherwise(F.col("parent_id"))
    remote = n.withColumn("name", F.concat("name", F.lit("+"))).withColumn("position", F.col("position") + 100).withColumn("parent_id", to)
    local = n.withColumn("name", F.when(F.col("position") % 4 == 0, F.concat("name", F.lit("~"))).otherwise(F.col("name"))).withColumn("position", F.when(F.col("position") % 6 == 0, F.col("position") + 1).otherwise(F.col("position")))
    return tree.reconcile_restored_folders(local, remote, n).select("id", "name", "position", "parent_id", "imported", "base_name", "base_position")


@query("SELECT id, 'drive-folder-' || sha256('dev:' || id) AS folder_id FROM v_nodes", "v_nodes")
def o12_canonical_folder(spark, d):
    return view(spark, d, "v_nodes").select("id", C.canonical_folder_id(F.col("id"), F.lit("dev")).alias("folder_id"))


@query("""+ x AS (SELECT id, position, CASE WHEN parent_id = 'n3' THEN (SELECT parent_id FROM v_nodes WHERE id = 'n3') ELSE parent_id END AS parent_id, coalesce(parent_id = 'n3', false) AS late FROM v_nodes WHERE id <> 'n3')
  SELECT id, parent_id, CASE WHEN parent_id = (SELECT parent_id FROM v_nodes WHERE id = 'n3') THEN row_number() OVER (PARTITION BY parent_id ORDER BY late, position, id) - 1 ELSE position END AS position FROM x""", "v_nodes")
def o7_delete_folder(spark, d):
    return tree.delete_folder(view(spark, d, "v_nodes"), "n3").select("id", "parent_id", "position")


@query("SELECT id, parent_id, position + CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END AS position FROM v_nodes UNION ALL SELECT 'new', NULL, 0", "v_nodes")
def o9_place_first(spark, d):
    n = view(spark, d, "v_nodes")
    return tree.place_first(n, spark.sql("SELECT 'new' AS id, 'New' AS name")).select("id", "parent_id", "position")


# --- quality ---------------------------------------------------------------------------------

@query(
    r"""+ a AS (SELECT tid, string_agg(text, ' ' ORDER BY start_ms, segment_index) AS ref FROM v_segments GROUP BY tid),
    b AS (SELECT tid, string_agg(lower(text), ' ' ORDER BY start_ms, segment_index) AS hyp FROM v_segments WHERE segment_index % 2 = 0 GROUP BY tid),
    c AS (SELECT coalesce(a.tid, b.tid) AS tid, regexp_replace(lower(coalesce(ref, '')), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS r, regexp_replace(coalesce(hyp, ''), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS h FROM a FULL JOIN b ON a.tid = b.tid)
    SELECT tid, CAST(length(r) - length(h) AS INT) AS fewer, CAST(greatest(length(r), 1) AS INT) AS length FROM c""",
    "v_segments",
)
def e1_cer_lengths(spark, d):
    return _lengths(_segments(spark, d))


def _lengths(s: DataFrame) -> DataFrame:
    hyp = s.where("segment_index % 2 = 0").withColumn("text", F.lower("text"))
    both = quality.joined_text(s, "r").join(quality.joined_text(hyp, "h"), "tid", "full")
    n = lambda c: F.char_length(C.normalized_text(F.coalesce(c, F.lit(""))))
    return both.select("tid", (n("r") - n("h")).alias("fewer"), F.greatest(n("r"), F.lit(1)).alias("length"))


@query(
    r"""+ a AS (SELECT tid, string_agg(text, ' ' ORDER BY start_ms, segment_index) AS ref FROM v_segments GROUP BY tid),
    b AS (SELECT tid, string_agg(lower(text), ' ' ORDER BY start_ms, segment_index) AS hyp FROM v_segments WHERE segment_index % 2 = 0 GROUP BY tid),
    c AS (SELECT coalesce(a.tid, b.tid) AS tid, regexp_replace(lower(coalesce(ref, '')), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS r, regexp_replace(coalesce(hyp, ''), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS h FROM a FULL JOIN b ON a.tid = b.tid)
    SELECT tid, CAST(length(r) - length(h) AS INT) AS fewer, CAST(greatest(length(r), 1) AS INT) AS length FROM c""",
    "v_segments",
)
def e1_cer_whole_lengths(spark, d):
    return _lengths(_segments(spark, d))


# DuckDB's distance is of bytes, so letters beyond ASCII become marks, which no normalised text holds.
@query(
    r"""+ a AS (SELECT tid, string_agg(text, ' ' ORDER BY start_ms, segment_index) AS ref FROM v_segments GROUP BY tid),
    b AS (SELECT tid, string_agg(lower(text), ' ' ORDER BY start_ms, segment_index) AS hyp FROM v_segments WHERE segment_index % 7 <> 6 GROUP BY tid),
    c AS (SELECT coalesce(a.tid, b.tid) AS tid, regexp_replace(lower(coalesce(ref, '')), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS r, regexp_replace(coalesce(hyp, ''), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS h FROM a FULL JOIN b ON a.tid = b.tid),
    e AS (SELECT tid, CAST(levenshtein(translate(r, 'àáâäçèéêëíïñóôöùúûüß', '!"#$%&()*+,-./:;<=>?'), translate(h, 'àáâäçèéêëíïñóôöùúûüß', '!"#$%&()*+,-./:;<=>?')) AS INT) AS distance,
            CAST(greatest(length(r), 1) AS INT) AS length FROM c)
    SELECT tid, distance, length, CAST(distance AS DOUBLE) / length AS cer FROM e""",
    "v_segments",
)
def e1_cer(spark, d):
    s = _segments(spark, d)
    return quality.cer(s, s.withColumn("text", F.lower("text")).where("segment_index % 7 <> 6"))


@query(
    """+ t AS (SELECT tid, lower(string_agg(text, ' ' ORDER BY start_ms, segment_index)) AS x FROM v_segments GROUP BY tid)
    SELECT tid, phrase, CAST((length(x) - length(replace(x, phrase, ''))) // length(phrase) AS INT) AS n, (length(x) - length(replace(x, phrase, ''))) // length(phrase) = 1 AS ok FROM t, (SELECT unnest(['of the', 'in der']) AS phrase)""",
    "v_segments",
)
def e2_anchor_counts(spark, d):
    return quality.anchor_counts(_segments(spark, d), ["of the", "in der"])


@query(
    """+ c AS (SELECT tid, start_ms + 2400 AS s FROM v_segments WHERE segment_index % 3 = 0)
    SELECT tid, count(DISTINCT start_ms) AS starts, count(DISTINCT start_ms) FILTER (WHERE EXISTS (SELECT 1 FROM c WHERE c.tid = v.tid AND abs(c.s - v.start_ms) <= 2500)) AS found FROM v_segments v GROUP BY tid""",
    "v_segments",
)
def e3_boundary_recall(spark, d):
    s = _segments(spark, d)
    return quality.boundary_recall(s, s.where("segment_index % 3 = 0").withColumn("start_ms", F.col("start_ms") + 2400))


@query(
    """+ b AS (SELECT tid, segment_index, start_ms + (segment_index % 5) * 100 AS s, end_ms AS e FROM v_segments WHERE segment_index <> 4)
    SELECT coalesce(a.tid, b.tid) AS tid, count(a.start_ms) AS n_a, count(b.s) AS n_b, count(*) FILTER (WHERE abs(a.start_ms - b.s) > 250 OR abs(a.end_ms - b.e) > 250) AS n_far
    FROM v_segments a FULL JOIN b ON a.tid = b.tid AND a.segment_index = b.segment_index GROUP BY 1""",
    "v_segments",
)
def e4_run_consistency(spark, d):
    s = _segments(spark, d)
    other = s.where("segment_index <> 4").withColumn("start_ms", F.col("start_ms") + (F.col("segment_index") % 5) * 100)
    return quality.run_consistency(s, other)


def _codec_sql(name: str, k: int) -> str:
    return f"CAST(sum(CASE WHEN l_linenumber % 3 = {k} THEN l_orderkey END) AS BIGINT) AS {name}, CAST(sum(CASE WHEN l_linenumber % 3 = {k} THEN l_partkey % 90 END) AS BIGINT) AS {name}_ms"


@query(f"""WITH x AS (SELECT l_suppkey AS fixture, {_codec_sql("wav", 0)}, {_codec_sql("flac", 1)}, {_codec_sql("opus", 2)} FROM lineitem GROUP BY l_suppkey)
  SELECT *, flac * 1000 // wav AS flac_permille, opus * 1000 // wav AS opus_permille FROM x""")
def e5_codec_sizes(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    kind = F.element_at(F.array(F.lit("wav"), F.lit("flac"), F.lit("opus")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    measured = rows.select(F.col("l_suppkey").alias("fixture"), kind.alias("format"), F.col("l_orderkey").alias("bytes"), (F.col("l_partkey") % 90).alias("elapsed_ms"))
    return quality.codec_sizes(measured, ["wav", "flac", "opus"])


@query("SELECT tid, count(*) AS n, greatest(count(*) FILTER (WHERE label % 2 = window_id % 2), count(*) FILTER (WHERE label % 2 <> window_id % 2)) AS correct FROM v_vectors GROUP BY tid", "v_vectors")
def e6_diarization_accuracy(spark, d):
    return quality.diarization_accuracy(view(spark, d, "v_vectors").select("tid", (F.col("label") % 2).cast("long").alias("truth"), (F.col("window_id") % 2).alias("guess")))


TURNS = "turns AS (SELECT concat('u', l_suppkey) AS tid, l_orderkey * 977 % 9000000 AS start_ms, l_orderkey * 977 % 9000000 + 500 + l_linenumber * 700 AS end_ms, l_partkey % 4 AS speaker FROM lineitem)"


@query(f"""WITH {TURNS}, t AS (SELECT *, row_number() OVER (ORDER BY tid, start_ms, end_ms, speaker) AS k FROM turns),
  alone AS (SELECT * FROM t a WHERE end_ms - start_ms >= 2000 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.tid = a.tid AND b.k <> a.k AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms)),
  top AS (SELECT tid, speaker, row_number() OVER (PARTITION BY tid ORDER BY count(*) DESC, speaker) AS r FROM alone GROUP BY tid, speaker)
  SELECT a.tid, a.speaker, a.start_ms, a.end_ms FROM alone a JOIN top ON a.tid = top.tid AND a.speaker = top.speaker WHERE r <= 2""")
def e7_nonoverlapping_turns(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    start = F.col("l_orderkey") * 977 % 9_000_000
    turns = rows.select(F.concat(F.lit("u"), "l_suppkey").alias("tid"), start.alias("start_ms"), (start + 500 + F.col("l_linenumber") * 700).alias("end_ms"), (F.col("l_partkey") % 4).alias("speaker"))
    return quality.nonoverlapping_turns(turns).select("tid", "speaker", "start_ms", "end_ms")


# --- voice activity and audio ----------------------------------------------------------------

REGIONS = """+ f AS (SELECT tid, CAST(frame AS BIGINT) * 512 AS pos, p100 >= 50 AS hi, p100 < 35 AS lo, sum(CASE WHEN p100 >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY frame) AS ep FROM v_frames),
e AS (SELECT tid, ep, min(pos) FILTER (WHERE hi) AS s, min(pos) FILTER (WHERE lo) AS sil, max(pos) FILTER (WHERE lo) AS last FROM f WHERE ep > 0 GROUP BY tid, ep),
c AS (SELECT *, coalesce(last - sil >= 1600, false) AS closed FROM e),
i AS (SELECT *, coalesce(sum(CAST(closed AS INT)) OVER (PARTITION BY tid ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM c),
r AS (SELECT i.tid, min(s) AS start, coalesce(max(CASE WHEN closed THEN sil END), first(audio_len)) AS "end" FROM i JOIN v_vad_len l ON l.tid = i.tid GROUP BY i.tid, island),
regions AS (SELECT tid, start, CAST("end" AS BIGINT) AS "end" FROM r WHERE "end" - start >= 3200)"""


ALL_REGIONS = REGIONS.replace("v_frames", "v_all_frames").replace("v_vad_len", "v_all_vad_len")
PADDED = """, p AS (SELECT g.tid, greatest(start - 1920, 0) AS s, least("end" + 1920, audio_len) AS e FROM regions g JOIN v_all_vad_len l ON l.tid = g.tid),
  b AS (SELECT *, max(e) OVER (PARTITION BY tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM p),
  n AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY s, e) AS k FROM b)
  SELECT tid, min(s) AS start, max(e) AS "end" FROM n GROUP BY tid, k"""


def _frames(spark, d, every: str = "v"):
    frames = view(spark, d, f"{every}_frames").select("tid", F.lit("file").alias("track"), "frame", (F.col("p100") / 100).alias("prob"))
    return frames, view(spark, d, f"{every}_vad_len").select("tid", F.lit("file").alias("track"), F.col("audio_len").cast("long").alias("audio_len"))


@query(REGIONS + 'SELECT tid, start, "end" FROM regions', "v_frames", "v_vad_len")
def v2_speech_regions(spark, d):
    return vad.speech_regions(*_frames(spark, d)).select("tid", "start", "end")


@query(REGIONS + """, p AS (SELECT g.tid, greatest(start - 1920, 0) AS s, least("end" + 1920, audio_len) AS e FROM regions g JOIN v_vad_len l ON l.tid = g.tid),
  b AS (SELECT *, max(e) OVER (PARTITION BY tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM p),
  n AS (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY tid ORDER BY s, e) AS k FROM b)
  SELECT tid, min(s) AS start, max(e) AS "end" FROM n GROUP BY tid, k""", "v_frames", "v_vad_len")
def v3_padded_regions(spark, d):
    frames, lengths = _frames(spark, d)
    return vad.pad_and_merge_regions(vad.speech_regions(frames, lengths), lengths).select("tid", "start", "end")


@query()
def v4_chunks(spark, d):
    frames, lengths = _frames(spark, d)
    return vad.chunk_regions(vad.pad_and_merge_regions(vad.speech_regions(frames, lengths), lengths))


@query(ALL_REGIONS + 'SELECT tid, start, "end" FROM regions', "v_all_frames", "v_all_vad_len")
def v2_all_speech_regions(spark, d):
    return vad.speech_regions(*_frames(spark, d, "v_all")).select("tid", "start", "end")


@query(ALL_REGIONS + PADDED, "v_all_frames", "v_all_vad_len")
def v3_all_padded_regions(spark, d):
    frames, lengths = _frames(spark, d, "v_all")
    return vad.pad_and_merge_regions(vad.speech_regions(frames, lengths), lengths).select("tid", "start", "end")


PACKETS = "+ p AS (SELECT session_id AS session, track_id AS track, arrival, n, coalesce(sum(n) OVER (PARTITION BY session_id, track_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due FROM v_blocks)"


@query(PACKETS + "SELECT session, track, count(*) AS packets, CAST(sum(greatest(48000 - due, 0) * 1000 // 48000) AS BIGINT) AS gap_ms, count(*) FILTER (WHERE greatest(48000 - due, 0) > 24000) AS resyncs FROM p GROUP BY session, track", "v_blocks")
def a7_gap_diagnostics(spark, d):
    return audio.gap_diagnostics(view(spark, d, "v_blocks").select(F.col("session_id").alias("session"), F.col("track_id").alias("track"), "arrival", "n", F.lit(1.0).alias("offset_s")))


@query("""+ o AS (SELECT session_id, min_by(arrival * 1000, arrival) FILTER (WHERE arrival > 0) AS origin FROM v_blocks GROUP BY 1)
  SELECT b.session_id AS session, track_id AS track, (min(arrival * 1000) - first(origin)) / 10000000.0::DOUBLE AS offset_s FROM v_blocks b JOIN o ON o.session_id = b.session_id WHERE arrival * 1000 >= origin GROUP BY 1, 2""", "v_blocks")
def a6_track_offsets(spark, d):
    return audio.track_start_offset(view(spark, d, "v_blocks").select(F.col("session_id").alias("session"), F.col("track_id").alias("track"), "arrival", (F.col("arrival") * 1000).alias("ticks")))


@query("""+ q AS (SELECT session_id AS tid, track_id AS track, seq, n, seq * 480 + CASE WHEN seq > 20 THEN 1 ELSE 0 END AS start, coalesce(sum(480) OVER (PARTITION BY session_id, track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due FROM v_blocks)
  SELECT tid, track, count(*) * 480 AS n, coalesce(min(seq) FILTER (WHERE start <> due), -1) AS first_gap FROM q GROUP BY tid, track""", "v_blocks")
def a10_assemble_contiguous(spark, d):
    b = view(spark, d, "v_blocks")
    found = audio.assemble_contiguous(b.select(F.col("session_id").alias("tid"), F.col("track_id").alias("track"), "seq", F.lit(480).cast("long").alias("n"), (F.col("seq") * 480 + F.when(F.col("seq") > 20, 1).otherwise(0)).alias("start")))
    return found.withColumn("first_gap", F.coalesce("first_gap", F.lit(-1)).cast("long"))


# --- speakers --------------------------------------------------------------------------------

@query("""+ w AS (SELECT tid, segment_index, start_ms * 16000 // 1000 AS s, end_ms * 16000 // 1000 AS e FROM v_segments WHERE end_ms > start_ms),
  x AS (SELECT tid, segment_index, s + k * 48000 AS start, least(s + (k + 1) * 48000, e) AS "end" FROM (SELECT *, unnest(range((e - s - 1) // 48000 + 1)) AS k FROM w))
  SELECT * FROM x WHERE "end" - start >= 8000""", "v_segments")
def d1_segment_windows(spark, d):
    return speakers.segment_windows(_segments(spark, d), 16_000)


@query("""+ c AS (SELECT tid, segment_index, label, count(*) AS n FROM v_vectors GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tid, segment_index ORDER BY n DESC, label DESC) AS k FROM c)
  SELECT tid, segment_index, 'Speaker ' || (label + 1) AS speaker, n FROM r WHERE k = 1""", "v_vectors")
def d8_dominant_speaker(spark, d):
    return speakers.dominant_speaker(view(spark, d, "v_vectors").select("tid", "segment_index", "label"))


@query("""+ t AS (SELECT tid, segment_index % 3 AS speaker, start_ms + 300 AS s, end_ms + 300 AS e FROM v_segments WHERE segment_index % 2 = 0),
  o AS (SELECT v.tid, v.segment_index, v.end_ms - v.start_ms AS len, t.speaker, sum(least(v.end_ms, e) - greatest(v.start_ms, s)) AS n FROM v_segments v JOIN t ON t.tid = v.tid AND least(v.end_ms, e) > greatest(v.start_ms, s) WHERE v.end_ms > v.start_ms GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY tid, segment_index ORDER BY n DESC, speaker DESC) AS r, coalesce(lead(n) OVER (PARTITION BY tid, segment_index ORDER BY n DESC, speaker DESC), 0) AS second FROM o)
  SELECT tid, segment_index, speaker FROM k WHERE r = 1 AND n * 2 >= len AND second * 5 < n * 4""", "v_segments")
def d9_match_speakers(spark, d):
    s = _segments(spark, d)
    turns = s.where("segment_index % 2 = 0").select("tid", (F.col("segment_index") % 3).alias("speaker"), (F.col("start_ms") + 300).alias("start"), (F.col("end_ms") + 300).alias("end"))
    return speakers.match_speakers(s, turns)


@query()
def d5_cluster_auto(spark, d):
    return speakers.cluster(view(spark, d, "v_recording_vectors"), "auto")


def _linkage_sql(windows: int = 10, least: float = 0.58) -> str:
    """Clusters of recordings of at most ``windows`` windows: each merger and each lone vector is a step of its own."""
    steps = ["""+ unit AS MATERIALIZED (SELECT tid, window_id AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda v: v / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM v_short_recordings),
  sim AS MATERIALIZED (SELECT x.tid, x.a, y.a AS b, list_inner_product(x.e, y.e) AS s FROM unit x JOIN unit y ON x.tid = y.tid),
  g0 AS MATERIALIZED (SELECT tid, a, a AS g FROM unit)"""]
    for k in range(windows - 1):
        steps.append(f"""
  m{k} AS MATERIALIZED (SELECT x.tid, x.g, y.g AS h, round(avg(s), 12) AS s FROM g{k} x JOIN g{k} y ON x.tid = y.tid AND x.g < y.g JOIN sim ON sim.tid = x.tid AND sim.a = x.a AND sim.b = y.a GROUP BY ALL),
  w{k} AS MATERIALIZED (SELECT * FROM m{k} WHERE s >= {least} QUALIFY row_number() OVER (PARTITION BY tid ORDER BY s DESC, g, h) = 1),
  g{k + 1} AS MATERIALIZED (SELECT x.tid, x.a, coalesce(w.g, x.g) AS g FROM g{k} x LEFT JOIN w{k} w ON w.tid = x.tid AND w.h = x.g)""")
    last = windows - 1
    steps.append(f"\n  l0 AS MATERIALIZED (SELECT tid, a, g FROM g{last})")
    for k in range(windows - 2):
        steps.append(f"""
  n{k} AS MATERIALIZED (SELECT tid, g, count(*) AS n FROM l{k} GROUP BY ALL),
  o{k} AS MATERIALIZED (SELECT tid, min(g) AS lone FROM n{k} WHERE n = 1 GROUP BY tid),
  t{k} AS MATERIALIZED (
    SELECT o.tid, o.lone, x.g FROM o{k} o JOIN n{k} n ON n.tid = o.tid AND n.n > 1 JOIN l{k} x ON x.tid = o.tid AND x.g = n.g JOIN sim ON sim.tid = o.tid AND sim.a = o.lone AND sim.b = x.a
    GROUP BY o.tid, o.lone, x.g QUALIFY row_number() OVER (PARTITION BY o.tid ORDER BY round(avg(s), 12) DESC, x.g DESC) = 1),
  l{k + 1} AS MATERIALIZED (SELECT x.tid, x.a, coalesce(t.g, x.g) AS g FROM l{k} x LEFT JOIN t{k} t ON t.tid = x.tid AND t.lone = x.g)""")
    return ",".join(steps) + f""",
  clusters AS (SELECT tid, a AS window_id, CAST(dense_rank() OVER (PARTITION BY tid ORDER BY first) - 1 AS INT) AS speaker, 'ok' AS status FROM (SELECT *, min(a) OVER (PARTITION BY tid, g) AS first FROM l{windows - 2}))"""


LINKAGE = _linkage_sql()


@query(LINKAGE + " SELECT * FROM clusters", "v_short_recordings")
def d5_cluster_short(spark, d):
    return speakers.cluster(view(spark, d, "v_short_recordings"), "auto")


@query()
def d6_cluster_k(spark, d):
    return speakers.cluster(view(spark, d, "v_recording_vectors"), "k", 3)


@query()
def d7_cluster_two(spark, d):
    return speakers.cluster(view(spark, d, "v_recording_vectors"), "two")


@query("SELECT tid, count(*) * (count(*) - 1) // 2 AS pairs FROM v_vectors GROUP BY tid", "v_vectors")
def d10_pair_counts(spark, d):
    return speakers.pairwise_cosine(view(spark, d, "v_vectors")).groupBy("tid").agg(F.count("similarity").alias("pairs"))


@query("""SELECT x.tid, x.window_id AS a, y.window_id AS b, CAST(round(1000 * list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))) AS BIGINT) AS permille
  FROM v_recording_vectors x JOIN v_recording_vectors y ON x.tid = y.tid AND x.window_id < y.window_id""", "v_recording_vectors")
def d10_pairwise_cosine(spark, d):
    return speakers.pairwise_cosine(view(spark, d, "v_recording_vectors")).select("tid", "a", "b", F.round(F.col("similarity") * 1000).cast("long").alias("permille"))


@query("""+ x AS (SELECT window_id, CASE WHEN window_id % 5 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda v: 0.0::DOUBLE) ELSE CAST(embedding AS DOUBLE[]) END AS e FROM v_vectors)
  SELECT window_id, window_id % 5 <> 0 AS ok, CASE WHEN window_id % 5 <> 0 THEN CAST(round(1000 * list_sum(list_transform(e, lambda v: v / sqrt(list_inner_product(e, e))))) AS BIGINT) ELSE 0 END AS total FROM x""", "v_vectors")
def d4_normalize(spark, d):
    zero = F.transform("embedding", lambda v: F.lit(0.0).cast("float"))
    rows = view(spark, d, "v_vectors").withColumn("embedding", F.when(F.col("window_id") % 5 == 0, zero).otherwise(F.col("embedding")))
    total = F.round(F.aggregate("unit", F.lit(0.0), lambda a, v: a + v) * 1000).cast("long")
    return speakers.normalize_vectors(rows).select("window_id", "ok", F.coalesce(total, F.lit(0)).alias("total"))


# --- journal, archives, snapshots --------------------------------------------------------------

def _changes(spark, d):
    return view(spark, d, "v_changes")


@query("SELECT session_id, change_id, arrival, revision, deleted, payload FROM (SELECT *, row_number() OVER (PARTITION BY session_id, change_id ORDER BY revision DESC, arrival) AS k FROM v_changes) WHERE k = 1", "v_changes")
def j1_upsert_segments(spark, d):
    return journal.upsert_segments(_changes(spark, d))


@query("SELECT session_id, change_id, arrival, revision FROM (SELECT *, max(revision) OVER (PARTITION BY session_id, change_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v_changes) WHERE b IS NULL OR revision > b", "v_changes")
def j1_journal(spark, d):
    return journal.journal_entries(_changes(spark, d)).select("session_id", "change_id", "arrival", "revision")


@query("SELECT session_id, change_id, arrival FROM v_changes WHERE revision > CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 2 = 0 THEN 30 ELSE -1 END", "v_changes")
def j2_changes_since(spark, d):
    c = _changes(spark, d)
    cursors = c.select("session_id").distinct().where(F.substring("session_id", 2, 99).cast("long") % 2 == 0).withColumn("cursor", F.lit(30))
    return journal.changes_since(c, cursors).select("session_id", "change_id", "arrival")


@query("""+ u AS (SELECT *, 1 AS side FROM v_changes WHERE arrival % 2 = 0 UNION ALL SELECT *, 0 FROM v_changes WHERE arrival % 2 = 1)
  SELECT session_id, change_id, arrival, revision, deleted FROM (SELECT *, row_number() OVER (PARTITION BY session_id, change_id ORDER BY revision DESC, side DESC, arrival) AS k FROM u) WHERE k = 1""", "v_changes")
def j3_sync_merge(spark, d):
    c = _changes(spark, d)
    return journal.sync_merge(c.where("arrival % 2 = 0"), c.where("arrival % 2 = 1")).select("session_id", "change_id", "arrival", "revision", "deleted")


@query("SELECT tid, segment_index, CASE WHEN segment_index % 4 = 0 THEN 'new' ELSE text END AS text, segment_index % 4 = 0 AS applied FROM v_segments", "v_segments")
def j4_conditional_edits(spark, d):
    s = _segments(spark, d)
    edits = s.where("segment_index % 2 = 0").select("tid", "segment_index", F.when(F.col("segment_index") % 4 == 0, F.col("text")).otherwise("other").alias("expected"), F.lit("new").alias("new_text"))
    return journal.conditional_edits(s.select("tid", "segment_index", "text"), edits)


@query("""+ g AS (SELECT tid, bool_and(segment_index <> 2) AS ok, min(segment_index) AS f FROM v_segments WHERE segment_index IN (0, 2, 3) GROUP BY tid)
  SELECT s.tid, segment_index, CASE WHEN ok AND segment_index IN (0, 2, 3) THEN CASE WHEN segment_index = f THEN 'joined' ELSE '' END ELSE text END AS text FROM v_segments s LEFT JOIN g ON g.tid = s.tid""", "v_segments")
def j5_group_edits(spark, d):
    s = _segments(spark, d).select("tid", "segment_index", "text")
    edits = s.where("segment_index in (0, 2, 3)").select(F.col("tid").alias("request"), "tid", "segment_index", F.when(F.col("segment_index") == 2, "stale").otherwise(F.col("text")).alias("expected"), F.lit("joined").alias("new_text"))
    return journal.group_edits(s, edits).select("tid", "segment_index", "text")


@query("""+ b AS (SELECT tid FROM v_segments WHERE segment_index = 3 AND tid LIKE '%1')
  SELECT s.tid, segment_index, CASE WHEN s.tid IN (SELECT tid FROM b) THEN speaker_id ELSE 'S' END AS speaker_id FROM v_segments s""", "v_segments")
def j6_set_speakers(spark, d):
    s = _segments(spark, d)
    stale = (F.col("segment_index") == 3) & F.col("tid").endswith("1")
    wanted = s.select("tid", "segment_index", F.when(stale, "x").otherwise(F.col("text")).alias("text"), "start_ms", "end_ms", F.col("speaker_id").alias("old_speaker"), F.lit("S").alias("new_speaker"))
    return journal.set_speakers_if_unchanged(s, wanted).select("tid", "segment_index", "speaker_id")


@query("SELECT tid, segment_index, CASE WHEN tid = 'c3' AND source_track = 'microphone' AND speaker_id IS NULL THEN 'Ann' ELSE speaker_id END AS speaker_id FROM v_segments", "v_segments")
def j7_rename_speaker(spark, d):
    return journal.rename_speaker(_segments(spark, d), "c3", "microphone", None, "Ann").select("tid", "segment_index", "speaker_id")


@query("SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents")
def j8_verify_checksums(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("payload"))
    digest = F.when(F.col("doc_id") % 3 == 0, "0" * 64).otherwise(F.upper(F.sha2("payload", 256)))
    return journal.verify_checksums(rows.withColumn("sha256", digest)).select("doc_id", "valid")


@query("""+ o AS (SELECT DISTINCT session_id, track_id, seq FROM v_blocks), p AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY seq) - 1 AS k FROM o)
  SELECT session_id, track_id, coalesce(max(seq) FILTER (WHERE seq = k), -1) AS durable, count(*) AS stored FROM p GROUP BY ALL""", "v_blocks")
def j9_durable_prefix(spark, d):
    return journal.durable_prefix(view(spark, d, "v_blocks")).drop("duplicates")


@query("""+ o AS (SELECT *, row_number() OVER (PARTITION BY session_id, track_id ORDER BY seq) - 1 AS k FROM v_blocks), c AS (SELECT session_id, track_id, coalesce(max(seq) FILTER (WHERE seq = k), -1) AS durable FROM o GROUP BY ALL)
  SELECT b.session_id, b.track_id, seq, CAST(row_number() OVER (PARTITION BY b.session_id ORDER BY b.track_id, seq) AS INT) AS place FROM v_blocks b JOIN c ON b.session_id = c.session_id AND b.track_id = c.track_id WHERE seq > durable""", "v_blocks")
def j10_pending_replay(spark, d):
    b = view(spark, d, "v_blocks")
    return journal.pending_replay(b, journal.durable_prefix(b)).select("session_id", "track_id", "seq", "place")


@query('SELECT session_id, track_id, seq, CAST(coalesce(sum(n) OVER (PARTITION BY session_id, track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", true AS valid FROM v_blocks', "v_blocks")
def j11_archive_ranges(spark, d):
    return journal.archive_ranges(view(spark, d, "v_blocks").withColumnRenamed("n", "bytes")).select("session_id", "track_id", "seq", "offset", "valid")


@query("SELECT session_id, count(*) AS tracks, CAST(sum(b) AS BIGINT) AS bytes, CAST(max(b) AS BIGINT) AS duration FROM (SELECT session_id, track_id, sum(n) AS b FROM v_blocks GROUP BY ALL) GROUP BY session_id", "v_blocks")
def j12_finalize_archive(spark, d):
    return journal.finalize_archive(view(spark, d, "v_blocks").withColumn("bytes", F.col("n")))


def _snapshots(spark, d):
    return view(spark, d, "v_snapshots")


USED = "+ used AS (SELECT original_id, parent_revision AS r FROM v_snapshots WHERE parent_revision IS NOT NULL UNION SELECT original_id, merge_a FROM v_snapshots WHERE merge_a IS NOT NULL UNION SELECT original_id, merge_b FROM v_snapshots WHERE merge_b IS NOT NULL), heads AS (SELECT original_id, revision FROM v_snapshots s WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.original_id = s.original_id AND u.r = s.revision)) "


@query(USED + "SELECT original_id, revision FROM heads", "v_snapshots")
def j22_conflict_heads(spark, d):
    return snapshots.conflict_heads(_snapshots(spark, d))


@query(USED + "SELECT s.original_id, s.revision, h.revision IS NOT NULL AS is_head, h.revision IS NOT NULL AND n > 1 AS concurrent FROM v_snapshots s LEFT JOIN heads h ON h.original_id = s.original_id AND h.revision = s.revision LEFT JOIN (SELECT original_id, count(*) AS n FROM heads GROUP BY 1) k ON k.original_id = s.original_id", "v_snapshots")
def j23_snapshot_branches(spark, d):
    return snapshots.snapshot_branches(_snapshots(spark, d))


@query(USED + """, c AS (SELECT original_id, count(*) > 1 AS conflict FROM heads GROUP BY 1), l AS (SELECT *, CASE CAST(substr(revision, 2) AS BIGINT) % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'legacy' WHEN 2 THEN 'none' ELSE revision END AS r FROM v_snapshots)
  SELECT l.revision AS id, CASE WHEN trim(r) = '' OR r = 'legacy' THEN 'unknown' WHEN conflict THEN 'conflict' WHEN r = 'none' THEN 'unknown' ELSE 'revision-found' END AS presence FROM l JOIN c ON c.original_id = l.original_id""", "v_snapshots")
def j24_drive_presence(spark, d):
    s = _snapshots(spark, d)
    k = F.substring("revision", 2, 99).cast("long") % 5
    known = F.when(k == 0, " ").when(k == 1, "legacy").when(k == 2, "none").otherwise(F.col("revision"))
    local = s.select(F.col("revision").alias("id"), "original_id", known.alias("revision"))
    return snapshots.drive_presence(local, snapshots.snapshot_branches(s))


@query(USED + """, h AS (SELECT original_id, count(*) AS n FROM heads GROUP BY 1)
  SELECT original_id, CASE CAST(substr(original_id, 2) AS BIGINT) % 3 WHEN 0 THEN n BETWEEN 2 AND 32 WHEN 1 THEN false ELSE (SELECT count(*) FROM v_snapshots s WHERE s.original_id = h.original_id) BETWEEN 2 AND 32 AND n > 1 AND n = (SELECT count(*) FROM v_snapshots s WHERE s.original_id = h.original_id) END AS ok FROM h""", "v_snapshots")
def j25_merge_selection(spark, d):
    # By original: all heads, all heads twice, or all revisions.
    s = _snapshots(spark, d)
    k = F.substring("original_id", 2, 99).cast("long") % 3
    heads = snapshots.conflict_heads(s)
    chosen = heads.where(k == 0).union(heads.where(k == 1)).union(heads.where(k == 1)).union(s.where(k == 2).select("original_id", "revision"))
    return snapshots.validate_merge_selection(chosen, snapshots.snapshot_branches(s))


@query("""SELECT concat('k', o_custkey) AS original_id, 'blank' AS reason FROM orders WHERE o_custkey % 10 = 1 GROUP BY 1
  UNION ALL SELECT concat('k', o_custkey), 'duplicate' FROM orders WHERE o_custkey % 10 = 2 GROUP BY o_custkey
  UNION ALL SELECT concat('k', o_custkey), 'cycle' FROM orders WHERE o_custkey % 10 = 3 GROUP BY o_custkey HAVING count(*) > 1""")
def j21_revision_graph(spark, d):
    # By original: a blank revision, one with two contents, the first revision below the last one, or whole.
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey")
    k, w = F.col("o_custkey") % 10, W.partitionBy("o_custkey")
    revision = F.concat(F.lit("o"), "o_orderkey")
    parent = F.concat(F.lit("o"), F.lag("o_orderkey").over(w.orderBy("o_orderkey")))
    last = F.concat(F.lit("o"), F.max("o_orderkey").over(w))
    s = o.select(
        "o_orderkey", k.alias("k"), F.concat(F.lit("k"), "o_custkey").alias("original_id"), F.when(k == 1, " ").otherwise(revision).alias("revision"),
        F.when((k == 3) & parent.isNull() & (last != revision), last).otherwise(parent).alias("parent_revision"), F.lit(None).cast("string").alias("merge_a"), F.lit(None).cast("string").alias("merge_b"),
    )
    again = s.where("k = 2").withColumn("manifest", F.lit("other"))
    return snapshots.validate_revision_graph(s.withColumn("manifest", F.lit("one")).unionByName(again))


@query("""SELECT o_custkey AS owner, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS pending, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS uploading, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS synced, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS auth_required FROM orders GROUP BY o_custkey""")
def j18_outbox_status(spark, d):
    return snapshots.outbox_status(_outbox(spark, d))


def _outbox(spark, d):
    state = F.element_at(F.array(*[F.lit(s) for s in snapshots.STATES]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("owner"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("payload"), state.alias("state"), (F.col("o_orderkey") % 12).cast("int").alias("attempts"), ((F.col("o_orderkey") * 31) % 5000).alias("next_ms"), F.col("o_orderkey").alias("k"))


@query("""SELECT owner, id, CAST(r AS INT) AS rank FROM (SELECT o_custkey AS owner, concat('o', o_orderkey) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 31) % 5000, concat('o', o_orderkey)) AS r FROM orders WHERE o_orderkey % 4 < 2 AND (o_orderkey * 31) % 5000 <= 2500) WHERE r <= 3""")
def j16_due_jobs(spark, d):
    return snapshots.due_jobs(_outbox(spark, d), 2500, 3).select("owner", "id", "rank")


@query("""+ q AS (SELECT *, o_orderkey % 5 AS k, CAST(o_orderkey % 12 AS INT) AS a, o_orderkey % 7 = 0 AS twice FROM orders), r AS (SELECT *, k = 0 OR (k < 4 AND twice) AS ok, k BETWEEN 1 AND 3 AND NOT twice AS failed FROM q)
  SELECT concat('o', o_orderkey) AS id, CASE WHEN ok THEN 'synced' WHEN failed AND k < 3 THEN 'auth_required' WHEN failed THEN 'pending' ELSE ['pending', 'uploading', 'synced', 'auth_required'][CAST(o_orderkey % 4 + 1 AS INT)] END AS state,
  CAST(a + CASE WHEN failed THEN 1 ELSE 0 END AS INT) AS attempts, CASE WHEN failed THEN 1000 + least(1000 * CAST(pow(2, least(a + 1, 10)) AS BIGINT), 900000) ELSE (o_orderkey * 31) % 5000 END AS next_ms FROM r""".replace("+ q", "WITH q", 1))
def j17_upload_results(spark, d):
    q = _outbox(spark, d)
    k = F.col("k") % 5
    error = F.when(k == 1, "token expired").when(k == 2, "Connect Google Drive first").when(k == 3, "Revoked or 401 auth token")
    results = q.where("k % 5 < 4").select("id", (k == 0).alias("ok"), error.alias("error"))
    # Seven orders on, a second result: a success counts.
    second = q.where("k % 5 < 4 and k % 7 = 0").select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return snapshots.apply_upload_results(q, results.unionByName(second), 1000).select("id", "state", "attempts", "next_ms")


@query("SELECT concat('o', o_orderkey) AS id, CASE o_orderkey % 4 WHEN 2 THEN 'synced' ELSE 'pending' END AS state, CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 3 THEN 0 ELSE (o_orderkey * 31) % 5000 END AS next_ms FROM orders")
def j17_resume_and_recover(spark, d):
    return snapshots.recover_uploads(snapshots.resume_after_sign_in(_outbox(spark, d))).select("id", "state", "next_ms")


@query("""WITH n AS (SELECT l_suppkey AS owner, concat('p', l_partkey) AS id, min(l_orderkey * 10 + l_linenumber) AS arrival FROM lineitem GROUP BY 1, 2),
  old AS (SELECT owner, id, arrival % 3 = 0 AS synced FROM n WHERE arrival % 4 = 0),
  used AS (SELECT owner, count(*) AS used FROM old WHERE NOT synced GROUP BY owner),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY arrival, id) AS r FROM n WHERE arrival % 4 <> 0)
  SELECT f.owner, id, arrival AS payload FROM fresh f LEFT JOIN used u ON u.owner = f.owner WHERE r + coalesce(used, 0) <= 100""")
def j15_enqueue_outbox(spark, d):
    # A quarter of the ids is in the queue, a third of those synced.
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    new = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("owner"), F.concat(F.lit("p"), "l_partkey").alias("id"), at.alias("payload"), at.alias("arrival"))
    first = new.groupBy("owner", "id").agg(F.min("arrival").alias("arrival"))
    queue = first.where("arrival % 4 = 0").select("owner", "id", F.when(F.col("arrival") % 3 == 0, "synced").otherwise("pending").alias("state"))
    return snapshots.enqueue_outbox(queue, new, 100).select("owner", "id", "payload")


# The other modules of queries register theirs when they are imported.
from voxloom.plans import audio_queries, state_queries  # noqa: E402, F401
