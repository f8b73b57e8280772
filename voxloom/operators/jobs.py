"""Job states, history and search. Jobs have id, kind, source_filename, status, owner (pool), arrival and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.columns import like_ascii

ACTIVE = ("preparing", "transcribing")
TERMINAL = ("completed", "cancelled", "failed", "interrupted")
#: Fixed table of allowed changes of status.
TRANSITIONS = (
    ("queued", "preparing"), ("queued", "cancelled"), ("preparing", "transcribing"), ("preparing", "failed"), ("preparing", "cancelled"),
    ("preparing", "interrupted"), ("transcribing", "completed"), ("transcribing", "failed"), ("transcribing", "cancelled"), ("transcribing", "interrupted"),
    ("failed", "queued"), ("cancelled", "queued"), ("interrupted", "queued"), ("completed", "queued"),
)
CHUNK_SECONDS = 22
#: Fixed text of the error of an interrupted job.
STOPPED = "Application stopped during transcription"


def history(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_ms").desc(), "arrival")


def queue_view(jobs: DataFrame) -> DataFrame:
    return jobs.where("queue_visible").orderBy("created_ms", "arrival")


def claim_next(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The next ``n`` startable file jobs of every pool that isn't busy."""
    busy = jobs.where(F.col("status").isin(*ACTIVE)).select("owner").distinct()
    ready = jobs.where("queue_visible and kind = 'file' and status = 'queued' and start_requested").join(busy, "owner", "left_anti")
    rank = F.row_number().over(W.partitionBy("owner").orderBy("created_ms", "arrival"))
    return ready.withColumn("rank", rank).where(F.col("rank") <= n)


def validate_transitions(changes: DataFrame) -> DataFrame:
    """Adds ``allowed`` to status changes (id, seq, status); the first status of a job must be queued."""
    before = F.lag("status").over(W.partitionBy("id").orderBy("seq"))
    rows = changes.withColumn("before", before)
    pair = F.concat_ws(">", "before", "status")
    allowed = F.when(F.col("before").isNull(), F.col("status") == "queued").otherwise(pair.isin(*[f"{a}>{b}" for a, b in TRANSITIONS]))
    return rows.withColumn("allowed", allowed)


def apply_transitions(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """Applies the latest command (id, target, at_ms, error) of each job if its change is allowed."""
    latest = commands.groupBy("id").agg(F.max_by(F.struct("target", "at_ms", "error"), F.struct("at_ms", "target")).alias("c"))
    rows = jobs.join(latest, "id", "left")
    go = F.concat_ws(">", "status", "c.target").isin(*[f"{a}>{b}" for a, b in TRANSITIONS]) & F.col("c").isNotNull()
    target = F.when(go, F.col("c.target"))
    out = rows.withColumn("to", target)
    done = F.col("to").isin(*TERMINAL)
    return out.select(
        *[c for c in jobs.columns if c not in ("status", "started_ms", "completed_ms", "error")],
        F.coalesce("to", "status").alias("status"),
        F.when(F.col("to") == "preparing", F.col("c.at_ms")).when(F.col("to") == "queued", F.lit(None)).otherwise(F.col("started_ms")).alias("started_ms"),
        F.when(done, F.col("c.at_ms")).when(F.col("to").isin("queued", "preparing"), F.lit(None)).otherwise(F.col("completed_ms")).alias("completed_ms"),
        F.when(F.col("to") == "failed", F.col("c.error")).when(F.col("to").isNotNull(), F.lit(None)).otherwise(F.col("error")).alias("error"),
    )


def apply_cancel(jobs: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """Queued jobs of ``ids`` are cancelled and end at ``now_ms``; active ones get a request; others stay as they are."""
    rows = jobs.join(ids.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    asked = F.coalesce("asked", F.lit(False))
    queued, active = asked & (F.col("status") == "queued"), asked & F.col("status").isin(*ACTIVE)
    return rows.withColumns({
        "cancel_requested": F.col("cancel_requested") | active, "completed_ms": F.when(queued, F.lit(now_ms).cast("long")).otherwise(F.col("completed_ms")),
        "status": F.when(queued, "cancelled").otherwise(F.col("status")),
    }).drop("asked")


def acknowledge_cancel(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Active jobs with a request are cancelled and end at ``now_ms``; their request is cleared."""
    hit = F.coalesce(F.col("cancel_requested") & F.col("status").isin(*ACTIVE), F.lit(False))
    return jobs.withColumns({
        "status": F.when(hit, "cancelled").otherwise(F.col("status")), "completed_ms": F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("completed_ms")),
        "cancel_requested": F.col("cancel_requested") & ~hit,
    })


def complete_or_fail(jobs: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """Results (id, ok, error, duration_seconds) end a job that is transcribing and not asked to cancel; ``applied`` says so.

    A completed job takes its duration and loses its error; a failed one takes the error. Of several
    results of a job, a success counts, else the last error by its text.
    """
    one = results.groupBy("id").agg(F.max(F.struct("ok", F.coalesce("error", F.lit("")).alias("error"), "duration_seconds")).alias("r"))
    rows = jobs.join(one, "id", "left")
    go = F.coalesce((F.col("status") == "transcribing") & ~F.col("cancel_requested") & F.col("r.ok").isNotNull(), F.lit(False))
    done, failed = go & F.col("r.ok"), go & ~F.col("r.ok")
    return rows.withColumns({
        "applied": go,
        "status": F.when(done, "completed").when(failed, "failed").otherwise(F.col("status")),
        "duration_seconds": F.when(done, F.col("r.duration_seconds")).otherwise(F.col("duration_seconds")),
        "completed_ms": F.when(go, F.lit(now_ms).cast("long")).otherwise(F.col("completed_ms")),
        "error": F.when(failed, F.col("r.error")).when(~done, F.col("error")),
    }).drop("r")


def recover_interrupted(jobs: DataFrame, now_ms: int, message: str = STOPPED) -> DataFrame:
    """Jobs that a stop left active are interrupted, with the time and the message; others stay as they are."""
    active = F.col("status").isin(*ACTIVE)
    return jobs.withColumns({
        "completed_ms": F.when(active, F.lit(now_ms).cast("long")).otherwise(F.col("completed_ms")),
        "error": F.when(active, message).otherwise(F.col("error")),
        "status": F.when(active, "interrupted").otherwise(F.col("status")),
    })


def recover_finalizations(finalizations: DataFrame, now_ms: int) -> DataFrame:
    """Finalizations (id, state, updated_ms) that a stop left open have failed."""
    cut = F.col("state") == "finalizing"
    return finalizations.withColumns({"updated_ms": F.when(cut, F.lit(now_ms).cast("long")).otherwise(F.col("updated_ms")), "state": F.when(cut, "failed").otherwise(F.col("state"))})


def reset_for_retry(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Terminal jobs of ``ids`` start again: counters, times and flags are cleared; ``reset`` says so.

    Live ones become file jobs on their audio path; without one they stay. Of the columns of a recording,
    those that the table lacks are passed over.
    """
    rows = jobs.join(ids.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    has_audio = F.coalesce(F.col("audio_path") != "", F.lit(False))
    go = F.coalesce(F.col("asked") & F.col("status").isin(*TERMINAL) & ((F.col("kind") == "file") | has_audio), F.lit(False))
    kinds = {f.name: f.dataType for f in jobs.schema}
    put = {"status": "queued", "started_ms": None, "completed_ms": None, "duration_seconds": None, "error": None, "completed_chunks": 0, "total_chunks": None, "cancel_requested": False, "start_requested": False, "queue_visible": True}
    columns = {c: F.when(F.col("reset"), F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in put.items() if c in kinds}
    live = F.col("reset") & (F.col("kind") == "live")
    columns["kind"] = F.when(F.col("reset"), "file").otherwise(F.col("kind"))
    if "source_path" in kinds:
        columns["source_path"] = F.when(live, F.col("audio_path")).otherwise(F.col("source_path"))
    return rows.withColumn("reset", go).withColumns(columns).drop("asked")


def segments_after_reset(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Segments without those of jobs that ``reset_for_retry`` has reset."""
    return segments.join(jobs.where("reset").select(F.col("id").alias("tid")), "tid", "left_anti")


def delete_history(jobs: DataFrame, segments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and segments without the terminal jobs of ``ids``."""
    gone = jobs.where(F.col("status").isin(*TERMINAL)).join(ids.select("id").distinct(), "id", "left_semi").select("id")
    return jobs.join(gone, "id", "left_anti"), segments.join(gone.select(F.col("id").alias("tid")), "tid", "left_anti")


def hide_from_queue(jobs: DataFrame, ids: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Terminal jobs of ``ids`` leave the queue view; queued ones are cancelled too, at ``now_ms``."""
    rows = jobs.join(ids.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    go = F.coalesce(F.col("asked") & (F.col("status").isin(*TERMINAL) | (F.col("status") == "queued")), F.lit(False))
    cancel = go & (F.col("status") == "queued")
    columns = {"queue_visible": F.col("queue_visible") & ~go, "status": F.when(cancel, "cancelled").otherwise(F.col("status"))}
    if now_ms is not None:
        columns["completed_ms"] = F.when(cancel, F.lit(now_ms).cast("long")).otherwise(F.col("completed_ms"))
    return rows.withColumns(columns).drop("asked")


def progress(chunks: DataFrame, durations: DataFrame) -> DataFrame:
    """(tid, completed, estimate) from done chunks (tid, chunk_index, end_s) and (tid, duration_s)."""
    done = chunks.groupBy("tid").agg((F.max("chunk_index") + 1).alias("completed"), F.max("end_s").alias("processed"))
    left = F.greatest(F.col("duration_s") - F.coalesce("processed", F.lit(0)), F.lit(0))
    return durations.join(done, "tid", "left").select("tid", F.coalesce("completed", F.lit(0)).alias("completed"), (F.coalesce("completed", F.lit(0)) + F.ceil(left / CHUNK_SECONDS)).alias("estimate"))


def backfill_audio_path(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Live jobs without audio take the smallest archived path of (id, path)."""
    best = files.where(F.lower("path").rlike(r"\.(flac|wav|mp3)$")).groupBy("id").agg(F.min("path").alias("found"))
    rows = jobs.join(best, "id", "left")
    return rows.withColumn("audio_path", F.when((F.col("kind") == "live") & F.col("audio_path").isNull(), F.col("found")).otherwise(F.col("audio_path"))).drop("found")


def search(jobs: DataFrame, segments: DataFrame, query: str) -> DataFrame:
    """Recordings whose file name or any segment contains ``query``; only ASCII letters fold."""
    hits = segments.where(like_ascii(F.col("text"), query)).select(F.col("tid").alias("id")).distinct()
    found = jobs.join(hits.withColumn("in_text", F.lit(True)), "id", "left")
    return found.where(like_ascii(F.col("source_filename"), query) | F.col("in_text")).drop("in_text")


def search_unicode(jobs: DataFrame, query: str) -> DataFrame:
    return jobs.where(F.lower("source_filename").contains(query.lower()))


def recovered_sessions(archives: DataFrame, jobs: DataFrame) -> DataFrame:
    """Archives (id, session_state) without a recording, with the status they get."""
    lost = archives.join(jobs.select("id"), "id", "left_anti")
    state = F.col("session_state")
    return lost.select("id", F.when(state.isin("failed", "completed"), state).otherwise("interrupted").alias("status"))
