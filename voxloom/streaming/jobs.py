"""Structured Streaming: block ingestion, durable prefixes, voice activity, revisions, levels and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxloom.operators import vad
from voxloom.operators.batches import group_starts
from voxloom.operators.journal import WIRE_BYTES

BLOCKS = (
    "version int, session_id string, track_id string, seq long, codec string, idempotency_key string, sample_rate int, absolute_sample_start long, "
    "duration_samples long, final boolean, payload binary, sha256 string, ts timestamp"
)

#: Groups of tracks that share a state in :func:`stream_vad_segments`.
TRACK_BUCKETS = 1024


def parse_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of JSON lines with ``reason``, null for valid ones: identity, geometry, size, digest."""
    rows = lines.select(F.from_json("value", BLOCKS).alias("b")).select("b.*")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(~F.col("version").eqNullSafe(F.lit(1)), "version").when(blank("session_id") | blank("track_id") | blank("idempotency_key"), "identity")
        .when(F.col("seq").isNull() | (F.col("seq") < 0) | F.coalesce(F.col("absolute_sample_start") < 0, F.lit(True)), "position")
        .when(F.coalesce(F.col("sample_rate") <= 0, F.lit(True)) | F.coalesce(F.col("duration_samples") <= 0, F.lit(True)), "geometry")
        .when(F.octet_length("payload") > WIRE_BYTES, "size").when(F.col("sha256").isNotNull() & (F.sha2("payload", 256) != F.lower("sha256")), "digest")
    )
    return rows.withColumn("reason", reason)


def stream_blocks(spark: SparkSession, path: str, good: str, bad: str, checkpoint: str):
    """JSON lines under ``path`` into two Parquet tables, accepted and rejected blocks. Batch ids make a replay overwrite its own part."""
    lines = spark.readStream.text(path)

    def split(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        batch.where("reason is not null").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        batch.unpersist()

    return parse_blocks(lines).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_blocks(blocks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each idempotency key once within the watermark."""
    return blocks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def stream_durable_cursor(blocks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(session_id, track_id, durable, waiting, gap) after every batch of (session_id, track_id, seq, ts?).

    State is the next sequence number and the numbers that wait beyond a gap; arrival order doesn't
    matter. When the watermark passes the newest block of a track that still waits, the first missing
    number is reported as ``gap`` (else null) and the waiting numbers are dropped, so the state is
    bounded by what arrives within the delay; the sender replays them from the durable cursor. Blocks
    without ``ts`` wait without a limit.
    """
    timed = "ts" in blocks.columns

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        due, waiting = state.get if state.exists else (0, [])
        if state.hasTimedOut:
            state.update((due, []))
            if waiting:
                yield pd.DataFrame({"session_id": [key[0]], "track_id": [key[1]], "durable": [due - 1], "waiting": [0], "gap": [due]})
            return
        seen, newest = {int(s) for s in waiting}, 0
        for p in frames:
            seen.update(int(s) for s in p["seq"] if s >= due)
            newest = max(newest, int(p["ts"].max().timestamp() * 1000) if timed else 0)
        while due in seen:
            seen.discard(due)
            due += 1
        state.update((due, sorted(seen)))
        if seen and timed:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"session_id": [key[0]], "track_id": [key[1]], "durable": [due - 1], "waiting": [len(seen)], "gap": pd.array([None], "Int64")})

    rows = (blocks.withWatermark("ts", delay) if timed else blocks).groupBy("session_id", "track_id")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    schema = "session_id string, track_id string, durable long, waiting long, gap long"
    return rows.applyInPandasWithState(run, schema, "due long, waiting array<long>", "update", timeout)


class Scanner:
    """Incremental regions and chunks of one track; its state is a few numbers.

    ``state``: next frame, start of speech, start of silence, padded start of the open region, active
    chunk (start, end), each -1 if there is none.
    """

    def __init__(self, state: tuple | None = None):
        self.frame, self.speech, self.silence, self.origin, self.start, self.end = state or (0, -1, -1, -1, -1, -1)

    def state(self) -> tuple:
        return self.frame, self.speech, self.silence, self.origin, self.start, self.end

    def _split(self) -> list[tuple[int, int]]:
        """Whole chunks at the beginning of the active one."""
        done = []
        while self.start >= 0 and self.end - self.start > vad.PREFERRED_CHUNK:
            done.append((self.start, self.start + vad.PREFERRED_CHUNK))
            self.start += vad.PREFERRED_CHUNK
        return done

    def _add(self, start: int, end: int) -> list[tuple[int, int]]:
        """A closed region: it widens the active chunk if it overlaps or fits, else the active one is done."""
        done = []
        fits = self.end - self.start < vad.PREFERRED_SPLIT and end - self.start <= vad.PREFERRED_CHUNK
        if self.start >= 0 and (start <= self.end or fits):
            self.end = max(self.end, end)
        else:
            done = [(self.start, self.end)] if self.start >= 0 else []
            self.start, self.end = start, end
        return done + self._split()

    def push(self, prob: float) -> list[tuple[int, int]]:
        at, done = self.frame * vad.FRAME, []
        self.frame += 1
        length = self.frame * vad.FRAME
        if prob >= vad.ON:
            if self.speech < 0:
                self.speech, self.origin = at, max(0, at - vad.PAD)
            self.silence = -1
        elif prob < vad.OFF and self.speech >= 0:
            self.silence = at if self.silence < 0 else self.silence
            if at - self.silence >= vad.MIN_SILENCE:
                if self.silence - self.speech >= vad.MIN_SPEECH:
                    done += self._add(self.origin, self.silence + vad.PAD)
                self.speech = self.silence = self.origin = -1
        # Speech without a pause is cut at the preferred length from its padded start.
        while self.speech >= 0 and length - self.speech >= vad.PREFERRED_CHUNK:
            cut = self.origin + vad.PREFERRED_CHUNK
            done += self._add(self.origin, cut)
            self.speech, self.origin, self.silence = cut, cut, -1
        # No later region can join a chunk that began so long ago.
        if self.start >= 0 and length - self.start > vad.PREFERRED_CHUNK:
            done.append((self.start, self.end))
            self.start = self.end = -1
        return self._heard(done, length)

    def push_all(self, probs: np.ndarray) -> list[tuple[int, int]]:
        """All chunks of many frames in order; those that change nothing are passed over."""
        done, kinds = [], np.where(probs >= vad.ON, 2, np.where(probs < vad.OFF, 0, 1))
        bounds = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(probs)]
        for a, b in zip(bounds, bounds[1:]):
            prob, left = float(probs[a]) if b > a else 0.0, b - a
            while left:
                done += self.push(prob)
                skip = min(self._same(prob), left - 1)
                self.frame += skip
                left -= 1 + skip
        return done

    def _same(self, prob: float) -> int:
        """How many more frames like the last one only count: before a pause or a cut, or the end of what can be joined."""
        due = []
        if self.speech >= 0:
            due.append(-(-(self.speech + vad.PREFERRED_CHUNK) // vad.FRAME))
            if prob < vad.OFF:
                due.append(-(-(self.silence + vad.MIN_SILENCE) // vad.FRAME) + 1)
        if self.start >= 0:
            due.append((self.start + vad.PREFERRED_CHUNK) // vad.FRAME + 1)
        return max(min(due) - self.frame - 1, 0) if due else 1 << 62

    @staticmethod
    def _heard(chunks: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
        """Chunks within the audio so far; those too short for a spectrum go."""
        cut = [(start, min(end, length)) for start, end in chunks]
        return [(start, end) for start, end in cut if end - start >= vad.FFT]

    def finish(self) -> list[tuple[int, int]]:
        length, done = self.frame * vad.FRAME, []
        if self.speech >= 0 and length - self.speech >= vad.MIN_SPEECH:
            done += self._add(self.origin, length)
        done += self._split()
        if self.start >= 0:
            done.append((self.start, self.end))
        self.speech = self.silence = self.origin = self.start = self.end = -1
        return self._heard(done, length)


def _frame_runs(frames: DataFrame, timed: bool) -> DataFrame:
    """(tid, track, first, probs, last, newest, ts?): frames that follow one another in a batch as one row.

    ``last`` is its final frame or -1, ``newest`` its latest time in milliseconds or 0.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("frame").to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(len(number), bool)
            new[group_starts(batch, ["tid", "track"])] = True
            new[1:] |= np.diff(number) != 1
            starts = np.flatnonzero(new)
            final = np.where(batch.column("final").fill_null(False).to_numpy(zero_copy_only=False), number, -1)
            probs = pa.array(batch.column("prob").to_numpy(zero_copy_only=False), pa.float64())
            heads = pa.array(starts)
            columns = [batch.column("tid").take(heads), batch.column("track").take(heads), pa.array(number[starts]), pa.ListArray.from_arrays(pa.array(np.append(starts, len(number)), pa.int32()), probs), pa.array(np.maximum.reduceat(final, starts))]
            newest = np.maximum.reduceat(batch.column("ts").cast(pa.int64()).to_numpy(), starts) if timed else np.zeros(len(starts), np.int64)
            columns.append(pa.array(newest // 1000))
            if timed:
                columns.append(pa.array(newest).cast(batch.schema.field("ts").type))
            yield pa.RecordBatch.from_arrays(columns, names=["tid", "track", "first", "probs", "last", "newest", "ts"][: len(columns)])

    columns = ["tid", "track", "frame", "prob", "final"] + ["ts"] * timed
    return frames.select(*columns).mapInArrow(run, "tid string, track string, first long, probs array<double>, last long, newest long" + ", ts timestamp" * timed)


def stream_vad_segments(frames: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(tid, track, start, end) chunks from a stream of frames (tid, track, frame, prob, final, ts?).

    Frames may come out of order; those beyond a gap wait in the state. ``final`` ends a track, or the
    watermark when it passes the newest frame: then what waits is read in order, gaps left out. Frames
    without ``ts`` wait without a limit. Frames that lie in order are put together before they are dealt,
    and tracks by their hash, as a call for each track costs far more than its frames.
    """
    timed = "ts" in frames.columns

    def read(track: list, runs: list[tuple[int, np.ndarray]], last: int) -> list[tuple[int, int]]:
        """The chunks that new runs of frames complete; ``track`` has its scanner's numbers, what waits, its final frame and time."""
        scanner, waiting = Scanner(tuple(track[0]) if track[0] else None), {int(f): float(p) for f, p in track[1]}
        out, last = [], last if last >= 0 else track[2]
        in_order = sorted(runs, key=lambda x: x[0])
        follow = all(a + len(x) == b for (a, x), (b, _) in zip(in_order, in_order[1:]))
        if not waiting and follow and in_order[0][0] <= scanner.frame:
            out += scanner.push_all(np.concatenate([x for _, x in in_order])[scanner.frame - in_order[0][0] :])
        else:
            # Of frames with the same number, the last one counts.
            waiting.update({f + k: float(v) for f, x in runs for k, v in enumerate(x) if f + k >= scanner.frame})
            while scanner.frame in waiting:
                out += scanner.push(waiting.pop(scanner.frame))
        if 0 <= last < scanner.frame:
            out += scanner.finish()
            last = -1
        track[:3] = list(scanner.state()), [[float(f), x] for f, x in sorted(waiting.items())], last
        return out

    def late(track: list) -> list[tuple[int, int]]:
        scanner, out = Scanner(tuple(track[0])), []
        for f, p in track[1]:
            scanner.frame = int(f)
            out += scanner.push(p)
        return out + scanner.finish()

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState):
        tracks = {(a, b): list(x) for a, b, *x in zip(*state.get)} if state.exists else {}
        new: dict[tuple, list] = {}
        if not state.hasTimedOut:
            for p in parts:
                for a, b, first, probs, last, newest in zip(p["tid"], p["track"], p["first"].tolist(), p["probs"], p["last"].tolist(), p["newest"].tolist()):
                    got = new.setdefault((a, b), [[], -1, 0])
                    got[0].append((first, np.asarray(probs, np.float64)))
                    got[1:] = max(got[1], last), max(got[2], newest)
        passed, found = state.getCurrentWatermarkMs() if timed else 0, []
        for k, (runs, last, newest) in new.items():
            track = tracks.setdefault(k, [None, [], -1, 0])
            found += [(*k, *c) for c in read(track, runs, last)]
            track[3] = max(newest, passed) + 1
        for k in [k for k, track in tracks.items() if timed and k not in new and track[3] < passed]:
            found += [(*k, *c) for c in late(tracks.pop(k))]
        if tracks:
            state.update(tuple(list(x) for x in zip(*((*k, *track) for k, track in tracks.items()))))
            if timed:
                state.setTimeoutTimestamp(max(min(track[3] for track in tracks.values()), passed + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["tid", "track", "start", "end"])

    runs = _frame_runs(frames, timed)
    runs = (runs.withWatermark("ts", delay) if timed else runs).withColumn("bucket", F.pmod(F.xxhash64("tid", "track"), F.lit(TRACK_BUCKETS)).cast("int"))
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    kept = "tids array<string>, tracks array<string>, numbers array<array<long>>, held array<array<array<double>>>, last array<long>, due array<long>"
    return runs.groupBy("bucket").applyInPandasWithState(run, "tid string, track string, start long, end long", kept, "append", timeout)


def stream_upsert_segments(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keeps the latest revision of every segment under ``path``: each batch rewrites the buckets that it touches.

    Segments are dealt to ``buckets`` by hash of session and id. A bucket's version of a batch is
    ``path``/version=N/bucket=B, its newest one is current and the one before stays for a batch that is
    run again; older ones go. Equal revisions keep the row that is there.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        from voxloom.operators.journal import upsert_segments

        spark = batch.sparkSession
        columns = batch.columns
        new = batch.withColumn("bucket", F.pmod(F.xxhash64("session_id", "change_id"), F.lit(buckets)).cast("int")).persist()
        rows = new
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets
        old = _bucket_versions(spark, path)
        before = {b: max((v for v in old.get(b, []) if v < batch_id), default=None) for b in touched}
        parts = [f"{path}/version={v}/bucket={b}" for b, v in before.items() if v is not None]
        if parts:
            current = spark.read.schema(batch.schema).parquet(*parts)
            rows = current.withColumn("bucket", F.pmod(F.xxhash64("session_id", "change_id"), F.lit(buckets)).cast("int")).unionByName(rows)
        latest = upsert_segments(rows).select(*columns, "bucket").withColumn("version", F.lit(batch_id))
        latest.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(path)
        new.unpersist()
        for b in touched:
            for v in [v for v in old.get(b, []) if before[b] is not None and v < before[b]]:
                _fs(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/bucket={b}"), True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current table of ``stream_upsert_segments``."""
    parts = [f"{path}/version={max(v)}/bucket={b}" for b, v in sorted(_bucket_versions(spark, path).items())]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _bucket_versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket, from the names of folders."""
    found: dict[int, list[int]] = {}
    for status in _fs(spark, path).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/bucket=*")) or []:
        version, bucket = (x.partition("=")[2] for x in status.getPath().toString().split("/")[-2:])
        found.setdefault(int(bucket), []).append(int(version))
    return found


def stream_levels(packets: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Ten-second levels by track of packets (session_id, track_id, ts, power, n, gap_ms, resync)."""
    grouped = packets.withWatermark("ts", delay).groupBy(F.window("ts", "10 seconds"), "session_id", "track_id")
    return grouped.agg(F.count(F.lit(1)).alias("packets"), F.sqrt(F.sum("power") / F.sum("n")).alias("rms"), F.sum("gap_ms").alias("gap_ms"), F.count_if("resync").alias("resyncs"))


def session_activity(packets: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Spans of activity (session_id, start, end, packets); silence longer than ``gap`` ends one."""
    grouped = packets.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "session_id")
    return grouped.agg(F.count(F.lit(1)).alias("packets")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "packets")
