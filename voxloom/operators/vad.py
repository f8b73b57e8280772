"""Voice activity: scores to regions, regions to chunks, chunks to audio.

Positions are samples at 16 kHz. Frames have tid, track, frame and prob.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.operators.batches import VALUES, group_starts, lists

#: Fixed values of the detector, in samples at 16 kHz.
RATE, FRAME = 16_000, 512
ON, OFF = 0.5, 0.35
MIN_SPEECH, MIN_SILENCE, PAD = 3_200, 1_600, 1_920
PREFERRED_SPLIT, PREFERRED_CHUNK, HARD_CHUNK = 240_000, 352_000, 480_000
FFT, CONTEXT = 320, 64
KEY = ("tid", "track")
#: Frames of a row of bits and of each of its numbers; rows of bits that are read at once.
WORD, BITS, WORDS = 256, 64, 4096


def score_vad(blocks: DataFrame, scorer: Callable[[], Callable[[np.ndarray, object], tuple[float, object]]]) -> DataFrame:
    """(tid, track, frame, prob) of audio blocks (tid, track, block_start, samples).

    ``scorer()`` is called once a track and returns a function of (context + frame, state) giving
    (probability, state). The last frame is padded with zeros. A track's blocks come to one task in order,
    which holds a batch of them and passes from track to track.
    """

    def run(batches):
        score = state = key = rest = None
        frames = 0

        def heard(samples: np.ndarray) -> list[float]:
            nonlocal state, rest
            rest = np.concatenate([rest, samples])
            n, probs = (len(rest) - CONTEXT) // FRAME, []
            for i in range(n):
                p, state = score(rest[i * FRAME : CONTEXT + (i + 1) * FRAME], state)
                probs.append(float(p))
            rest = rest[n * FRAME :]
            return probs

        def ended() -> list[float]:
            short = 0 if key is None else len(rest) - CONTEXT
            return heard(np.zeros(FRAME - short, np.float32)) if short else []

        def table(found: list[tuple]) -> pa.RecordBatch:
            counts = [len(p) for _, _, p in found]
            owner = pa.array(np.repeat(np.arange(len(found)), counts))
            tid, track = (pa.array([k[i] for k, _, _ in found], pa.string()).take(owner) for i in (0, 1))
            frame = np.arange(sum(counts)) + np.repeat(np.array([f for _, f, _ in found], np.int64) - (np.cumsum(counts) - counts), counts)
            return pa.RecordBatch.from_arrays([tid, track, pa.array(frame, pa.int32()), pa.array([x for _, _, p in found for x in p], pa.float64())], names=["tid", "track", "frame", "prob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            found, starts = [], group_starts(batch, KEY)
            offsets, values = lists(batch.column("samples"))
            keys = list(zip(*(batch.column(c).take(pa.array(starts)).to_pylist() for c in KEY)))
            for k, a, b in zip(keys, offsets[starts], offsets[np.append(starts[1:], batch.num_rows)]):
                if k != key:
                    found.append((key or k, frames, ended()))
                    score, state, key, rest, frames = scorer(), None, k, np.zeros(CONTEXT, np.float32), 0
                for at in range(int(a), int(b), VALUES):
                    probs = heard(values[at : min(at + VALUES, int(b))].astype(np.float32))
                    found.append((k, frames, probs))
                    frames += len(probs)
            yield table(found)
        if key is not None:
            yield table([(key, frames, ended())])

    ordered = blocks.select(*KEY, "block_start", "samples").repartition(*KEY).sortWithinPartitions(*KEY, "block_start")
    return ordered.mapInArrow(run, "tid string, track string, frame int, prob double")


def speech_regions(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """(tid, track, start, end) by hysteresis; ``lengths`` has (tid, track, audio_len).

    Every frame at or above ON begins an epoch; an epoch closes if frames below OFF span the least
    silence. A region runs from the first epoch after a closed one to the next closed one.

    Frames are gathered where they lie, before any shuffle, into rows of bits, which say of :data:`WORD`
    frames which are at or above ON and which below OFF. A track's rows come to one task in order, which
    holds some of them and the region that may go on.
    """
    hi, lo, frame = F.col("prob") >= ON, F.col("prob") < OFF, F.col("frame").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), frame.bitwiseAND(BITS - 1).cast("int"))
    number = F.shiftright(frame, 6).bitwiseAND(WORD // BITS - 1)
    bits = [F.coalesce(F.bit_or(F.when(c & (number == k), bit)), F.lit(0).cast("long")).alias(f"{name}{k}") for name, c in (("hi", hi), ("lo", lo)) for k in range(WORD // BITS)]
    words = frames.where(hi | lo).groupBy(*KEY, F.shiftright(frame, 8).alias("word")).agg(*bits)
    regions = words.repartition(*KEY).sortWithinPartitions(*KEY, "word").mapInArrow(_regions, "tid string, track string, start long, end long")
    regions = regions.where(F.coalesce(F.col("end") - F.col("start") >= MIN_SPEECH, F.lit(True)))
    regions = regions.join(lengths.hint("merge"), list(KEY)).withColumn("end", F.coalesce("end", "audio_len"))
    return regions.where(F.col("end") - F.col("start") >= MIN_SPEECH).select(*KEY, "start", "end")


def _regions(batches):
    """Regions of rows of bits (tid, track, word, hi.., lo..) in order; ``end`` is null where the speech goes on to the end."""
    key, open_ = None, None  # the track, and the start and silence of its region that may go on

    def table(tids, tracks, start, end, ends) -> pa.RecordBatch:
        ends = pa.array(np.asarray(end, np.int64) * FRAME, mask=~np.asarray(ends, bool))
        return pa.RecordBatch.from_arrays([tids, tracks, pa.array(np.asarray(start, np.int64) * FRAME), ends], names=["tid", "track", "start", "end"])

    def going_on() -> pa.RecordBatch:
        return table(*(pa.array([k], pa.string()) for k in key), [open_[0]], [0], [False])

    for batch in batches:
        for at in range(0, batch.num_rows, WORDS):
            part = batch.slice(at, WORDS)
            starts = group_starts(part, KEY)
            heads = [part.column(c).take(pa.array(starts)) for c in KEY]
            first, last = (tuple(h[i].as_py() for h in heads) for i in (0, -1))
            if open_ and first != key:
                yield going_on()
            hi, lo = (_bits(part, name) for name in ("hi", "lo"))
            some = np.flatnonzero(hi | lo)
            row = some // WORD
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, part.num_rows)))[row]
            frame = part.column("word").to_numpy()[row] * WORD + some % WORD
            hi, lo = hi[some], lo[some]
            if open_ and first == key:
                start, quiet = open_
                n = 1 + len(quiet)
                group, frame = np.append(np.zeros(n, np.int64), group), np.append([start, *quiet], frame)
                hi, lo = np.append([True] + [False] * len(quiet), hi), np.append([False] + [True] * len(quiet), lo)
            group, start, sil, late, quiet, closed = _islands(group, frame, hi, lo, len(starts))
            key, open_ = last, None
            if len(group) and group[-1] == len(starts) - 1 and not closed[-1]:
                open_ = int(start[-1]), [int(sil[-1]), int(late[-1])] if quiet[-1] else []
                group, start, sil, closed = (x[:-1] for x in (group, start, sil, closed))
            yield table(*(h.take(pa.array(group)) for h in heads), start, sil, closed)
    if open_:
        yield going_on()


def _bits(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A flag for each frame of rows of bits."""
    numbers = np.stack([rows.column(f"{name}{k}").to_numpy() for k in range(WORD // BITS)], axis=1).astype("<i8")
    return np.unpackbits(numbers.view(np.uint8).reshape(-1), bitorder="little").astype(bool)


def _islands(group: np.ndarray, frame: np.ndarray, hi: np.ndarray, lo: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """(group, start, first and last silence, if there is any, closed) of the islands of epochs; the silences are the last epoch's."""
    n = np.cumsum(hi)
    begun = n > np.append(0, n)[np.searchsorted(group, np.arange(groups))][group]
    group, frame, hi, lo = group[begun], frame[begun], hi[begun], lo[begun]
    epoch, heads, low = np.cumsum(hi) - 1, np.flatnonzero(hi), np.flatnonzero(lo)
    sil, late, quiet = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), np.zeros(len(heads), bool)
    # Of several values the last one stays.
    sil[epoch[low][::-1]], late[epoch[low]], quiet[epoch[low]] = frame[low][::-1], frame[low], True
    closed = quiet & ((late - sil) * FRAME >= MIN_SILENCE)
    owner = group[heads]
    first = np.ones(len(heads), bool)
    first[1:] = closed[:-1] | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(heads))[: len(begin)] - 1
    return owner[begin], frame[heads][begin], sil[end], late[end], quiet[end], closed[end]


def pad_and_merge_regions(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Regions widened on both sides within the audio; those that touch are merged."""
    wide = regions.join(lengths.hint("merge"), list(KEY)).select(*KEY, F.greatest(F.col("start") - PAD, F.lit(0)).alias("start"), F.least(F.col("end") + PAD, F.col("audio_len")).alias("end"))
    w = W.partitionBy(*KEY).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = wide.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return islands.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def chunk_regions(regions: DataFrame) -> DataFrame:
    """(tid, track, start, end) chunks: a greedy fold over the regions of each track, then repair of short ones."""

    def run(batches):
        for batch in batches:
            chunks = [repair_short_chunks(chunks_of([(r["start"], r["end"]) for r in track])) for track in batch.column(2).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(chunks)), [len(c) for c in chunks]))
            flat = [x for c in chunks for x in c]
            ends = [pa.array([x[k] for x in flat], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *ends], names=["tid", "track", "start", "end"])

    # Many tracks come in one batch; a track's regions are some per minute.
    ordered = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("regions")
    return regions.groupBy(*KEY).agg(ordered).mapInArrow(run, "tid string, track string, start long, end long")


def chunks_of(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    done: list[tuple[int, int]] = []
    active: tuple[int, int] | None = None
    for start, end in regions:
        if active and active[1] - active[0] < PREFERRED_SPLIT and end - active[0] <= PREFERRED_CHUNK:
            active = (active[0], end)
            continue
        if active:
            done.append(active)
        while end - start > PREFERRED_CHUNK:
            done.append((start, start + PREFERRED_CHUNK))
            start += PREFERRED_CHUNK
        active = (start, end)
    return done + [active] if active else done


def repair_short_chunks(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks too short for a spectrum join the one before, else the one after, else go."""
    out: list[tuple[int, int]] = []
    carried: int | None = None
    for i, (start, end) in enumerate(chunks):
        start, carried = (carried if carried is not None else start), None
        if end - start >= FFT:
            out.append((start, end))
        elif out and end - out[-1][0] <= HARD_CHUNK:
            out[-1] = (out[-1][0], end)
        elif i + 1 < len(chunks) and chunks[i + 1][1] - start <= HARD_CHUNK:
            carried = start
    return out


def repaired_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (tid, track, start, end) without short ones, each track's in order of start."""

    def run(batches):
        for batch in batches:
            kept = [repair_short_chunks([(r["start"], r["end"]) for r in track]) for track in batch.column(2).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(kept)), [len(c) for c in kept]))
            ends = [pa.array([x[k] for c in kept for x in c], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *ends], names=["tid", "track", "start", "end"])

    ordered = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("chunks")
    return chunks.groupBy(*KEY).agg(ordered).mapInArrow(run, "tid string, track string, start long, end long")


def ready_chunks(chunks: DataFrame, cursors: DataFrame) -> DataFrame:
    """Chunks to emit now: (tid, track, start, end) past the cursor (tid, track, emitted, audio_end, flush)."""
    rows = chunks.join(cursors, list(KEY)).where(F.col("end") > F.coalesce("emitted", F.lit(0)))
    return rows.where((F.col("audio_end") - F.col("end") > MIN_SPEECH) | (F.col("end") - F.col("start") >= PREFERRED_CHUNK) | F.col("flush")).select(*KEY, "start", "end")


def advanced_cursors(cursors: DataFrame, emitted: DataFrame) -> DataFrame:
    top = emitted.groupBy(*KEY).agg(F.max("end").alias("top"))
    return cursors.join(top, list(KEY), "left").withColumn("emitted", F.greatest("emitted", "top")).drop("top")


def slice_audio(spans: DataFrame, blocks: DataFrame, block: int = 16_384) -> DataFrame:
    """Spans (tid, track, start, end) with their ``samples``, from blocks (tid, track, block_start, samples) of ``block`` samples.

    The span side is exploded to the few blocks it meets, so the interval join is an equi-join. Both sides
    grow with the audio, so that neither goes through the driver.
    """
    wide = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / block))))
    parts = wide.join(blocks.withColumn("block", F.floor(F.col("block_start") / block)).hint("merge"), [*KEY, "block"])
    first = F.greatest(F.col("start") - F.col("block_start"), F.lit(0)).cast("int")
    count = F.greatest(F.least(F.col("end") - F.col("block_start"), F.size("samples")).cast("int") - first, F.lit(0))
    parts = parts.withColumn("part", F.slice("samples", first + 1, count))
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]))
    return parts.groupBy(*KEY, "start", "end").agg(whole.alias("samples"))
