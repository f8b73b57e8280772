"""CTC output to text. Frames have chunk_id, frame and scores (one per vocabulary entry)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.sources.stored import saved

BLANK = "<blk>"


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token) from lines of "token id"; the word mark becomes a space. Without a blank entry it raises ValueError."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.regexp_extract("value", r"^(.*) (\d+)\s*$", 2).try_cast("int").alias("token_id"), F.replace(F.regexp_extract("value", r"^(.*) (\d+)\s*$", 1), F.lit("▁"), F.lit(" ")).alias("token"))
    if rows.where(F.col("token") == BLANK).isEmpty():
        raise ValueError(f"no {BLANK} in the vocabulary")
    return rows


def ctc_tokens(frames: DataFrame, vocab: DataFrame) -> DataFrame:
    """(chunk_id, frame, token) that stay: the best id of each frame (the last of equals), without blanks and repeats.

    A best id beyond the vocabulary fails the query.
    """
    n = (vocab.agg(F.max("token_id")).first()[0] or 0) + 1  # the vocabulary is a model's
    x = F.col("scores")
    best = (F.size(x) - F.array_position(F.reverse(x), F.array_max(x))).cast("int")
    fits = F.when(best < n, best).otherwise(F.raise_error(F.lit(f"an id is beyond the vocabulary of {n}")).cast("int"))
    w = W.partitionBy("chunk_id").orderBy("frame")
    rows = frames.withColumn("token_id", fits).withColumn("before", F.lag("token_id").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("token_id")))
    tokens = rows.join(F.broadcast(vocab), "token_id", "left").withColumn("token", F.coalesce("token", F.lit("")))
    return tokens.where(F.col("token") != BLANK).select("chunk_id", "frame", "token")


def _text(parts) -> F.Column:  # type: ignore[name-defined]
    return F.trim(F.regexp_replace(F.array_join(parts, ""), r"\s+", " "))


def ctc_decode(frames: DataFrame, vocab: DataFrame) -> DataFrame:
    tokens = ctc_tokens(frames, vocab).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("frame", "token"))).alias("x"))
    return frames.select("chunk_id").distinct().join(tokens, "chunk_id", "left").select("chunk_id", F.coalesce(_text(F.transform("x", lambda t: t["token"])), F.lit("")).alias("text"))


def ctc_phrases(frames: DataFrame, vocab: DataFrame, durations: DataFrame) -> DataFrame:
    """(chunk_id, phrase, start, end, text, error): a token that ends in ``. ? ! …`` closes a phrase half-way to the next token.

    ``durations`` has (chunk_id, duration, n_frames). A chunk whose duration isn't finite and above zero
    gives one row with only its error; one without frames or text gives none. A closed phrase without
    length is left out.
    """
    durations = durations.withColumn("fine", F.coalesce((F.col("duration") > 0) & (F.col("duration") < float("inf")) & ~F.isnan("duration"), F.lit(False)))
    bad = durations.where("not fine").select("chunk_id", F.lit("duration").alias("error"))
    w = W.partitionBy("chunk_id").orderBy("frame")
    rows = ctc_tokens(frames, vocab).join(durations.where("fine and n_frames > 0"), "chunk_id")
    ender = F.col("token").rlike(r"[.?!…]\s*$")
    rows = rows.withColumn("next", F.lead("frame").over(w)).withColumn("ender", ender)
    rows = rows.withColumn("phrase", F.coalesce(F.sum(F.col("ender").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    stop = (F.col("frame") + 1 + F.coalesce("next", F.col("n_frames"))) / 2 / F.col("n_frames") * F.col("duration")
    rows = rows.withColumn("stop", F.when(F.col("ender"), stop).otherwise(F.col("duration")))
    parts = F.sort_array(F.collect_list(F.struct("frame", "token")))
    phrases = rows.groupBy("chunk_id", "phrase").agg(_text(F.transform(parts, lambda t: t["token"])).alias("text"), F.max_by("stop", "frame").alias("end"), F.first("duration").alias("duration"), F.bool_or("ender").alias("closed"))
    phrases = phrases.withColumn("start", F.coalesce(F.lag("end").over(W.partitionBy("chunk_id").orderBy("phrase")), F.lit(0.0)))
    phrases = phrases.withColumn("end", F.least(F.greatest("end", "start"), "duration")).where("text <> '' and (not closed or end > start)")
    good = phrases.select("chunk_id", "phrase", "start", "end", "text", F.lit(None).cast("string").alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


def run_model(chunks: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Runs an injected model over batches of chunks; ``model()`` is called once a task and returns the batch function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = model()
        for rows in batches:
            yield fn(rows)

    return chunks.mapInPandas(run, schema)


def recognize(chunks: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]], vocab: DataFrame, phrases: bool = True, rate: int = 16_000, parts: int | None = None) -> DataFrame:
    """Chunks (chunk_id, samples at 16 kHz) to phrases (as ctc_phrases), or to (chunk_id, text, error).

    Features, then the injected model ([frames, 64] to [frames, vocabulary]), then decoding. Chunks are
    dealt to ``parts`` tasks, as the model is what costs; each chunk goes through it once, as its scores
    are a written table. A chunk that is too short, or that the model fails on, has the error.
    """
    from voxloom.operators.audio import asr_log_mel

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = model()
        for rows in batches:
            for chunk, samples in zip(rows["chunk_id"], rows["samples"]):
                x = np.asarray(samples if samples is not None else [], np.float32)
                try:
                    scores, error = np.asarray(fn(asr_log_mel(x)), np.float32), None
                except Exception as e:  # noqa: BLE001  any error of the injected model belongs in its row
                    scores, error = np.zeros((0, 0), np.float32), str(e) or type(e).__name__
                n = max(1, len(scores))
                yield pd.DataFrame({"chunk_id": [chunk] * n, "frame": np.arange(n), "scores": list(scores) or [None], "duration": len(x) / rate, "n_frames": len(scores), "error": error})

    dealt = chunks.select("chunk_id", "samples").repartition(parts or chunks.sparkSession.sparkContext.defaultParallelism, "chunk_id")
    scored = saved(dealt.mapInPandas(run, "chunk_id string, frame int, scores array<float>, duration double, n_frames int, error string"), "recognized")
    failed = scored.where("error is not null").select("chunk_id", "error")
    frames = scored.where("error is null and scores is not null")
    if phrases:
        durations = scored.where("error is null").select("chunk_id", "duration", "n_frames").distinct()
        return ctc_phrases(frames, vocab, durations).unionByName(failed, allowMissingColumns=True)
    text = ctc_decode(frames.select("chunk_id", "frame", "scores"), vocab)
    return text.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
