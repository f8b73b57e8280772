"""Recognition quality: error rates, anchors, boundaries, consistency, sizes, speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.distance import with_distance
from voxloom.functions.columns import normalized_text


def joined_text(segments: DataFrame, name: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("start_ms", "segment_index", "text")))
    return segments.groupBy("tid").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias(name))


def cer(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(tid, distance, length, cer) of normalised texts; a recording missing on one side counts as empty there.

    Distances are of whole recordings, by words of bits in a band that doubles until it holds the distance.
    """
    both = joined_text(reference, "ref").join(joined_text(hypothesis, "hyp"), "tid", "full")
    both = both.select("tid", normalized_text(F.coalesce("ref", F.lit(""))).alias("ref"), normalized_text(F.coalesce("hyp", F.lit(""))).alias("hyp"))
    length = F.greatest(F.char_length("ref"), F.lit(1))
    found = with_distance(both.select("tid", "ref", "hyp", length.alias("length")), "ref", "hyp")
    return found.select("tid", "distance", "length", (F.col("distance") / F.col("length")).alias("cer"))


def anchor_counts(segments: DataFrame, phrases: list[str]) -> DataFrame:
    """(tid, phrase, n, ok): occurrences of each given phrase; ok if there is exactly one."""
    text = joined_text(segments, "t").withColumn("phrase", F.explode(F.array(*[F.lit(p) for p in phrases])))
    low, phrase = F.lower("t"), F.lower("phrase")
    n = ((F.char_length(low) - F.char_length(F.replace(low, phrase, F.lit("")))) / F.char_length(phrase)).cast("int")
    return text.select("tid", "phrase", n.alias("n"), (n == 1).alias("ok"))


def boundary_recall(reference: DataFrame, candidate: DataFrame, tolerance_ms: int = 2500) -> DataFrame:
    """(tid, starts, found): reference starts with a candidate start within the tolerance; joined by time bucket."""
    width = 2 * tolerance_ms
    ref = reference.select("tid", F.col("start_ms").alias("r"), F.monotonically_increasing_id().alias("row"))
    near = ref.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("r") - tolerance_ms) / width), F.floor((F.col("r") + tolerance_ms) / width))))
    cand = candidate.select("tid", F.col("start_ms").alias("c"), F.floor(F.col("start_ms") / width).alias("bucket"))
    hit = near.join(cand, ["tid", "bucket"]).where(F.abs(F.col("r") - F.col("c")) <= tolerance_ms).groupBy("tid").agg(F.countDistinct("r").alias("found"))
    total = ref.groupBy("tid").agg(F.countDistinct("r").alias("starts"))
    return total.join(hit, "tid", "left").select("tid", "starts", F.coalesce("found", F.lit(0)).cast("long").alias("found"))


def run_consistency(a: DataFrame, b: DataFrame, tolerance_ms: int = 250) -> DataFrame:
    """(tid, n_a, n_b, n_far): segment counts of two runs and the indexes whose times differ too much."""
    side = lambda df, p: df.select("tid", "segment_index", F.col("start_ms").alias(f"s{p}"), F.col("end_ms").alias(f"e{p}"))
    both = side(a, "a").join(side(b, "b"), ["tid", "segment_index"], "full")
    far = (F.abs(F.col("sa") - F.col("sb")) > tolerance_ms) | (F.abs(F.col("ea") - F.col("eb")) > tolerance_ms)
    return both.groupBy("tid").agg(F.count("sa").alias("n_a"), F.count("sb").alias("n_b"), F.count_if(far).alias("n_far"))


def codec_sizes(rows: DataFrame, formats: list[str]) -> DataFrame:
    """Bytes and elapsed time by fixture and format (fixture, format, bytes, elapsed_ms), with each format's share of wav in per mille."""
    cells = [x for f in formats for x in (F.sum(F.when(F.col("format") == f, F.col("bytes"))).alias(f), F.sum(F.when(F.col("format") == f, F.col("elapsed_ms"))).alias(f"{f}_ms"))]
    wide = rows.groupBy("fixture").agg(*cells)
    return wide.select("fixture", *formats, *[f"{f}_ms" for f in formats], *[(F.floor(F.col(f) * 1000 / F.col("wav"))).alias(f"{f}_permille") for f in formats if f != "wav"])


def diarization_accuracy(labels: DataFrame) -> DataFrame:
    """(tid, n, correct) of two-label results (tid, truth, guess) whatever the labels' order."""
    same = labels.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("guess")).alias("k"))
    return same.select("tid", "n", F.greatest("k", F.col("n") - F.col("k")).alias("correct"))


def nonoverlapping_turns(turns: DataFrame, least_ms: int = 2000, speakers: int = 2) -> DataFrame:
    """Turns (tid, speaker, start_ms, end_ms) of ``least_ms`` or more that overlap no other, of the most frequent speakers.

    A turn overlaps an earlier one if it starts before the largest end so far, and a later one if that starts
    before its end: two windows instead of a self-join.
    """
    w = W.partitionBy("tid").orderBy("start_ms", "end_ms", "speaker")
    before = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.lead("start_ms").over(w)
    alone = (F.coalesce(before, F.col("start_ms")) <= F.col("start_ms")) & (F.coalesce(after, F.col("end_ms")) >= F.col("end_ms"))
    rows = turns.withColumn("alone", alone).where("alone").where(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("alone")
    counts = rows.groupBy("tid", "speaker").agg(F.count(F.lit(1)).alias("turns"))
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("tid").orderBy(F.col("turns").desc(), "speaker"))).where(F.col("rank") <= speakers)
    return rows.join(top.select("tid", "speaker"), ["tid", "speaker"], "left_semi")
