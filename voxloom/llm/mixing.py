"""Mix sources to target weights with nested hash-threshold histograms.

Every document has a 60-bit hash of its id. For each source the job sums words by the leading bits
of the hash, finds the bucket in which the budget ends, and looks at the next bits of that bucket
alone, until the threshold is a single hash. Documents below it are taken once more. Nothing is
sorted but a bounded histogram. Where rows share the boundary hash, as those of one id do, a hash of
their texts goes on in the same way, and of rows that are equal in both as many are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm.numbering import numbered_within
from voxloom.llm.scratch import saved

HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS = (3, 1, 2)
#: Sources up to which their table of thresholds is broadcast.
BROADCAST_SOURCES = 10_000


def id_hash(c: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    """60 bits of a hash of the text, null as empty: tells rows of one id apart."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 4)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight, none above ``most`` times its source.

    Weights repeat over the sources in code-point order, null last. The table has one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(most) * F.col("source_size"))
    everyone = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    t = t.withColumn("budget", F.lit(share) * F.sum("source_size").over(everyone)).withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), zero))
    )
    t = t.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    rest = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(zero)).over(everyone)
    free = F.sum(F.when(F.col("capped"), zero).otherwise(F.col("weight"))).over(everyone)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("budget") - rest) / free)
    return t.select("source", "source_size", target.alias("target"))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how many times the mix takes each document.

    Every document of a source is taken floor(target / source size) times, and those whose hash is
    below the source's threshold once more; the document at the threshold is taken if that brings
    the sum nearer to the target. Null text has no words, null is a source of its own. Rows of one id, or
    without one, are told apart by their texts; of equal rows any are taken. An empty table gives an empty
    result; other columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), id_hash(F.col(f"`{id_col}`")).alias("hash"), text_hash(text).alias("tie")
    )
    base = saved(base, "mix-sizes")
    limits = saved(thresholds(base, weights, share, most), "mix-thresholds")
    return with_limits(base, limits).select("doc_id", "source", "size", "source_size", "target", "copies")


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (source, hash, tie, ...) with source_size, target and copies."""
    limits = limits.withColumnRenamed("source", "limit_source")
    met = rows.join(F.broadcast(limits) if limits.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else limits, F.col("source").eqNullSafe(F.col("limit_source")))
    once = F.col("hash") < F.col("threshold")
    shared = F.col("hash").eqNullSafe(F.col("tie_hash"))
    again = once | (shared & (F.col("tie") < F.col("tie_threshold")))
    out = lambda df, more: df.withColumn("copies", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")).select(*rows.columns, "source_size", "target", "copies")
    if limits.where("equal_tie is not null").isEmpty():
        return out(met, again)
    # Equal rows at a threshold: one group a source, numbered without a task for it.
    equal = shared & F.col("tie").eqNullSafe(F.col("equal_tie"))
    group = saved(met.where(equal), "mix-equal").withColumn("row", F.monotonically_increasing_id())
    numbers = numbered_within(saved(group, "mix-equal"), "source", [F.col("row")], "number", "of").drop("row", "of")
    return out(met.where(~equal), again).unionAll(out(numbers, F.col("number") < F.col("equal_taken")))


def boundary(base: DataFrame, at: DataFrame, digits: str) -> DataFrame:
    """(s, need, prefix, sum_before, words, rows): for each source of ``at`` (s, need, sum_before) the value of ``digits`` at which its budget ends.

    ``base`` is (source, size, digits). A source whose sum stays within its need isn't there.
    """
    at = at.select("s", "need", F.lit(0).cast("long").alias("prefix"), "sum_before")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        above, here = HASH_BITS - (level - 1) * LEVEL_BITS, HASH_BITS - level * LEVEL_BITS
        bucket = F.shiftright(digits, here)
        sums = [F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")]
        inside = base.groupBy("source", bucket.alias("bucket")).agg(*sums) if level == 1 else base.withColumn("bucket", bucket)
        hist = inside.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", above - here) == F.col("prefix")))
        if level > 1:  # only the boundary bucket's documents are left
            hist = hist.groupBy("s", "need", "prefix", "sum_before", "bucket").agg(*sums)
        running = F.sum("words").over(W.partitionBy("s").orderBy("bucket"))
        hist = hist.withColumn("sum_to", F.col("sum_before") + running)
        first = F.min(F.struct(F.col("bucket").alias("b"), F.col("sum_to").alias("to"), F.col("words").alias("w"), F.col("rows").alias("r")))
        over = hist.where("sum_to > need").groupBy("s", "need").agg(first.alias("x"))
        at = saved(over.select("s", "need", F.col("x.b").alias("prefix"), (F.col("x.to") - F.col("x.w")).alias("sum_before"), F.col("x.w").alias("words"), F.col("x.r").alias("rows")), "mix-level")
    return at


def thresholds(base: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, whole, threshold, tie_hash, tie_threshold, equal_tie, equal_taken) from rows (source, size, hash, tie)."""
    t = source_targets(base, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    t = saved(t, "mix-targets")
    names = ("tie_hash", "tie_threshold", "equal_tie", "equal_taken")
    none = [F.lit(None).cast("long").alias(c) for c in names]
    if base.isEmpty():
        return t.select("source", "source_size", "target", "whole", F.lit(0).cast("long").alias("threshold"), *none)
    at = boundary(base, t.select(F.col("source").alias("s"), "need", F.lit(0).cast("long").alias("sum_before")), "hash")
    # The boundary document is taken if at least half of it fits.
    half = F.col("sum_before") + F.col("words") / 2 <= F.col("need")
    end = at.where("rows = 1").select("s", F.when(half, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"), *none)
    several = at.where("rows > 1")
    if not several.isEmpty():
        ties = several.select(F.col("s").alias("ts"), F.col("prefix").alias("th"))
        inside = base.join(ties, F.col("source").eqNullSafe(F.col("ts")) & (F.col("hash") == F.col("th"))).select("source", "size", "tie")
        shared = boundary(inside, several.select("s", "need", "sum_before"), "tie").withColumnsRenamed({"s": "ts", "prefix": "tie_at", "sum_before": "tie_before", "words": "tie_words", "rows": "tie_rows"}).drop("need")
        met = several.join(shared, F.col("s").eqNullSafe(F.col("ts")))
        alone = F.col("tie_rows") == 1
        fits = F.col("tie_before") + F.col("tie_words") / 2 <= F.col("need")
        taken = F.round((F.col("need") - F.col("tie_before")) * F.col("tie_rows") / F.greatest("tie_words", F.lit(1))).cast("long")
        tied = met.select(
            "s", F.col("prefix").alias("threshold"), F.col("prefix").alias("tie_hash"), F.when(alone & fits, F.col("tie_at") + 1).otherwise(F.col("tie_at")).alias("tie_threshold"),
            F.when(~alone, F.col("tie_at")).alias("equal_tie"), F.when(~alone, taken).alias("equal_taken"),
        )
        end = end.unionByName(tied)
    top = F.coalesce("threshold", F.lit(1 << HASH_BITS).cast("long"))
    return t.join(end, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", top.alias("threshold"), *names)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Joins the thresholds, not the rows."""
    counts = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash"), text_hash(F.col("text")).alias("tie"))
    limits = saved(thresholds(saved(counts, "mix-sizes"), options.get("weights", WEIGHTS), options.get("share", 1.5), options.get("most", 2.0)), "mix-thresholds")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", id_hash(F.col("doc_id")).alias("hash"), text_hash(F.col("text")).alias("tie"))
    again = with_limits(rows, limits).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
