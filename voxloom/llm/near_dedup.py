"""MinHash near-dedup by an inverted join over signature coordinates.

Documents are posted under each (coordinate, value) of their MinHash signature. A pair is a
candidate if at least ``least`` of the coordinates agree, so it must meet in the lists of the
``coordinates - least + 1`` rarest values of either document: only that prefix is merged. The
longer lists are skipped; what is left of the count is read from the two signatures. Candidates
are confirmed on the full shingle sets.

Components need no list of all pairs. Documents with equal sets are one class. In every list
each member is first compared with one leader, the member whose signature is commonest, then, if it
is still apart, with some more leaders. Last, of the lists whose members are still in different
components, the full sets are joined by their rarest shingles. So a family of n near copies costs
about n comparisons, and no link between two components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm import arrow_text as A
from voxloom.llm.graph import connected_components
from voxloom.llm.scratch import saved


@dataclass(frozen=True)
class Similarity:
    """Shingle width, Jaccard threshold in percent, signature coordinates, and how many must agree.

    With 32 coordinates and 17 agreements, a pair at 85 % is missed with a probability of 3e-6.
    """

    width: int = 5
    percent: int = 80
    coordinates: int = 32
    least: int = 15
    seed: int = 1


#: Leaders of a list in the second round.
SHARES = 8
#: The similarity of the contract of the query: three words, 85 %.
CONTRACT = Similarity(width=3, percent=85, least=17)


def _multipliers(s: Similarity) -> np.ndarray:
    return A.mix(np.arange(1, s.coordinates + 1, dtype=A.U64) + A.U64(s.seed << 20)) | A.U64(1)


def signatures(docs: DataFrame, s: Similarity, text_col: str) -> DataFrame:
    """Adds n_shingles, set_a, set_b (a 128-bit fingerprint of the set) and signature (one number per coordinate)."""
    mult = _multipliers(s)

    def fn(column: pa.Array) -> list[pa.Array]:
        out = [], [], [], []
        for i, j, data, off in A.slices(column):
            sets, at = A.shingle_sets(A.Words(data, off, A.NON_SPACE), s.width)
            n, has = np.diff(at), np.flatnonzero(np.diff(at))
            prints, sig = np.zeros((2, j - i), A.U64), np.zeros((j - i, s.coordinates), np.int64)
            if len(has):
                at = at[has]
                for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
                    prints[k, has] = np.add.reduceat(A.mix(sets ^ A.U64(salt)), at)
                for k, m in enumerate(mult):
                    sig[has, k] = (np.minimum.reduceat((sets * m) >> A.U64(32), at) | A.U64(k << 32)).astype(np.int64)
            values = pa.array(sig[has].reshape(-1))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, s.coordinates, 0))]).astype(np.int32)
            for x, new in zip(out, (pa.array(n.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), values))):
                x.append(new)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return [pa.concat_arrays(x) if x else pa.array([], k) for x, k in zip(out, kinds)]

    long = T.LongType()
    return A.annotate(docs, text_col, [T.StructField("n_shingles", long), T.StructField("set_a", long), T.StructField("set_b", long), T.StructField("signature", T.ArrayType(long))], fn)


def sets_of(docs: DataFrame, width: int, text_col: str) -> DataFrame:
    """Adds ``shingles``, the sorted distinct shingles as numbers."""

    def fn(column: pa.Array) -> list[pa.Array]:
        out = []
        for _, _, data, off in A.slices(column):
            sets, at = A.shingle_sets(A.Words(data, off, A.NON_SPACE), width)
            out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.astype(np.int64))))
        return [pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))]

    return A.annotate(docs, text_col, [T.StructField("shingles", T.ArrayType(T.LongType()))], fn)


def agreements(a: Column, b: Column) -> Column:
    """Coordinates in which two signatures agree; values carry their coordinate."""
    return F.size(F.array_intersect(a, b))


def near_duplicates(docs: DataFrame, similarity: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, class_size (rows with an equal set), kept.

    A document without words (or null) has an empty set and is linked with nothing. Rows that repeat
    an id are one node. Null ids are each linked with nothing. An empty table gives an empty result;
    other columns are ignored.
    """
    s = similarity
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = saved(signatures(source, s, "text").drop("text"), "near-signatures")
    full = signed.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_same"), F.first("signature").alias("signature"))
    classes = saved(classes, "near-classes")
    links = class_links(source, classes.select(F.col("rep").alias("id"), "signature"), s)
    # An id that repeats with other texts is in several classes; these edges tie them.
    own = full.join(classes.select("set_a", "set_b", "rep", "n_same"), ["set_a", "set_b"]).select("id", "n_shingles", "rep", "n_same")
    repeated = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id", "a")
    ties = own.join(repeated, "id").where("a <> rep").select("a", F.col("rep").alias("b"))
    links = links.union(ties)
    parts = connected_components(links)
    own = own.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    alone = signed.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(1).cast("long").alias("n_same"))
    rows = own.select("id", "n_shingles", "component_id", "n_same").unionAll(alone)
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("n_same").alias("class_size"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def class_links(source: DataFrame, reps: DataFrame, s: Similarity) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to join every component."""
    prefix = s.coordinates - s.least + 1
    tokens = reps.select("id", F.explode("signature").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = tokens.join(common, "token")
    # At most one row per coordinate, so the groups are bounded.
    lists = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("found"), F.sum("df").alias("score"))
    room = F.lit(prefix - s.coordinates) + F.size("found")
    lists = lists.withColumn("found", F.when(room > 0, F.slice("found", 1, room)).otherwise(F.array().cast(lists.schema["found"].dataType)))
    postings = lists.select("id", "score", F.explode("found").alias("x")).select("id", "score", F.col("x.token").alias("token"))
    postings = saved(postings, "near-postings")

    # First one leader a list, then, where parts of a list are still apart, one in each of some shares of it.
    found = confirmed(source, reps, star(postings.withColumn("part", F.col("id")), F.lit(0)), s)
    placed = split_lists(postings, found)
    found = saved(found.union(confirmed(source, reps, star(placed, F.pmod(F.hash("id"), F.lit(SHARES))), s)), "near-links")
    # Last, the documents of the lists that are still split.
    return found.union(confirmed(source, reps, apart_pairs(source, split_lists(postings, found), s), s))


def apart_pairs(source: DataFrame, placed: DataFrame, s: Similarity) -> DataFrame:
    """(a, b): pairs of documents of ``placed`` in different components that may reach the similarity.

    The sets are put in one order, rare shingles first. A pair that reaches the similarity shares a
    shingle among the first of both, and behind their first shared one enough must be left of either.
    So a document with many shingles of its own meets nobody, however large its family is.
    """
    parts = placed.select("id", "part").distinct()
    texts = source.join(parts.hint("merge"), "id")
    sets = saved(sets_of(texts, s.width, "text").select("id", "part", "shingles").dropDuplicates(["id"]), "near-apart")
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # The shingles of one document, so no more than its text.
    held = each.join(shared.hint("merge"), "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    ranked = sets.select("id", "part", F.size("shingles").alias("n")).join(held.hint("merge"), "id").withColumn("own", F.col("n") - F.size("held"))
    reach = F.col("n") + 1 - F.floor((F.col("n").cast("long") * s.percent + 99) / 100).cast("int") - F.col("own")
    first = F.slice("held", F.lit(1), F.greatest(reach, F.lit(0)))
    rows = ranked.select("id", "part", "n", "own", F.posexplode(first).alias("pos", "x"))
    rows = saved(rows.select("id", "part", "n", (F.col("n") - F.col("own") - F.col("pos")).alias("left"), F.col("x.shingle").alias("shingle")), "near-prefixes")
    size = rows.groupBy("shingle", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("shingle").agg(F.max_by("part", F.struct("m", "part")).alias("head"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "part", "n", "left")]
    outside = rows.join(size.hint("merge"), "shingle").where("part <> head").select("shingle", "head", *side("x"))
    once = (F.col("part_y") == F.col("head")) | (F.col("id_x") < F.col("id_y"))
    enough = F.least("left_x", "left_y").cast("long") * (100 + s.percent) >= s.percent * (F.col("n_x") + F.col("n_y"))
    near = outside.join(rows.select("shingle", *side("y")).hint("merge"), "shingle").where((F.col("part_x") != F.col("part_y")) & once & enough)
    return near.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def star(placed: DataFrame, share: Column) -> DataFrame:
    """(a, b): each member of a list and, of each share of the list, the member whose signature is commonest, if they are in different parts."""
    rows = placed.withColumn("share", share)
    leaders = rows.groupBy("token", "share").agg(F.max_by(F.struct("id", "part"), F.struct("score", -F.col("id"))).alias("l")).select("token", F.col("l.id").alias("leader"), F.col("l.part").alias("head"))
    met = placed.join(leaders, "token").where("part <> head")
    return met.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def split_lists(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with their component, of the lists that hold more than one."""
    placed = postings.join(connected_components(links), "id", "left").select("token", "id", "score", F.coalesce("component", "id").alias("part"))
    apart = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token")
    return saved(placed.join(apart, "token"), "near-placed")


def confirmed(source: DataFrame, reps: DataFrame, pairs: DataFrame, s: Similarity) -> DataFrame:
    """Those of the pairs (a, b) that agree in enough coordinates and reach the similarity on their full sets."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(agreements(F.col("sa"), F.col("sb")) >= s.least).select("a", "b")
    likely = saved(likely, "near-candidates")
    wanted = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    texts = source.join(wanted.hint("merge"), "id", "left_semi")  # neither side is small at scale
    sets = saved(sets_of(texts, s.width, "text").select("id", "shingles").dropDuplicates(["id"]), "near-sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    inter = F.size(F.array_intersect("sa", "sb"))
    exact = likely.join(side("a"), "a").join(side("b"), "b").withColumn("inter", inter)
    return saved(exact.where(100 * F.col("inter") >= s.percent * (F.size("sa") + F.size("sb") - F.col("inter"))).select("a", "b"), "near-links")
