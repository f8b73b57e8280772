"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has many virtual nodes on a ring. A document goes to the shard of the first node clockwise
from the hash of its id; where that shard is full it goes on to the next one that isn't. Documents
are placed in the order of a second hash, so the outcome depends on no partitioning.

The sequential rule is carried out by phases: the set of full shards changes at most once a shard, and
between two changes every document goes to its first open shard. The document that fills the next
shard is found by histograms of nested digits of the order, of bounded size, and a window over the
last few rows. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.numbering import numbered_within
from voxloom.llm.scratch import saved

SHARDS, NODES = 8, 256
#: Places on the ring. Bits of a digit of the order, and rows that are sorted instead of split further.
RING_BITS, DIGIT_BITS, LAST_ROWS = 16, 10, 8192
#: Columns that order the documents, and their bits: hash of the id, hash of the text, number of the row.
ORDER = (("k1", 60), ("k2", 60), ("k3", 60))


def ring(spark: SparkSession, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """(place, prefs): for each place of the ring, the shards in the order in which they come clockwise.

    A table of 2^16 rows, whatever the data. Of nodes at the same place the lower shard comes first.
    """
    size = 1 << RING_BITS
    token = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id") % shards, F.floor(F.col("id") / shards)).cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")
    tokens = spark.range(shards * nodes).select((F.col("id") % shards).alias("shard"), token.alias("at"))
    # Every place asks for each shard's next node: its first node at or after the place, or its first of all on the next turn.
    own = tokens.groupBy("shard").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    arcs = own.select("shard", F.explode(F.arrays_zip(F.concat(F.array(F.lit(-1).cast("long")), "ats").alias("low"), F.concat("ats", F.array(F.get("ats", F.lit(0)) + size)).alias("next"))).alias("x"))
    low, high = F.col("x.low") + 1, F.least(F.col("x.next"), F.lit(size - 1))
    reach = arcs.where(low <= high).select("shard", F.col("x.next").alias("next"), F.explode(F.sequence(low, high)).alias("place"))
    prefs = F.transform(F.array_sort(F.collect_list(F.struct((F.col("next") - F.col("place")).alias("d"), "shard"))), lambda s: s["shard"].cast("int"))
    return reach.groupBy("place").agg(prefs.alias("prefs"))


def hash_bits(salt: str, key: Column, digits: int) -> Column:
    """The first ``digits`` hexadecimal digits of the md5 of salt and key, as a number; null is a key of its own."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, digits), 16, 10).cast("long")


def after(key: tuple[int, ...] | None) -> Column:
    """True for the rows that come later in the order than ``key``."""
    if key is None:
        return F.lit(True)
    (name, _), value = ORDER[-1], key[-1]
    later = F.col(name) > value
    for (name, _), value in reversed(list(zip(ORDER[:-1], key[:-1]))):
        later = (F.col(name) > value) | ((F.col(name) == value) & later)
    return later


def first_open(full: set[int]) -> Column:
    """The first of ``prefs`` that isn't full."""
    return F.element_at(F.filter("prefs", lambda s: ~s.isin(*full)) if full else F.col("prefs"), 1)


def next_full(rows: DataFrame, full: set[int], room: dict[int, int]) -> tuple[tuple[int, ...], int, dict[int, int]] | None:
    """(key, shard, taken by each shard until then) of the document that fills a shard first among ``rows``; None if none is filled.

    One job a digit; each collects at most shards * 2^DIGIT_BITS counts.
    """
    taken = dict.fromkeys(room, 0)
    rows = rows.withColumn("shard", first_open(full))
    digits = [(name, shift) for name, bits in ORDER for shift in range(bits - DIGIT_BITS, -1, -DIGIT_BITS)]
    inside = []
    for name, shift in digits:
        here = reduce(lambda a, b: a & b, inside, F.lit(True))
        hist = rows.where(here).groupBy("shard", F.shiftright(name, shift).alias("d")).count().collect()
        by_digit: dict[int, dict[int, int]] = {}
        for r in hist:
            by_digit.setdefault(r["d"], {})[r["shard"]] = r["count"]
        for d, counts in sorted(by_digit.items()):
            if any(taken[s] + n >= room[s] for s, n in counts.items()):
                break
            for s, n in counts.items():
                taken[s] += n
        else:
            return None
        # Digits of one column refine each other, so only the last condition on a column is kept.
        inside = inside[: [n for n, _ in ORDER].index(name)] + [F.shiftright(name, shift) == d]
        if sum(counts.values()) <= LAST_ROWS or (name, shift) == digits[-1]:
            break
    last = rows.where(reduce(lambda a, b: a & b, inside)).select("shard", F.struct(*[n for n, _ in ORDER]).alias("key"))
    # At most LAST_ROWS rows: each shard's row that takes its last room, the first of them, and what the others took by then.
    need = F.element_at(F.create_map(*[F.lit(x) for s in room for x in (s, room[s] - taken[s])]), F.col("shard"))
    ordered = last.groupBy("shard").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    key, shard = ordered.where(F.size("keys") >= need).select(F.min(F.struct(F.element_at("keys", need.cast("int")).alias("k"), "shard")).alias("x")).select("x.k", "x.shard").first()
    counts = ordered.select("shard", F.size(F.filter("keys", lambda k: k <= F.struct(*[F.lit(v).cast("long").alias(n) for (n, _), v in zip(ORDER, key)]))).alias("n")).collect()
    for r in counts:
        taken[r["shard"]] += r["n"]
    return tuple(key), shard, taken


def assigned(docs: DataFrame, shards: int = SHARDS, slack: float = 0.0, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, home, number order) of each row; ``home`` is the shard before loads are bounded.

    A shard holds at most ceil((1 + slack) * rows / shards) rows; without slack the first shards hold one
    row more than the last ones, if rows don't divide evenly. Null counts as empty text; a null id is
    one key. Rows of one id start at the same place, in the order of their texts; equal rows are
    interchangeable. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    doc_id, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    base = docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), hash_bits("at:", doc_id, RING_BITS // 4).alias("place"),
        hash_bits("order:", doc_id, 15).alias("k1"), F.shiftrightunsigned(F.xxhash64(text), 4).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    )
    base = saved(base.join(F.broadcast(ring(spark, shards, nodes)), "place").drop("place"), "ring-keys")
    n = base.count()
    if slack:
        room = dict.fromkeys(range(shards), -int(-(1 + slack) * n // shards))
    else:
        room = {s: n // shards + (s < n % shards) for s in range(shards)}
    full = {s for s in room if room[s] == 0}
    phases: list[tuple[tuple[int, ...] | None, set[int]]] = [(None, full)]
    while n and len(full) < shards - 1:
        found = next_full(base.where(after(phases[-1][0])), full, {s: r for s, r in room.items() if s not in full})
        if found is None:
            break
        key, shard, taken = found
        full = full | {shard}
        room = {s: r - taken.get(s, 0) for s, r in room.items()}
        phases.append((key, full))
    shard = first_open(phases[0][1]) if n else F.lit(0)
    for key, closed in phases[1:]:
        shard = F.when(after(key), first_open(closed)).otherwise(shard)
    return base.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.element_at("prefs", 1).alias("home"), *[k for k, _ in ORDER])


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home: each row's shard and its gapless number there.

    The law is ``rows``: counts of shards are at most one apart. grown_shard is null under that law.
    """
    rows = numbered_within(assigned(docs, **options), "shard", [F.col(k) for k, _ in ORDER], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home")
