"""A Merkle manifest of a dataset as a persistent tree with path copying.

Each source is a tree of runs of 16; the sources' roots are the leaves of one tree above. The work
goes by aligned blocks of 16^3 leaves (``height`` levels): one group hashes a block's nodes, the blocks' roots are the
leaves of the next blocks, until one node is left. On the way back each block learns the path from
its root to the root of all.

A tampered leaf makes a version of the tree. A version copies the ancestors of its leaf and shares
every other node with the first version: it copies the ancestors within its aligned block there, and
goes on with the copied block root along the block's path.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.numbering import numbered_within
from voxloom.llm.scratch import saved

#: Nodes of a run; levels of an aligned block.
FAN, BLOCK_LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tampering takes the documents whose id's crc32 is divisible by it.
EVERY = 5
#: Sources up to which the tree above them is broadcast.
BROADCAST_SOURCES = 100_000
PATH = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("siblings", T.BinaryType())]))
COPIES = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("digest", T.StringType())]))


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of the fields, each '-' if null, else its byte count, ':' and itself."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]).cast("binary"), 256)


def levels(nodes: list[bytes], total: int, most: int) -> list[list[bytes]]:
    """The nodes of an aligned block by level, from its leaves up to ``most`` levels, in a tree of ``total`` leaves."""
    out = [nodes]
    while total > 1 and len(out) <= most:
        below = out[-1]
        out.append([digest(b"".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        total = -(-total // FAN)
    return out


def siblings(block: list[list[bytes]], i: int) -> list[tuple[int, bytes]]:
    """(place in its run, the run's other digests) of leaf ``i`` and its ancestors below the block's root."""
    path = []
    for nodes in block[:-1]:
        low = i - i % FAN
        run = nodes[low : low + FAN]
        path.append((i - low, b"".join(run[: i - low]) + b"".join(run[i - low + 1 :])))
        i //= FAN
    return path


def fold(node: bytes, path: list[tuple[int, bytes]]) -> list[bytes]:
    """Copies of the ancestors of ``node`` along ``path``, from the lowest on."""
    copied = []
    for at, others in path:
        cut = at * len(node)
        node = digest(others[:cut] + node + others[cut:])
        copied.append(node)
    return copied


def numbered_leaves(docs: DataFrame) -> DataFrame:
    """(source, place, total, doc_id, leaf, tampered) of each row; ``tampered`` is null where nothing is tampered with."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    lower = F.translate(fields["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(fields["doc_id"].cast("string").cast("binary")) % EVERY == 0
    other = F.when(hit, leaf_digest(fields | {"text": lower}))
    # '0' for no source, '1' before a name: the same order, and grouping takes no nulls.
    source = F.coalesce(F.concat(F.lit("1"), fields["source"]), F.lit("0"))
    rows = docs.select(source.alias("tree"), fields["doc_id"].cast("long").alias("doc_id"), leaf_digest(fields).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")]
    return numbered_within(saved(rows, "merkle-leaves"), "tree", order, "place", "total").drop("row")


def in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {FAN**height}"))


def by_place(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, place, total, leaf): the roots of the aligned blocks of ``nodes`` as leaves of the next blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = by_place(table)
        total = table["total"][0].as_py()
        root = levels([x.encode() for x in table["leaf"].to_pylist()], total, height)[-1]
        return pa.table({"tree": table["tree"][:1], "place": table["block"][:1], "total": pa.array([-(-total // FAN**height)], pa.int64()), "leaf": [root[0].decode()]})

    return in_blocks(nodes, height).select("tree", "block", "place", "total", "leaf").groupBy("tree", "block").applyInArrow(run, "tree string, place long, total long, leaf string")


def paths_from_blocks(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, block, path, top): for each aligned block of ``nodes`` the path from its root to the tree's root ``top``."""
    roots = saved(block_roots(nodes, height), "merkle-roots")
    if roots.where("total > 1").isEmpty():
        return roots.select("tree", F.col("place").alias("block"), F.lit(None).cast(PATH).alias("path"), F.col("leaf").alias("top"))
    above = paths_from_blocks(roots, height)

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = by_place(table)
        block = levels([x.encode() for x in table["leaf"].to_pylist()], table["total"][0].as_py(), height)
        rest, top = upper["path"][0].as_py() or [], upper["top"][0].as_py()
        paths = [[{"at": at, "siblings": s} for at, s in siblings(block, i)] + rest for i in range(table.num_rows)]
        return pa.table({"tree": table["tree"], "block": table["place"], "path": pa.array(paths, PATH_ARROW), "top": [top] * table.num_rows})

    lower = in_blocks(roots, height).groupBy("tree", "block")
    return saved(lower.cogroup(above.groupBy("tree", "block")).applyInArrow(run, T.StructType([T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("path", PATH), T.StructField("top", T.StringType())])), "merkle-paths")


PATH_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.binary())]))
COPIES_ARROW = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())]))
MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tree string, place long"


def above_sources(subroots: DataFrame, height: int) -> DataFrame:
    """(tree, forest, number, root) of the sources: number and path of each in the tree over all sources."""
    everyone = numbered_within(subroots.withColumn("all", F.lit("")), "all", [F.col("source_tree")], "place", "total")
    nodes = saved(everyone.select(F.col("all").alias("tree"), "place", "total", F.col("subroot").alias("leaf"), "source_tree"), "merkle-sources")

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = by_place(table)
        block = levels([x.encode() for x in table["leaf"].to_pylist()], table["total"][0].as_py(), height)
        rest, top = upper["path"][0].as_py() or [], upper["top"][0].as_py()
        paths = [[{"at": at, "siblings": s} for at, s in siblings(block, i)] + rest for i in range(table.num_rows)]
        return pa.table({"source_tree": table["source_tree"], "number": table["place"], "forest": pa.array(paths, PATH_ARROW), "root": [top] * table.num_rows})

    schema = T.StructType([T.StructField("source_tree", T.StringType()), T.StructField("number", T.LongType()), T.StructField("forest", PATH), T.StructField("root", T.StringType())])
    return in_blocks(nodes, height).groupBy("tree", "block").cogroup(paths_from_blocks(nodes, height).groupBy("tree", "block")).applyInArrow(run, schema)


def manifest(docs: DataFrame, height: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tree, place, copies of each row.

    ``copies`` are the nodes that the row's version of the tree has of its own, from the leaf to the
    root: level, place in the level, digest; null where nothing is tampered with. Levels go on through
    the tree over the sources, whose leaves are the subroots in the order of sources. ``proof_sha256`` is of the siblings of the leaf and all its ancestors.

    Null ids come first in their source and are never tampered with; rows of one id are ordered by
    their leaves, equal rows are interchangeable. Empty and null texts have leaves of their own; long
    texts are hashed whole. A tampered text without A-Z has the same leaf and is verified. An empty
    table gives an empty result; other columns are ignored.
    """
    leaves = saved(numbered_leaves(docs), "merkle-numbered")
    upper = paths_from_blocks(leaves, height)
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], T.StructType([*T._parse_datatype_string(MANIFEST).fields, T.StructField("copies", COPIES)]))
    subroots = upper.where("block = 0").select(F.col("tree").alias("source_tree"), F.col("top").alias("subroot"))
    forest = saved(above_sources(subroots, height), "merkle-forest")
    forest = F.broadcast(forest) if forest.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else forest.hint("merge")
    upper = upper.join(forest, F.col("tree") == F.col("source_tree")).drop("source_tree")

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = by_place(table)
        leaf, places = [x.encode() for x in table["leaf"].to_pylist()], table["place"].to_pylist()
        block = levels(leaf, table["total"][0].as_py(), height)
        to_subroot = [(p["at"], p["siblings"]) for p in above["path"][0].as_py() or []]
        to_root = [(p["at"], p["siblings"]) for p in above["forest"][0].as_py() or []]
        subroot, root, number = above["top"][0].as_py(), above["root"][0].as_py(), above["number"][0].as_py()
        tail = b"".join(s for _, s in to_subroot + to_root)
        known: dict[bytes, list[bytes]] = {}  # versions with the same block root share what is above
        proofs, folded, copies = [], [], []
        for i, other in enumerate(table["tampered"].to_pylist()):
            own = siblings(block, i)
            proofs.append(digest(b"".join(s for _, s in own) + tail).decode())
            start = other.encode() if other is not None else leaf[i]
            path = [start, *fold(start, own)]
            if path[-1] not in known:
                known[path[-1]] = fold(path[-1], to_subroot + to_root)
            path += known[path[-1]]
            folded.append(path[-1].decode())
            if other is None:
                copies.append(None)
                continue
            within = [places[i] // FAN**k for k in range(len(own) + len(to_subroot) + 1)]
            within += [number // FAN**k for k in range(1, len(to_root) + 1)]
            copies.append([{"level": k, "place": p, "digest": d.decode()} for k, (p, d) in enumerate(zip(within, path))])
        n = table.num_rows
        return pa.table({
            "doc_id": table["doc_id"], "leaf": table["leaf"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded,
            "verified": [f == root for f in folded], "tree": table["tree"], "place": table["place"], "copies": pa.array(copies, COPIES_ARROW),
        })

    schema = T.StructType([*T._parse_datatype_string(MANIFEST).fields, T.StructField("copies", COPIES)])
    return in_blocks(leaves, height).groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(run, schema)


def versions(found: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf_place, level, place, digest): the copied nodes of each version of a :func:`manifest`; all other nodes are shared."""
    return found.where("copies is not null").select("doc_id", "tree", F.col("place").alias("leaf_place"), F.inline("copies"))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the folded root is the version's own root."""
    found = manifest(docs)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
