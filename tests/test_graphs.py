"""Edit distances, cycles of histories and rows of trees against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.functions import distance
from voxloom.operators import quality, snapshots, tree


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, a, alphabet):
    b = list(a)
    for _ in range(r.randint(0, 9)):
        p, kind = r.randint(0, len(b)), r.randint(0, 2)
        if kind == 0 or not b:
            b.insert(p, r.choice(alphabet))
        elif kind == 1:
            del b[min(p, len(b) - 1)]
        else:
            b[min(p, len(b) - 1)] = r.choice(alphabet)
    return "".join(b)


@pytest.mark.parametrize("band", [1, 2, 5, 32])
def test_edit_distance(monkeypatch, band):
    monkeypatch.setattr(distance, "BAND", band)
    r = random.Random(band)
    for _ in range(700):
        alphabet = r.choice(["ab", "abcdef", "абвé😀"])
        a = "".join(r.choices(alphabet, k=r.randint(0, 70)))
        b = changed(r, a, alphabet) if r.random() < 0.6 else "".join(r.choices(alphabet, k=r.randint(0, 70)))
        assert distance.edit_distance(a, b) == plain_distance(a, b)


def test_error_rate_of_long_and_missing_recordings(spark):
    r = random.Random(1)
    long = "".join(r.choices("abcdefgh", k=20_000))
    other = long[:5_000] + "zz" + long[5_000:12_000] + "q" + long[12_001:]
    schema = "tid string, segment_index long, start_ms long, text string"
    ref = spark.createDataFrame([("a", 0, 0, long), ("b", 0, 0, "Only here"), ("d", 0, 0, None)], schema)
    hyp = spark.createDataFrame([("a", 0, 0, other), ("c", 0, 0, "abc")], schema)
    got = {x["tid"]: (x["distance"], x["length"]) for x in quality.cer(ref, hyp).collect()}
    assert got == {"a": (3, 20_000), "b": (8, 8), "c": (3, 1), "d": (0, 1)}


def has_cycle(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    state = {}

    def visit(x):
        state[x] = 1
        for y in after.get(x, ()):
            if state.get(y) == 1 or (y not in state and visit(y)):
                return True
        state[x] = 2
        return False

    return any(x not in state and visit(x) for x in list(after))


def test_cycles_of_random_graphs(spark):
    r = random.Random(8)
    rows, want = [], set()
    for g in range(150):
        n = r.randint(2, 14)
        if g % 3 == 0:  # any edges
            edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(1, 2 * n))}
        else:  # a history: one or two earlier parents; in a third of them one edge leads back
            edges = {(v, r.randrange(v)) for v in range(1, n)} | {(v, r.randrange(v)) for v in range(1, n) if r.random() < 0.4}
            if g % 3 == 1:
                low, high = sorted((r.randrange(n), r.randrange(n)))
                edges.add((low, high))
        rows += [(f"g{g}", a, b) for a, b in edges]
        if has_cycle(edges):
            want.add(f"g{g}")
    # Each revision merges the two before it: nothing can be passed over, only its ends go.
    rows += [("ladder", v, v - k) for v in range(2, 12) for k in (1, 2)] + [("knot", v, (v + k) % 7) for v in range(7) for k in (1, 2)]
    want.add("knot")
    got = {x["g"] for x in snapshots.cyclic_graphs(spark.createDataFrame(rows, "g string, a long, b long")).collect()}
    assert 20 < len(want) < 140 and got == want


def test_a_long_history_takes_few_rounds(spark, monkeypatch):
    tables, saved = [], snapshots.saved

    def counted(df, name):
        tables.append(name)
        return saved(df, name)

    monkeypatch.setattr(snapshots, "saved", counted)
    line = spark.range(10_000).select(F.lit("o").alias("original_id"), F.concat(F.lit("r"), "id").alias("revision"), F.when(F.col("id") > 0, F.concat(F.lit("r"), F.col("id") - 1)).alias("parent_revision"))
    line = line.withColumn("merge_a", F.lit(None).cast("string")).withColumn("merge_b", F.lit(None).cast("string")).withColumn("manifest", F.col("revision"))
    assert snapshots.validate_revision_graph(line).isEmpty()
    assert len(tables) < 20


def plain_rows(nodes, collapsed):
    below = {}
    for i, parent, position in nodes:
        below.setdefault(parent, []).append((position, i))
    out = {}

    def walk(parent, depth):
        for _, i in sorted(below.get(parent, [])):
            out[i] = (depth, len(out) + 1)
            if i not in collapsed:
                walk(i, depth + 1)

    walk(None, 0)
    return out


@pytest.mark.parametrize("collapsed", [(), ("n3", "n20", "n41")])
def test_rows_of_random_trees(spark, collapsed):
    r = random.Random(4)
    nodes = [(f"n{i}", None if i % 19 == 0 else f"n{r.randrange(max(0, i - 9), i)}", r.randint(0, 3)) for i in range(150)]
    nodes += [("lost", "nowhere", 0), ("below", "lost", 0), ("x", "y", 0), ("y", "x", 0), ("z", "x", 1)]
    table = spark.createDataFrame([(i, "folder", p, i, k) for i, p, k in nodes], "id string, kind string, parent_id string, name string, position long")
    got = {x["id"]: (x["depth"], x["row"]) for x in tree.visible_tree(table, collapsed).collect()}
    assert got == plain_rows(nodes, set(collapsed))


def plain_reconcile(local, remote, base):
    """Folder by folder, in the manifest's order; rows are id -> (name, parent, position)."""
    now, new = dict(local), set()
    for i, (name, _, position) in remote.items():
        if i not in now:
            now[i] = (name, None, max(position, 0))
            new.add(i)
        elif i in base and now[i][0] == base[i][0]:
            now[i] = (name, *now[i][1:])
    for i, (_, parent, position) in remote.items():
        if i in new or (i in base and base[i][1:] == now[i][1:]):
            at, seen = parent, set()
            while at is not None and at != i and at not in seen:
                seen.add(at)
                at = now[at][1] if at in now else None
            if at is None:
                now[i] = (now[i][0], parent, max(position, 0))
    return {i: (*now[i], i in new) for i in remote}


def test_reconciled_folders_equal_the_plain_rule(spark):
    r = random.Random(6)
    tables, want = {"l": [], "r": [], "b": []}, {}
    for t in range(60):
        n = r.randint(2, 9)
        forest = lambda: {f"f{i}": (r.choice("xy"), None if i == 0 or r.random() < 0.3 else f"f{r.randrange(i)}", r.randint(0, 1)) for i in range(n)}  # noqa: B023, E731

        def renamed(x):
            order = list(range(n))  # noqa: B023
            r.shuffle(order)
            to = {f"f{i}": f"f{k}" for i, k in enumerate(order)}
            return {to[i]: (a, to.get(p), k) for i, (a, p, k) in x.items()}

        base = renamed(forest())
        local = {i: v if r.random() < 0.6 else (v[0] + "!", *v[1:]) for i, v in base.items() if r.random() < 0.9} if r.random() < 0.5 else renamed(forest())
        local = {i: (a, p if p in local else None, k) for i, (a, p, k) in local.items()}
        remote = renamed(forest())
        base = {i: local.get(i, v) if r.random() < 0.7 else v for i, v in base.items()}
        items = list(remote.items())
        r.shuffle(items)
        want |= {(f"t{t}", i): v for i, v in plain_reconcile(local, dict(items), base).items()}
        for key, nodes in (("l", local), ("b", base)):
            tables[key] += [(f"t{t}", i, *v, 0) for i, v in nodes.items()]
        tables["r"] += [(f"t{t}", i, *v, k) for k, (i, v) in enumerate(items)]
    frame = {k: spark.createDataFrame(v, "tree string, id string, name string, parent_id string, position long, ordinal int") for k, v in tables.items()}
    got = tree.reconcile_restored_folders(frame["l"].drop("ordinal"), frame["r"], frame["b"].drop("ordinal")).collect()
    assert {(x["tree"], x["id"]): (x["name"], x["parent_id"], x["position"], x["imported"]) for x in got} == want
    kept = sum(want[(t, i)][1] != p for t, i, _, p, _, _ in tables["r"])
    assert kept > 20


def test_a_move_beside_a_cycle_is_made(spark):
    schema = "id string, name string, parent_id string, position long"
    base = spark.createDataFrame([("a", "A", None, 0), ("c", "C", None, 0), ("d", "D", None, 0)], schema)
    local = base.withColumn("parent_id", F.when(F.col("id") == "c", "a").otherwise(F.col("parent_id")))
    remote = base.withColumn("parent_id", F.when(F.col("id") == "a", "c").when(F.col("id") == "d", "a").otherwise(F.col("parent_id")))
    got = {x["id"]: x["parent_id"] for x in tree.reconcile_restored_folders(local, remote, base).collect()}
    assert got == {"a": None, "c": "a", "d": "a"}


def test_bad_sources_are_refused_whole(spark):
    rows = [("cycle", "a", "A", "b"), ("cycle", "b", "B", "a"), ("cycle", "c", "C", None), ("parent", "a", "A", "zz"), ("name", "a", "  ", None), ("long", "a", "é" * 513, None), ("id", "", "A", None), ("good", "a", "é" * 512, None)]
    rows += [("deep", f"d{i}", "D", f"d{i - 1}" if i else None) for i in range(65)] + [("edge", f"d{i}", "D", f"d{i - 1}" if i else None) for i in range(64)]
    remote = spark.createDataFrame([(*x, 0) for x in rows], "tree string, id string, name string, parent_id string, position long")
    assert {tuple(x) for x in tree.rejected_sources(remote).collect()} == {("cycle", "parent"), ("parent", "parent"), ("name", "name"), ("long", "name"), ("id", "id"), ("deep", "depth")}
    found = tree.reconcile_restored_folders(remote.limit(0), remote, remote.limit(0))
    assert {x["tree"] for x in found.collect()} == {"good", "edge"}


def test_restored_lines_of_one_number_and_part(spark, tmp_path):
    from voxloom.plans import registry

    lines = [(1, 7, 2, 9, 1.0, "R"), (1, 7, 2, 3, 2.0, "A"), (1, 7, 2, 3, 1.0, "N"), (1, 8, 1, 1, 1.0, "X"), (1, 12_000_000_001, 1, 5, 1.0, "Y"), (2, 7, 1, 4, 1.0, "B"), (2, 7, 1, 2, 1.0, "C")]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string"
    for d, rows in (("a", lines), ("b", lines[::-1])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{d}/lineitem.parquet")
        restored = registry.QUERIES["j27_restore_snapshots"](spark, f"{tmp_path}/{d}").select("original_id", "texts").collect()
        assert {tuple(r) for r in restored} == {("z1", "XYNAR"), ("z2", "CB")}
