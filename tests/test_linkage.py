"""Average-linkage clusters against the plain rule: the best pair merges, one after another; lone vectors join in turn."""

import numpy as np

from voxloom.operators import linkage, speakers


def plain(x, least=0.58):
    sims = x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = (0, 0, -np.inf)
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                score = round(float(sims[np.ix_(groups[i], groups[j])].sum()) / (len(groups[i]) * len(groups[j])), 12)
                if score > best[2]:
                    best = (i, j, score)
        if best[2] < least:
            break
        groups[best[0]] += groups.pop(best[1])
    if any(len(g) > 1 for g in groups):
        while (lone := next((i for i, g in enumerate(groups) if len(g) == 1), None)) is not None:
            member = groups[lone][0]
            target, high = None, -np.inf
            for j, g in enumerate(groups):
                score = round(float(sims[member, g].sum()) / len(g), 12)
                if len(g) > 1 and score >= high:
                    target, high = j, score
            groups[target].append(member)
            groups.pop(lone)
    out = [0] * len(x)
    for k, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = k
    return out


def inputs(r, kind):
    n = int(r.integers(1, 26))
    if kind == 0:  # few signs, so exact ties abound
        return r.choice([-0.5, 0.5], size=(n, 4))
    if kind == 1:
        return np.eye(4)[r.integers(0, 4, n)]
    voices = 2 if kind == 2 else 5
    x = r.normal(size=(voices, 8))[r.integers(0, voices, n)] + r.choice([0.3, 0.7, 1.2]) * r.normal(size=(n, 8))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_linkage_equals_the_plain_rule():
    r = np.random.default_rng(11)
    for k in range(800):
        x = inputs(r, k % 4)
        assert linkage.average_linkage(x) == plain(x), (k, x.tolist())


def test_rounds_over_tables_equal_those_in_a_task(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for t in range(4):
        x = np.concatenate([inputs(r, t % 4) for _ in range(2)]) if t % 4 < 2 else np.concatenate([inputs(r, 3) for _ in range(3)])
        want[f"t{t}"] = linkage.average_linkage(x)
        rows += [(f"t{t}", 10 * i + 3, v.tolist()) for i, v in enumerate(x)]
    rows += [("bad", i, [0.0, 0.0]) for i in range(20)] + [("odd", i, [1.0] * (1 + i % 2)) for i in range(20)] + [("small", 1, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "tid string, window_id long, embedding array<double>")
    found = speakers.cluster(d, in_task=10, block=8).collect()
    assert len(found) == len(rows)
    for t, labels in want.items():
        assert [r["speaker"] for r in sorted((r for r in found if r["tid"] == t), key=lambda r: r["window_id"])] == labels
    assert {(r["tid"], r["status"], r["speaker"]) for r in found if not r["tid"].startswith("t")} == {("bad", "not finite", None), ("odd", "ragged", None), ("small", "ok", 0)}
