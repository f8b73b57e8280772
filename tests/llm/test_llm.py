"""The training-data operators on small inputs: nulls, empty and repeated rows, ties, brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import arrow_text as A
from voxloom.llm import chat, decontam, exact_dedup, mixing, near_dedup, quality, range_coder, substring, token_files, toxicity, url_rules
from voxloom.llm.tokenizing import PieceTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_word_kernels():
    texts = ["The cat", "", " É é\tx\n", "a" * 70_000 + " b", None]
    for _, _, data, off in A.slices(pa.array(texts)):
        w = A.Words(data, off, A.NON_SPACE)
        assert w.counts.tolist() == [2, 0, 3, 2, 0]
        assert w.text(0) == b"the"
    a = A.Words(np.frombuffer(b"one two", np.uint8), np.array([0, 7]), A.NON_SPACE).hashes
    b = A.Words(np.frombuffer(b"zz two one", np.uint8), np.array([0, 10]), A.NON_SPACE).hashes
    assert a[0] == b[2] and a[1] == b[1] and len(set(a) | set(b)) == 3


def test_exact_dedup(spark):
    long = "x" * 70_000
    d = docs(spark, "a", None, "", "a", long, long + "y", long, "A", "b" * 64, "b" * 64)
    got = by_id(exact_dedup.exact_duplicates(d), "keep_id", "group_size", "kept")
    assert got == {0: (3, 2, False), 3: (3, 2, True), 1: (2, 2, False), 2: (2, 2, True), 4: (6, 2, False), 6: (6, 2, True), 5: (5, 1, True), 7: (7, 1, True), 8: (9, 2, False), 9: (9, 2, True)}
    assert exact_dedup.exact_duplicates(d.limit(0)).count() == 0
    again = exact_dedup.exact_duplicates(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id long, text string"))
    assert sorted((r["group_size"], r["kept"]) for r in again.collect()) == [(1, True), (2, True), (2, True)]


def test_near_dedup(spark):
    base = words(60).split()
    near = base[:30] + ["other"] + base[31:]
    far = words(60, 1)
    d = docs(spark, " ".join(base), " ".join(base).upper().replace(" ", "\n"), " ".join(base[:-1] + ["z"]), far, None, "", "one two", "ONE two", " ".join(near))
    got = by_id(near_dedup.near_duplicates(d, near_dedup.CONTRACT), "component_id", "n_shingles")
    assert got[0][0] == got[1][0] == got[2][0] == 0 and got[3][0] == 3
    assert got[4] == (4, 0) and got[5] == (5, 0) and got[6] == (6, 1) and got[7] == (6, 1)
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0
    twice = near_dedup.near_duplicates(spark.createDataFrame([(2, " ".join(base)), (2, far), (5, far), (9, " ".join(base))], "doc_id long, text string"))
    assert {r["component_id"] for r in twice.collect()} == {2}


def test_near_dedup_equals_brute_force(spark):
    r = random.Random(3)
    base = words(80, 5).split()
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(80)] = "".join(r.choice("xyz") for _ in range(6))
        texts.append(" ".join(t))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(78)} for t in texts]
    part = list(range(60))
    for a in range(60):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= 85 * len(sets[a] | sets[b]) and part[a] != part[b]:
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = [new if p == old else p for p in part]
    got = by_id(near_dedup.near_duplicates(docs(spark, *texts), near_dedup.CONTRACT), "component_id")
    assert [got[i][0] for i in range(60)] == part


def test_rare_shingles_lose_no_pair(spark):
    """Every pair at the threshold is among those of the last step, and few others are."""
    r = random.Random(4)
    base, texts = words(90, 6).split(), []
    for _ in range(50):
        t = base[: r.randrange(80, 91)]
        for _ in range(r.randrange(8)):
            t[r.randrange(len(t))] = "".join(r.choice("xyz") for _ in range(6))
        texts.append(" ".join(t))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    linked = {(a, b) for b in range(50) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    source = docs(spark, *texts).select(F.col("doc_id").alias("id"), "text")
    placed = source.select("id", F.col("id").alias("part"))
    got = [(x["a"], x["b"]) for x in near_dedup.apart_pairs(source, placed, near_dedup.CONTRACT).collect()]
    assert len(got) == len(set(got)) and linked and linked <= set(got)
    assert len(got) < 50 * 49 // 2


def test_decontamination(spark):
    item = words(30, 2)
    bench = spark.createDataFrame([(7, item), (8, "Short one"), (9, None), (10, "")], "item_id long, text string")
    inside = words(10, 3) + " " + ", ".join(item.upper().split()[5:16]) + " " + words(5, 4)
    d = docs(spark, inside, "a SHORT-one b", None, "", " ".join(item.split()[:9]))
    got = by_id(decontam.contamination_report(d, bench), "n_words", "n_hit", "n_items", "contaminated")
    assert got == {0: (26, 11, 1, True), 1: (4, 2, 1, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False), 4: (9, 0, 0, False)}
    assert by_id(decontam.contamination_report(d, bench.limit(0)), "contaminated")[0] == (False,)
    assert decontam.contamination_report(d.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, words(30, i)) for i in range(6)], "item_id long, text string")
    d = docs(spark, words(30, 1) + " " + words(30, 4), "none")
    whole = decontam.contamination_report(d, bench)
    monkeypatch.setattr(decontam, "BLOCK_MB", 1)
    items = bench.withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.lit("- "), 100_000)))
    blocks = decontam.contamination_report(d, items, block_mb=1)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect()))


def test_mixing(spark):
    d = docs(spark, *["w " * (i + 1) for i in range(60)], None, sources=[["a", "b", None][i % 3] for i in range(61)])
    rows = mixing.mix_counts(d).collect()
    by = {}
    for r in rows:
        x = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        x[0] += r["size"] * r["copies"]
        assert r["copies"] <= 2
    assert sum(x[1] for x in by.values()) == pytest.approx(1.5 * sum(x[2] for x in by.values()))
    assert all(abs(x[0] - x[1]) <= 60 and x[1] <= 2 * x[2] for x in by.values())
    assert mixing.mix_counts(d.limit(0)).count() == 0
    assert mixing.mixed(d).count() == sum(r["copies"] for r in rows)


def test_toxicity(spark):
    texts = [words(30, i) + (" vilefolk awful" if i % 4 == 0 else "") for i in range(200)]
    d = docs(spark, *texts, None, "")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity_report(d, labels), "score", "predicted", "held_out")
    held = [i for i in range(200) if got[i][2]]
    assert held == [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i][1] == (i % 4 == 0) for i in held) and got[200][0] == got[201][0]
    assert by_id(toxicity.toxicity_report(d, labels.limit(0)), "score")[0][0] <= 1


def test_machine_learns_a_pair():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (800, 2))
    doc, term = np.nonzero(np.concatenate([x, np.ones((800, 1), int)], axis=1))
    y = (x[:, 0] & x[:, 1]).astype(float)
    m = toxicity.fit_machine(doc, term, y, np.ones(800), steps=400)
    p = m.logits(doc, term, 800) > 0
    assert (p == (y > 0)).mean() > 0.99


def test_quality(spark):
    texts = [words(40, i) if i % 3 else " | ".join(words(40, i).split()) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    got = by_id(quality.quality_report(docs(spark, *texts, None, ""), labels), "predicted", "held_out")
    held = [i for i in range(240) if got[i][1]]
    assert np.mean([got[i][0] == int(i % 3 > 0) for i in held]) > 0.9 and len(got) == 242


def test_range_coder():
    r = np.random.default_rng(1)
    blocks = [np.zeros(0, np.uint32), np.array([50_256], np.uint32), np.zeros(4096, np.uint32), r.integers(0, 50_257, 4096).astype(np.uint32), (r.zipf(1.3, 3000) % 50_257).astype(np.uint32)]
    coded = range_coder.encode_blocks(blocks)
    for a, b in zip(blocks, range_coder.decode_blocks(coded)):
        assert (a == b).all()
    assert (range_coder.decode_blocks([coded[4]])[0] == blocks[4]).all()  # blocks decode alone
    bad = bytearray(coded[3])
    bad[-100] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_blocks([bytes(bad)])


def test_tokens_are_the_library_s():
    t = PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "  a  b", "a\n\n b \t c ", "x <|endoftext|> y", "é ü　q z", words(50), "\r\n", "don't 12,5"] * 2
    ids, n = t.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    assert all(t.ids(x or "") == ids[at[i] : at[i + 1]].tolist() for i, x in enumerate(texts))


def test_token_files(spark):
    texts = [words(9, i) for i in range(30)] + [None, "", words(9000, 1)]
    d = docs(spark, *texts).repartition(3).union(docs(spark, "again"))
    rows = token_files.token_report(d).orderBy("start").collect()
    t = PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array(t.ids(x or "") + [0], "<u4") for i, x in enumerate(texts)}
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted([*range(33), 0])
    assert all(r["ids_crc32"] == zlib.crc32(want[r["doc_id"]].tobytes()) for r in rows if r["doc_id"])
    assert token_files.token_report(d.limit(0)).count() == 0


def test_passages(spark):
    shared = words(60, 9)
    edited = shared.split()
    edited.insert(30, "extra")
    texts = [words(40, 1) + " " + shared + " " + words(40, 2), shared.upper(), words(30, 3) + " " + " ".join(edited) + " " + words(20, 4), words(200, 5), " ".join(shared.split()[:40]), None, ""]
    d = docs(spark, *texts)
    got = {(r["doc_id"], r["source_id"]) for r in substring.repeated_passages(d).collect()}
    assert (1, 0) in got and (2, 0) in got and {x for x, _ in got} == {1, 2}
    spans = [r for r in substring.repeated_passages(d).collect() if r["doc_id"] == 1]
    assert (spans[0]["start_word"], spans[0]["end_word"], spans[0]["source_start"]) == (0, 60, 40)
    assert substring.repeated_passages(d.limit(0)).count() == 0


def test_passages_behind_a_document_without_them(spark):
    p = words(50, 9).split()
    # Documents 0 and 1 have the keys of the passage, not the passage; 2 and 3 have it.
    parts = [p[:42] + words(8, 10).split(), words(8, 11).split() + p[8:], p, p]
    texts = [" ".join([words(60, 20 + i), *x, words(60, 30 + i)]) for i, x in enumerate(parts)]
    sets = [[set(zip(*(t.split()[k:] for k in range(5)))) for t in (" ".join(t.split()[s : s + 50]) for s in range(121))] for t in texts]
    best = lambda a, b: max(len(x & y) / len(x | y) for x in sets[a] for y in sets[b])
    want = {(b, a) for b in range(4) for a in range(b) if best(a, b) >= 0.8}
    assert want == {(3, 2)}
    assert {(r["doc_id"], r["source_id"]) for r in substring.repeated_passages(docs(spark, *texts)).collect()} == want


@pytest.mark.parametrize("n", [50, 53, 57])
def test_passages_with_a_shifted_line_equal_brute_force(n, monkeypatch):
    monkeypatch.setattr(substring, "PLACES", 100)
    p, r, found = substring.Passages(), random.Random(n), 0
    number = lambda t: [zlib.crc32(" ".join(t[k : k + 5]).encode()) for k in range(len(t) - 4)]
    for seed in range(6):
        passage = words(n, seed).split()
        edited = list(passage)
        if seed % 3 == 2:  # words that repeat, and blocks in another order
            passage, edited = passage[:20] * 2 + passage[20:], passage[:20] + passage[20:] + passage[:20]
        else:
            place = r.randrange(5, n - 5)
            edited[place : place + seed % 3] = ["extra"] if seed % 3 == 0 else []
        a, b = (number(words(30, 50 + seed).split() + x + words(40, tail + seed).split()) for x, tail in ((passage, 60), (edited, 70)))
        sets = [[set(h[s : s + p.shingles]) for s in range(len(h) - p.shingles + 1)] for h in (a, b)]
        want = [s for s, x in enumerate(sets[0]) if any(len(x & y) >= 0.8 * len(x | y) for y in sets[1])]
        got = substring.repeats(np.array(a, np.uint64), np.array(b, np.uint64), p)
        starts = {s for x, y, _ in got for s in range(x, y - p.min_words + 1)}
        assert {*want} <= starts and {x for x, _, _ in got} <= {*want} and {y - p.min_words for _, y, _ in got} <= {*want}
        found += bool(want)
    assert found >= 4


def test_every_near_copy_is_a_candidate():
    p, lost = substring.Passages(), 0
    for seed in range(300):
        passage = words(50, seed).split()
        edited, place = list(passage), random.Random(seed).randrange(50)
        edited[place : place + seed % 2] = ["extra"]  # a word put in or another in its place
        text = [" ".join([words(60, 1000 + seed), *passage, words(60, 2000 + seed)]).encode(), " ".join([words(60, 3000 + seed), *edited, words(60, 4000 + seed)]).encode()]
        w = A.Words(np.frombuffer(b"".join(text), np.uint8), np.array([0, len(text[0]), len(text[0]) + len(text[1])]), A.NON_SPACE)
        keys, owner, _ = substring.compact_windows(*substring.positional(w, p.width), p)
        lost += not {*keys[owner == 0].tolist()} & {*keys[owner == 1].tolist()}
    assert lost == 0


def test_sliding_minimum():
    x = A.mix(np.arange(500, dtype=A.U64))
    for w in (1, 2, 46):
        low = (x >> A.U64(23)).astype(np.int64)
        assert substring.smallest(x, w).tolist() == [i + int(np.argmin(low[i : i + w])) for i in range(500 - w + 1)]


def test_urls(spark):
    urls = ["http://A.example.net/en/1?x", "https://b.net/", "http://c.net", "http://m.example.com/de/2", "http://x.org/fr/3#a", "nothing", None, "", "http://y.example.com/en/4"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.url_verdicts(d).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("b.net", "/", "net/", "block")
    assert got[2][:3] == ("c.net", "", None) and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][:3] == got[6][:3] == got[7][:3] == ("", "", None)
    assert url_rules.url_verdicts(d.limit(0)).count() == 0


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(2)
    urls = [f"http://{r.choice('abc')}.{r.choice(['example.com', 'example.net', 'site.org'])}/{r.choice(['de', 'en', 'fr'])}/{r.randrange(99)}" for _ in range(300)]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = url_rules.host_and_path(F.col("url"))
    rule, verdict = url_rules.given_rule(host, path)
    rows = d.select("page_id", url_rules.url_tokens(host, path).alias("t"), verdict.alias("v")).collect()
    labelled = [(set(x["t"]), x["v"]) for x in rows if x["v"]]
    for x in url_rules.mine_rules(spark.createDataFrame([(list(t), v) for t, v in labelled], "tokens array<string>, verdict string")).collect():
        hits = [v for t, v in labelled if set(x["left"]) <= t]
        assert x["confidence"] == pytest.approx(hits.count(x["verdict"]) / len(hits)) and x["confidence"] >= url_rules.CONFIDENCE


def test_chat(spark):
    t = [(1, 0, "user", "q"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, "user", "z")]
    rows = chat.preference_pairs(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")).collect()
    x = next(r for r in rows if r["pairing"] == "opening")
    assert (x["chosen_id"], x["rejected_id"], x["n_prompt_turns"]) == (1, 2, 1) and x["prompt"] == "<|user|>\nq<|end|>\n"
    assert [x["chosen_completion"][s["start"] : s["end"]] for s in x["chosen_mask"]] == ["yes<|end|>\n"]
    swap = {r["chosen_id"]: r["rejected_completion"] for r in rows if r["pairing"] == "swap"}
    assert swap == {1: "<|assistant|>\nno<|end|>\n", 2: ""}


def test_clashing_columns(spark):
    d = docs(spark, "one two three", "one two three").withColumns({c: F.lit(1) for c in ("id", "n_words", "signature", "toxicity_score", "hash", "size", "rest", "key")})
    assert exact_dedup.exact_duplicates(d).count() == near_dedup.near_duplicates(d).count() == mixing.mix_counts(d).count() == 2
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert decontam.contamination(d, bench).count() == 2 and substring.repeated_passages(d).count() == 0
