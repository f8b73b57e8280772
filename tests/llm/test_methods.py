"""The methods of the training-data operators against plain versions of what they compute."""

import gc
import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import arrow_text as A
from voxloom.llm import decontam, exact_dedup, near_dedup, quality, range_coder, substring, token_files, tokenizing, toxicity, url_rules

SCHEMA = "doc_id long, text string"


def words(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


# --- toxicity ------------------------------------------------------------------------------------

def rows_of_terms(sets):
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return doc, np.array([t for s in sets for t in sorted(s)], np.int64)


def test_scores_are_the_sum_over_all_pairs():
    r = np.random.default_rng(1)
    machine = toxicity.FactorizationMachine(0.3, r.normal(size=1 << toxicity.BITS), r.normal(size=(1 << toxicity.BITS, toxicity.FACTORS)))
    sets = [{3, 7, 11, 200}, set(), {5}]
    want = [0.3 + sum(machine.w[t] for t in s) + sum(machine.v[a] @ machine.v[b] for a, b in itertools.combinations(sorted(s), 2)) for s in sets]
    assert machine.logits(*rows_of_terms(sets), len(sets)) == pytest.approx(np.array(want))


def test_a_pair_that_tells_only_together_is_learnt():
    r = random.Random(4)
    sets, y = [], []
    for _ in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        sets.append(({1} if a else set()) | ({2} if b else set()) | {10 + r.randrange(60) for _ in range(12)})
        y.append(float(a != b))
    doc, term = rows_of_terms(sets)
    machine = toxicity.fit_machine(doc, term, np.array(y), np.ones(len(y)))
    right = ((machine.logits(doc, term, len(y)) > 0) == (np.array(y) > 0)).mean()
    assert right > 0.95


def pairs_by_brute_force(sets, left):
    """Terms of the pairs whose rows' left-overs sum to more than Bernstein's bound, of all pairs."""
    left = np.array(left) - np.mean(left)
    rows = {}
    for i, of in enumerate(sets):
        for t in of:
            rows.setdefault(t, set()).add(i)
    rows = {t: of for t, of in rows.items() if len(of) >= 2}
    least, found = np.log(max(len(rows), 2) ** 2 / toxicity.PAIR_CHANCE), set()
    for a, b in itertools.combinations(sorted(rows), 2):
        both = sorted(rows[a] & rows[b])
        total = abs(left[both].sum())
        if len(both) >= 2 and total**2 / (2 * (len(both) * np.mean(left**2) + np.abs(left).max() * total / 3)) > least:
            found |= {a, b}
    return sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_pairs_equal_brute_force(seed):
    r = random.Random(seed)
    sets = [{r.randrange(40) for _ in range(r.randrange(12))} | {t for t in (50, 51, 52) if r.random() < 0.3} for _ in range(400)]
    left = [(0.8 if {50, 51} <= of else -0.7 if {51, 52} <= of and seed % 2 else 0.0) + r.gauss(0, 0.1) for of in sets]
    doc, term = rows_of_terms(sets)
    want = pairs_by_brute_force(sets, left)
    assert {50, 51} <= set(want)
    assert toxicity.pair_terms(doc, term, np.array(left)).tolist() == want
    search = toxicity.PairSearch.of(doc, term, np.array(left))
    assert sorted({int(t) for part in range(7) for t in search.clear(part, 7)}) == want


def test_pairs_by_tasks_equal_those_of_one_process(spark, monkeypatch):
    r = random.Random(3)
    sets = [{r.randrange(200) for _ in range(20)} | ({300, 301} if i % 5 == 0 else set()) for i in range(500)]
    left = np.array([0.9 if i % 5 == 0 else r.gauss(-0.2, 0.1) for i in range(500)])
    doc, term = rows_of_terms(sets)
    want = toxicity.pair_terms(doc, term, left)
    assert {300, 301} <= set(want.tolist())
    monkeypatch.setattr(toxicity, "PAIR_ENTRIES", 50)  # rows a few at a time
    assert toxicity.pair_terms(doc, term, left).tolist() == toxicity.pair_terms_by_tasks(spark, doc, term, left).tolist() == want.tolist()


def test_a_fit_holds_little_beyond_its_sample():
    n, per = 2000, 2000
    doc = np.repeat(np.arange(n, dtype=np.int32), per)
    term = np.tile(np.arange(per, dtype=np.int32), n)
    y = (np.arange(n) % 2).astype(float)
    term[0::per] = np.where(y > 0, per, per + 1)  # the first term of a row tells its class
    tracemalloc.start()
    machine = toxicity.fit_machine(doc, term, y, np.ones(n), steps=30, pairs_of=lambda *of: toxicity.PairSearch.of(*of).known[:0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ((machine.logits(doc, term, n) > 0) == (y > 0)).all()
    assert peak < 16 * len(doc)  # arrays of all entries in 64 bits would be two already


def test_sample_arrays_put_rows_in_order():
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32()))])
    batches = [{"doc_id": [9, -2, 9], "label": [1, 0, 0], "terms": [[1, 2], [], [3]]}, {"doc_id": [], "label": [], "terms": []}, {"doc_id": [4], "label": [1], "terms": [[5, 6, 7]]}]
    table = pa.Table.from_batches([pa.record_batch(b, schema) for b in batches])
    got = toxicity.sample_arrays(table.slice(1))
    assert [x.tolist() for x in got] == [[0, 1, 0], [1, 1, 1, 2], [5, 6, 7, 3]]
    assert [x.tolist() for x in toxicity.sample_arrays(table.slice(0, 0))] == [[], [], []]


def test_a_pair_of_terms_rarer_than_thousands_of_others_is_learnt():
    r = np.random.default_rng(2)
    n, common = 2_000, 2_300
    a, b = r.random(n) < 0.16, r.random(n) < 0.16
    # Toxic with both or, as often as keeps either neutral, with neither.
    y = np.where(a & b, 1.0, (r.random(n) < 0.16 * 0.16 + 0.1)).astype(float)
    only = (a ^ b) & (r.random(n) < 0.9)
    y[only] = 0
    x = r.random((n, common)) < 0.2
    doc, term = np.nonzero(np.column_stack([x, a, b]))
    found = toxicity.pair_terms(doc, term, y - y.mean())
    assert {common, common + 1} <= set(found.tolist()) and len(found) < 20
    machine = toxicity.fit_machine(doc, term, y, np.ones(n))
    assert machine.v[common] @ machine.v[common + 1] > 0.5


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "c " * 50_000), (3, "")], SCHEMA)
    none = spark.createDataFrame([(9, None), (None, 1)], "doc_id long, toxic int")
    scores = [(r["score"], r["predicted"]) for r in toxicity.toxicity_report(docs, none).collect()]
    assert len(scores) == 5 and len(set(scores)) == 1 and 0 <= scores[0][0] <= 1
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity_report(docs, one).collect()} == {1}
    assert toxicity.toxicity_report(docs.limit(0), one).count() == 0
    clash = docs.withColumn("toxicity_score", F.lit("x")).withColumn("label", F.lit(7))
    assert toxicity.toxicity_report(clash, one).count() == 5


# --- passages ------------------------------------------------------------------------------------

def test_windows_are_found_once_for_their_shared_keys(spark, tmp_path):
    r = random.Random(2)
    common = words(60, 1)
    docs = spark.createDataFrame([(i, " ".join(words(r.randrange(40, 90), i) + common * (i % 3 == 0))) for i in range(60)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/docs")
    source = spark.read.parquet(f"{tmp_path}/docs").select(F.col("doc_id").alias("id"), "text")
    rows = substring.windows(source, substring.Passages())
    got = substring.of_shared_keys(rows)
    seen, of = [tuple(x) for x in rows.collect()], {}
    for x in seen:
        of.setdefault(x[0], set()).add(x[1])
    assert sorted(tuple(x) for x in got.select(rows.columns).collect()) == sorted(x for x in seen if len(of[x[0]]) > 1) != []
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


# --- token files: pieces -------------------------------------------------------------------------

def test_pieces_with_equal_hashes_are_told_apart(monkeypatch):
    texts = ["the cat sat on the mat", "a cat ate the hat", "", "on  the\tmat\n", "the cat sat on the mat"]
    tokenizer = tokenizing.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = [tokenizer.ids(t) for t in texts]
    monkeypatch.setattr(A, "span_hashes", lambda data, starts, ends: (ends - starts).astype(A.U64) * A.U64(0) + A.U64(5))
    ids, counts = tokenizing.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_a_group_of_blocks_is_coded_in_little_memory():
    """Two workers and the heap share an executor's memory; CHECK_r03 has the pipeline stopped in its tokens stage."""
    rng = np.random.default_rng(11)
    blocks = [np.minimum(rng.zipf(1.2, range_coder.BLOCK), 50_000).astype(np.uint16) for _ in range(token_files.GROUP // range_coder.BLOCK)]
    tracemalloc.start()
    try:
        coded = range_coder.encode_blocks(blocks)
        encoding = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        back = range_coder.decode_blocks(coded)
        decoding = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(back, blocks))
    assert encoding < 90e6 and decoding < 90e6


def test_a_worker_keeps_few_bytes_a_piece():
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(500)) for _ in range(120)]
    tokenizer = tokenizing.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    tracemalloc.start()
    try:
        tokenizer.reset()
        ids, counts = tokenizer.encode(pa.array(texts))
        want = [tokenizer.ids(texts[0]), tokenizer.ids(texts[-1])]
        assert [ids[: counts[0]].tolist(), ids[-counts[-1] :].tolist()] == want
        del ids, counts, want
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 25e6
    finally:
        tracemalloc.stop()


def test_pieces_are_cut_behind_letters(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["alpha, alpha. alpha; alpha: (alpha) don't x.'s 'sabc a1b2 é,a éa, ça\x00b", "https://a.example/b?c=d&e=" + "f" * 70 + "/g", "z" * 64 + " " + "z" * 65, "no<|endoftext|>gap,<|endoftext|", None, "ab\u00a0cd, e", "漢字,かな a漢 "]
    tokenizer = tokenizing.PieceTokenizer(path)
    want = [tokenizer.ids(t or "") for t in texts]
    for _ in range(2):
        ids, counts = tokenizer.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    few = tokenizing.PieceTokenizer(path)
    calls, real = [], few.learn
    monkeypatch.setattr(few, "learn", lambda data, begin, size: calls.append(len(begin)) or real(data, begin, size))
    few.encode(pa.array([" omega, omega. omega; omega: omega! omega? omega"]))
    assert calls[0] == 7  # the word and six marks
    monkeypatch.setattr(tokenizing.Pieces, "hashes", lambda self: np.zeros(len(self.begin), A.U64))
    ids, counts = tokenizing.PieceTokenizer(path).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_accented_words_and_line_starts_need_no_pattern(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["\u00e9t\u00e9 na\u00efve\nStra\u00dfe \u0153uvre\r\n\u017bubr\tok", "a\n\nb\n\n\tc \n d\u00d7e \u00f7 f\n \n", "\n", "\n\n", "x\n\n", "\ny", " \n\t z\r\n1\r\n\r\n.", None, "caf\u00e9, caf\u00e9\u0301 \u00bfqu\u00e9? l'\u00e9t\u00e9 \u0180\u0250 12\u00b2"]
    tokenizer = tokenizing.PieceTokenizer(path)
    want = [tokenizer.ids(t or "") for t in texts]
    for rows in (texts, texts[::-1], [t for t in texts for _ in range(2)]):
        ids, counts = tokenizing.PieceTokenizer(path).encode(pa.array(rows))
        of = dict(zip(texts, want))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [of[t] for t in rows]
    few = tokenizing.PieceTokenizer(path)
    calls, real = [], few._call
    monkeypatch.setattr(few, "_call", lambda data, begin, size: calls.extend(data[b : b + n].tobytes() for b, n in zip(begin, size)) or real(data, begin, size))
    few.encode(pa.array(["\u00e9t\u00e9 na\u00efve\nStra\u00dfe \u0153uvre"]))
    assert calls == [b"\n"]


def test_coder_counts_what_it_has_seen():
    r = np.random.default_rng(4)
    model, steps = range_coder.Model(np.array([9, 7, 7])), 0
    want = model.counts.copy()
    for _ in range(40):
        x = r.integers(0, 7, 3)
        model.predict()
        _, _, hit1, hit2 = model.bounds(x)
        if steps < 32:
            np.add.at(want, (np.arange(3), x), range_coder.GAIN)
        model.update(x, hit1, hit2)
        steps += 1
    assert (model.counts == want).all() and sum(s.nbytes for s in model.seen) == 8 * 3 * 2  # two bytes a symbol


def test_blocks_are_coded_apart_and_runs_get_cheap():
    r = np.random.default_rng(6)
    blocks = [r.integers(0, n, size).astype(np.uint32) for n, size in ((1, 1), (50, 33), (2000, 4096), (3, 129), (1 << 21, 3073), (40, 4000), (7, 32))]
    blocks += [np.tile(np.arange(8, dtype=np.uint32), 512)]
    coded = range_coder.encode_blocks(blocks)
    assert [range_coder.encode_blocks([b])[0] for b in blocks] == coded
    for some in (coded, coded[:3], coded[3:]):
        assert all((a == range_coder.decode_blocks([c])[0]).all() for a, c in zip(range_coder.decode_blocks(some), some))
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded), blocks))
    assert len(coded[-1]) < 120  # 8 ids in turn, 4,096 times


def test_carries_pass_over_full_words():
    # Low ends close to a carry: ids at the upper end of the mixture, again and again.
    blocks = [np.concatenate([np.full(n, 9), [3] * 40, np.full(4000 - n, 9)]).astype(np.uint32) for n in range(0, 4000, 40)]
    for a, b in zip(blocks, range_coder.decode_blocks(range_coder.encode_blocks(blocks))):
        assert (a == b).all()


# --- exact dedup ---------------------------------------------------------------------------------

def test_radix_digits_grow(spark, monkeypatch):
    saved, rounds = exact_dedup.saved, []
    monkeypatch.setattr(exact_dedup, "saved", lambda df, name: rounds.append(name) or saved(df, name))
    texts = ["x" * 3000, "x" * 3000, "x" * 2999 + "y", "x" * 3001, None, ""]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA), digits=(1, 2)).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (5, 2), 5: (5, 2)}
    assert rounds.count("radix-rows") <= 13


# --- substring dedup -----------------------------------------------------------------------------

def sets_of(tokens, w=46):
    grams = list(zip(*(tokens[k:] for k in range(5))))
    return [frozenset(grams[s : s + w]) for s in range(max(0, len(grams) - w + 1))]


def like(a, b):
    return bool(a) and bool(b) and max(len(x & y) / len(x | y) for x in a for y in b) >= 0.8


def test_windows_are_the_nodes_of_the_tree():
    p, r = substring.Passages(), random.Random(1)
    texts = [" ".join(r.choice("abcd") + str(r.randrange(40)) for _ in range(n)).encode() for n in (300, 40, 50, 120, 0, 55)]
    w = A.Words(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), A.NON_SPACE)
    docs, place, h = substring.positional(w, p.width)
    keys, owner, spans = substring.compact_windows(docs, place, h, p)
    got = {(int(k) & 15, int(o), *map(int, s)) for k, o, s in zip(keys, owner, spans)}
    want = set()
    for f in range(p.functions):
        values = A.mix(h ^ A.mix(np.array([f + 1], A.U64) * A.U64(0x9FB21C651E98DF25)))
        for d in range(len(texts)):
            v, starts = values[docs == d], {}
            for s in range(len(v) - p.shingles + 1):
                starts.setdefault(s + int(np.argmin(v[s : s + p.shingles])), []).append(s)
            want |= {(f, d, x[0], x[-1], c) for c, x in starts.items()}
    assert got == want and len(want) > 20


def test_three_documents(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(50)]
    texts = [" ".join([word() for _ in range(20)] + passage[3:43] + [word() for _ in range(30)]), " ".join(passage), " ".join(passage)]
    got = substring.repeated_passages(spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert [tuple(x) for x in got] == [(3, 0, 50, 2, 0)]


def test_passages_near_the_similarity_equal_brute_force(spark):
    """Families of one passage of 50 to 80 words with words changed, put in or left out, in documents of their own words."""
    r, texts = random.Random(11), []
    for f in range(12):
        passage = words(r.randrange(50, 81), 100 + f)
        for k in range(5):
            edited = list(passage)
            for _ in range(r.choice((0, 1, 1, 2))):
                at = r.randrange(len(edited))
                edited[at : at + r.choice((0, 1))] = words(r.choice((0, 1)), r.random())
            texts.append(words(r.randrange(0, 70), r.random()) + edited + words(r.randrange(0, 70), r.random()))
    # A line that all of some documents share, too short for a passage.
    line = words(30, 7)
    texts += [words(40, r.random()) + line + words(40, r.random()) for _ in range(10)]
    sets = [sets_of(t) for t in texts]
    want = {b for b in range(len(texts)) if any(like(sets[a], sets[b]) for a in range(b))}
    rows = substring.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)).collect()
    for x in rows:  # every row is a passage of both documents
        mine = [s for k, s in enumerate(sets[x["doc_id"]]) if x["start_word"] <= k <= x["end_word"] - 50]
        assert x["source_id"] < x["doc_id"] and like(mine, sets[x["source_id"]])
    found = {x["doc_id"] for x in rows}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) > 30


def test_passages_of_odd_tables(spark):
    shared = " ".join(words(60, 3))
    docs = spark.createDataFrame([(1, shared), (1, shared + " tail"), (None, shared), (4, shared), (5, None), (6, ""), (7, "a " * 5000), (8, "a " * 5000)], SCHEMA)
    docs = docs.withColumn("key", F.lit(1)).withColumn("span", F.lit("x")).withColumn("id", F.lit(9))
    got = {(x["doc_id"], x["source_id"]) for x in substring.repeated_passages(docs).collect()}
    assert got == {(4, 1), (8, 7)}


def test_a_passage_of_many_documents(spark):
    passage = " ".join(words(70, 2))
    docs = spark.createDataFrame([(i, " ".join(words(30, 50 + i)) + " " + passage) for i in range(120)], SCHEMA)
    got = substring.repeated_passages(docs).collect()
    assert {x["doc_id"] for x in got} == set(range(1, 120)) and {x["source_id"] for x in got} == {0}


# --- decontamination -----------------------------------------------------------------------------

def test_blocks_of_the_benchmark_say_the_same(spark):
    bench = spark.createDataFrame([(i, " ".join(words(14, i))) for i in range(40)] + [(None, " ".join(words(12, 99))), (3, " ".join(words(14, 3)))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words(9, 500 + i) + words(14, i % 50)[: 10 + i % 5] + words(9, 600 + i))) for i in range(60)] + [(7, None), (8, ""), (9, " ".join(words(12, 99)))], SCHEMA)
    docs = docs.withColumn("hit_spans", F.lit(0)).withColumn("_extra", F.lit(1))
    one = decontam.contamination(docs, bench)
    many = decontam.contamination(docs, bench.withColumn("text", F.concat("text", F.lit(" "), F.lit(". " * 30_000))), block_mb=1)
    key = lambda df: sorted((x["doc_id"], x["text"] or "", x["n_words"], tuple(x["hit_spans"]), tuple(x["hit_items"])) for x in df.collect())
    assert key(one) == key(many) and sum(bool(x[3]) for x in key(one)) > 40


# --- near dedup ----------------------------------------------------------------------------------

def test_near_copies_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "x y z w v"), (2, "x y z w v"), (3, None)], SCHEMA).withColumn("token", F.lit(1)).withColumn("part", F.lit(2))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"]) for r in near_dedup.near_duplicates(docs, near_dedup.CONTRACT).collect())
    assert got == [((False, 1), 1), ((False, 1), 1), ((False, 2), 1), ((False, 3), 3), ((True, 0), None), ((True, 0), None)]
    assert near_dedup.near_duplicates(docs.limit(0), near_dedup.CONTRACT).count() == 0


# --- quality -------------------------------------------------------------------------------------

def test_word_vectors_are_sums_over_neighbours(spark):
    texts = ["the cat sat. the cat!", "cat the", "", None, "sat"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    index, want = quality.index_vectors(), np.zeros((1 << quality.BITS, quality.DIM), np.int64)
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, b = quality.tokens(data, np.array([0, len(data)]))
        for i in range(len(b) - 1):
            want[b[i]] += index[b[i + 1]]
            want[b[i + 1]] += index[b[i]]
    got = quality.word_vectors(docs)
    on = np.flatnonzero(np.abs(want).sum(axis=1))
    unit = want[on] / np.maximum(np.linalg.norm(want[on], axis=1, keepdims=True), 1e-9)
    mine = got[on] / np.maximum(np.linalg.norm(got[on], axis=1, keepdims=True), 1e-9)
    assert np.allclose(unit, mine, atol=1e-5)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b."), (1, "a b."), (2, None), (None, "c " * 20_000), (3, "")], SCHEMA)
    none = spark.createDataFrame([(9, None)], "doc_id long, quality int")
    scores = {r["score"] for r in quality.quality_report(docs, none).collect()}
    assert all(0 <= s <= 1 for s in scores)
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.quality_report(docs, one).collect()} == {1}
    assert quality.quality_report(docs.limit(0), one).count() == 0


# --- URL rules -----------------------------------------------------------------------------------

def plain_verdicts(rows):
    """Every combination of tokens of labelled rows is a rule; nothing stands for anything else."""
    labelled = [x for x in rows if x[1]]
    counts = {}
    for t, v in labelled:
        for size in range(1, len(t) + 1):
            for left in itertools.combinations(sorted(t), size):
                both = counts.setdefault(left, {})
                both[v] = both.get(v, 0) + 1
    rules = {(a, v): (n / sum(vs.values()), n / len(labelled)) for a, vs in counts.items() for v, n in vs.items() if n >= url_rules.SUPPORT * len(labelled)}
    good = {(a, v): x for (a, v), x in rules.items() if x[0] >= url_rules.CONFIDENCE}
    kept = {k: x for k, x in good.items() if not any(rules.get((b, k[1]), (0,))[0] >= x[0] for n in range(1, len(k[0])) for b in itertools.combinations(k[0], n))}
    out = []
    for t, v in rows:
        fits = sorted((-c, -s, list(a), w) for (a, w), (c, s) in kept.items() if t.issuperset(a))
        out.append(v or (fits[0][3] if fits else "allow"))
    return out


def test_tokens_of_one_class_all_hold(spark):
    r = random.Random(9)
    urls = ["http://shop.example.com/de/x"] * 5 + ["http://a.example.net/en/y?q=1&lang2=x"] * 5 + ["http://shop.other.info/zz", "http://shop.other.info/de/q", "http://other.info/?q", "http://b.info/x#?q=1", "nothing", ""]
    pick = lambda *x: r.choice(x)
    urls += [f"http://{pick('', 'm.', 'w.')}{pick('example.com', 'example.net', 'site.org', 'k.info')}/{pick('de', 'en', 'fr', 'x')}/{pick('n1', 'n22', 'p', '')}{pick('', '?q=1', '?s=2&q=3')}" for _ in range(150)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = url_rules.host_and_path(F.col("url"))
    _, verdict = url_rules.given_rule(host, path)
    tokens = url_rules.url_tokens(host, path, url_rules.query_of(F.col("url")))
    read = {x["page_id"]: (frozenset(x["t"]), x["v"]) for x in pages.select("page_id", tokens.alias("t"), verdict.alias("v")).collect()}
    assert {"query:q", "query:lang0"} <= read[5][0] and "query:q" in read[12][0] and "query:q" not in read[13][0]
    judged = {x["page_id"]: x["verdict"] for x in url_rules.url_verdicts(pages).collect()}
    assert [judged[i] for i in range(len(urls))] == plain_verdicts([read[i] for i in range(len(urls))])
    few = {x["page_id"]: x["verdict"] for x in url_rules.url_verdicts(pages.where("page_id < 12")).collect()}
    assert few[10] == few[11] == "block"


def test_all_rules_are_found_pruned_and_applied(spark):
    r = random.Random(3)
    # Ten segments, so nothing depends on the first few.
    urls = [f"http://{r.choice('abc')}.{r.choice(['example.com', 'example.net', 'site.org', 'shop.info'])}/" + "/".join(r.choice(["de", "en", "fr"]) if k in (0, 9) else f"d{k}" for k in range(10)) for _ in range(240)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, None), (0, urls[0])], "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("verdict", F.lit("x"))
    host, path = url_rules.host_and_path(F.col("url"))
    _, verdict = url_rules.given_rule(host, path)
    rows = [(frozenset(x["t"]), x["v"]) for x in pages.select(url_rules.url_tokens(host, path).alias("t"), verdict.alias("v")).collect()]
    labelled = [x for x in rows if x[1]]
    # One token for all that are on the same rows.
    on = {}
    for k, (t, _) in enumerate(labelled):
        for x in t:
            on.setdefault(x, set()).add(k)
    names = {}
    for x, where in on.items():
        names.setdefault(frozenset(where), []).append(x)
    kept = {min(x) for x in names.values()}
    baskets = [(t & kept, v) for t, v in labelled]
    rules = {}
    for size in range(1, max(len(t) for t, _ in baskets) + 1):
        for left in {frozenset(c) for t, _ in baskets for c in itertools.combinations(sorted(t), size)}:
            hits = [v for t, v in baskets if left <= t]
            for v in set(hits):
                if hits.count(v) >= url_rules.SUPPORT * len(baskets):
                    rules[left, v] = hits.count(v) / len(hits), hits.count(v) / len(baskets)
    best = {(a, v): c for (a, v), (c, _) in rules.items()}
    want = {k: x for k, x in rules.items() if x[0] >= url_rules.CONFIDENCE and not any((frozenset(b), k[1]) in best and best[frozenset(b), k[1]] >= x[0] for n in range(1, len(k[0])) for b in itertools.combinations(k[0], n))}
    table = spark.createDataFrame([(sorted(t), v) for t, v in labelled], "tokens array<string>, verdict string")
    got = {(frozenset(x["left"]), x["verdict"]): (x["confidence"], x["support"]) for x in url_rules.mine_rules(url_rules.one_of_equals(table)[0]).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    judged = {x["page_id"]: x["verdict"] for x in url_rules.url_verdicts(pages).collect() if x["page_id"] is not None}
    for k, u in enumerate(urls):
        t, v = rows[k]
        fits = sorted((-c, -s, sorted(a), w) for (a, w), (c, s) in want.items() if a <= t)
        assert judged[k] == (v or (fits[0][3] if fits else "allow"))
