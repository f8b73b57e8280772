"""Ties, nulls, repeats, empty tables and clashing names of chat pairs and decontamination."""

from pyspark.sql import functions as F

from voxloom.llm import chat, decontam, mixing

TURNS = "conv_id long, turn long, role string, text string"


def test_chosen_conversations_of_equal_length(spark):
    talk = lambda i, answer: [(i, 0, "user", "Hi"), (i, 1, "assistant", answer)]
    rows = talk(None, "null") + talk(0, "zero") + talk(4, "four") + talk(-2, "minus")
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, TURNS).withColumn("turns", F.lit(1)).withColumn("best", F.lit("x")).withColumn("opening", F.lit(2)).withColumn("last", F.lit(3))
        pairs = [r for r in chat.preference_pairs(d).collect() if r["pairing"] == "opening"]
        assert {(r["chosen_id"], r["rejected_id"]) for r in pairs} == {(-2, None), (-2, 0), (-2, 4)}
    only = spark.createDataFrame(talk(None, "null") + talk(7, "seven"), TURNS)
    assert [(r["chosen_id"], r["rejected_id"]) for r in chat.preference_pairs(only).collect() if r["pairing"] == "opening"] == [(7, None)]


def test_chat_of_nothing_nulls_and_repeats(spark):
    assert chat.preference_pairs(spark.createDataFrame([], TURNS)).count() == 0
    d = spark.createDataFrame([(1, None, None, None), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 0, "user", "alone")], TURNS)
    (pair,) = chat.preference_pairs(d).collect()
    assert pair["pairing"] == "swap" and pair["n_prompt_turns"] == 2 and pair["rejected_completion"] == "" and pair["distinct_pair"]


def test_large_benchmarks_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "x"), (1, "nothing", "y"), (None, "a b c d e f g h i j", None)], "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(5, "A B c d e f g h i j"), (6, "nothing " * 9)], "item_id long, text string")
    one = decontam.contamination(docs, bench)
    many = decontam.contamination(docs, bench, block_mb=5e-5)
    assert one.columns == many.columns and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert sorted(r["_row"] or "" for r in many.where("size(hit_items) > 0").collect()) == ["", "x"]


def mixed_sources(rows):
    found = {}
    for r in rows:
        x = found.setdefault(r["source"], [0, r["target"], 0])
        x[0] += r["size"] * r["copies"]
        x[2] = max(x[2], r["size"])
        assert 0 <= r["copies"] <= 2
    return found


def test_mixing_rows_of_one_id(spark):
    # No ids, one id for all, equal rows alone, and equal rows among others; sources weigh 3, 1, 2, 3.
    rows = [(None, f"{'w ' * (i % 7 + 1)}{i}", "a") for i in range(90)] + [(5, f"{'w ' * (i % 5 + 1)}{i}", "b") for i in range(90)]
    rows += [(None, "same text here", "c")] * 100 + [(i % 3, "same text here", None) for i in range(100)] + [(i, f"own words {i}", None) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixed_sources(mixing.mix_counts(d).collect())
    assert set(found) == {"a", "b", "c", None} and all(abs(taken - target) <= most for taken, target, most in found.values())
    named = d.withColumn("hash", F.lit("h")).withColumn("tie", F.lit("t")).withColumn("copies", F.lit("c")).withColumn("whole", F.lit(0.5))
    out = mixing.mixed(named)
    assert out.columns == named.columns and {(r["hash"], r["tie"], r["copies"], r["whole"]) for r in out.collect()} == {("h", "t", "c", 0.5)}
    taken = {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    assert taken == {s: x[0] for s, x in found.items()}


def test_mixing_only_repeats_and_nothing(spark):
    one = spark.createDataFrame([(1, "a b", "x")] * 11, "doc_id long, text string, source string")
    (x,) = mixed_sources(mixing.mix_counts(one).collect()).values()
    assert x[:2] == [34, 33.0] or x[:2] == [32, 33.0]
    empty = spark.createDataFrame([(None, None, None), (None, "", "s")], "doc_id long, text string, source string")
    assert [r["copies"] * r["size"] for r in mixing.mix_counts(empty).collect()] == [0, 0]
    assert mixing.mixed(one.limit(0)).count() == 0
