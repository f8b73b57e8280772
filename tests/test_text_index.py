"""Many searches by an index of grams equal a scan; packed transcripts are few files and readable by id."""

import os
import random

from pyspark.sql import functions as F

from voxloom.operators import text_index
from voxloom.sources import readers


def fold(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def test_searches_equal_a_scan(spark):
    r = random.Random(2)
    letters = "abAB_%É é\\"
    word = lambda n: "".join(r.choices(letters, k=n))
    names = [(f"j{i}", None if i == 3 else word(r.randint(0, 12))) for i in range(60)]
    texts = [(f"j{r.randrange(62)}", k, None if k % 17 == 0 else word(r.randint(0, 30))) for k in range(300)]
    queries = [(f"q{k}", word(r.randint(1, 6))) for k in range(400)] + [("empty", ""), ("null", None), ("twice", "a"), ("twice", "É"), ("long", word(40)), ("none", "z")]
    jobs = spark.createDataFrame(names, "id string, source_filename string").withColumn("part", F.lit("x"))
    segments = spark.createDataFrame(texts, "tid string, segment_index long, text string").withColumn("gram", F.lit("y"))
    index = text_index.build_index(jobs, segments)
    got = [tuple(x) for x in text_index.search_many(index, spark.createDataFrame(queries, "query_id string, query string")).collect()]
    held = [(i, fold(x)) for i, x in names if x is not None] + [(i, fold(x)) for i, _, x in texts if x is not None and i in dict(names)]
    want = {(k, i) for k, q in queries if q is not None for i, x in held if fold(q) in x}
    assert len(got) == len(set(got)) and set(got) == want
    assert text_index.search_many(index, spark.createDataFrame([], "query_id string, query string")).isEmpty()
    assert text_index.search_many(text_index.build_index(jobs.limit(0), segments), spark.createDataFrame(queries, "query_id string, query string")).isEmpty()


def test_searches_go_through_no_driver(spark):
    jobs = spark.createDataFrame([("j1", "a😀b.wav"), ("j2", "xy")], "id string, source_filename string")
    segments = spark.createDataFrame([("j1", 0, "é" * 50_000 + "😀Z"), ("j2", 0, "zz")], "tid string, segment_index long, text string")
    found = text_index.search_many(text_index.build_index(jobs, segments), spark.createDataFrame([("a", "A😀B"), ("b", "é😀z"), ("c", "😀"), ("d", "Zz"), ("e", "y")], "query_id string, query string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in found.collect()} == {("a", "j1"), ("b", "j1"), ("c", "j1"), ("d", "j2"), ("e", "j2")}


def test_packed_transcripts_are_few_files(spark, tmp_path):
    segments = spark.range(6_000).select(F.concat(F.lit("t"), (F.col("id") % 3_000)).alias("tid"), F.col("id").alias("segment_index"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 500).alias("end_ms"), F.concat(F.lit("Line "), "id").alias("text"), F.lit("file").alias("source_track"), F.lit(None).cast("string").alias("speaker_id"))
    path = str(tmp_path / "packed")
    readers.write_packed_transcripts(segments, path, "srt", 50_000)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert 1 < len(files) < 20
    want = {x["tid"]: x["document"] for x in readers.KINDS["srt"](segments).collect()}
    assert {x["tid"]: x["document"] for x in readers.read_packed_transcripts(spark, path).collect()} == want and len(want) == 3_000
    few = readers.read_packed_transcripts(spark, path, ["t7", "t2999", "nobody"])
    assert {x["tid"]: x["document"] for x in few.collect()} == {t: want[t] for t in ("t7", "t2999")}
