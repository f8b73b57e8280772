"""The corpus pipeline keeps what a plain version of its stages keeps."""

import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline as P

    from voxloom.llm import near_dedup, queries, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    keep = {r["doc_id"] for r in toxicity.toxicity_report(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"] == 0}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if (w := words(text[i])) else set() for i in keep}
    part = {i: i for i in keep}
    order = sorted(keep)
    for a in order:
        for b in order:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {i: new if p == old else p for i, p in part.items()}
    keep = {i for i in keep if part[i] == i}
    items = [re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    clean = set()
    for i in keep:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[i]))
        if not any(tuple(w[k : k + m]) in windows for m in {len(x) for x in windows} for k in range(len(w) - m + 1)):
            clean.add(i)
    rows = P.run(spark, SF).collect()
    con = duckdb.connect()
    con.register("clean", pa.table({"doc_id": pa.array(sorted(clean), pa.int64()), "text": [text[i] for i in sorted(clean)], "source": [source[i] for i in sorted(clean)]}))
    copies = dict(con.sql("WITH " + queries.MIX_CTE.format(docs="clean") + "SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall())
    assert Counter(r["doc_id"] for r in rows) == Counter(copies)
    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = [*encode(text[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == sorted(r["doc_id"] for r in rows)
    assert near_dedup.CONTRACT.percent == 85
