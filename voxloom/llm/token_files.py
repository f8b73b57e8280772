"""Token-id files: documents in ascending id order, range-coded in independent, checksummed blocks.

Documents are dealt out by ranges of their id and sorted within them. Each task writes frames of
whole documents; a frame holds the documents' ids and token counts, and blocks of at most
``range_coder.BLOCK`` ids that decode alone. Frames are the rows of Parquet files that Spark writes
and commits, so a lost executor's frames are written again.

A frame: magic, number of documents, number of blocks; for each document its id (null: flag 0) and
token count; for each block its length in bytes; then the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm import arrow_text as A
from voxloom.llm import range_coder as R
from voxloom.llm.scratch import new_path
from voxloom.llm.tokenizing import worker_tokenizer

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"VXF1"
#: Ids after which a frame is closed, and ids that are coded in one go; the other lanes are for the last texts and for blocks that end early.
FRAME, GROUP = 64 * R.BLOCK, R.LANES * 7 // 8 * R.BLOCK
#: Texts of one Arrow batch.
SCHEMA = "part int, frame int, start_in_part long, n_docs long, n_tokens long, payload binary"
_HEAD = struct.Struct("<4sII")


def pack_frame(doc_ids: list[int | None], counts: np.ndarray, blocks: list[bytes]) -> bytes:
    table = np.zeros(len(doc_ids), [("has", "u1"), ("id", "<i8"), ("n", "<i8")])
    table["has"] = [d is not None for d in doc_ids]
    table["id"] = [d or 0 for d in doc_ids]
    table["n"] = counts
    return b"".join([_HEAD.pack(MAGIC, len(doc_ids), len(blocks)), table.tobytes(), np.array([len(b) for b in blocks], "<u4").tobytes(), *blocks])


def unpack_frame(data: bytes) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    magic, n_docs, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token frame")
    table = np.frombuffer(data, [("has", "u1"), ("id", "<i8"), ("n", "<i8")], n_docs, _HEAD.size)
    at = _HEAD.size + table.nbytes
    ends = np.cumsum(np.frombuffer(data, "<u4", n_blocks, at).astype(np.int64))
    at += 4 * n_blocks
    blocks = [data[at + b - n : at + b] for b, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]
    return [int(i) if h else None for h, i in zip(table["has"], table["id"])], table["n"], blocks


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the frames under ``path``.

    Null texts count as empty and have the end id alone. Null ids come first; rows with the same id
    follow one another in the order of their texts. Repeated rows are written as often as they occur.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, pieces = TaskContext.get().partitionId(), worker_tokenizer(tokenizer)
        waiting: list[tuple[list, np.ndarray, np.ndarray]] = []  # doc ids, counts, ids of frames to code
        state = {"frame": 0, "start": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            A.release()  # what tokenizing has freed, before the coder takes its tables
            cuts = [[ids[i : i + R.BLOCK] for i in range(0, len(ids), R.BLOCK)] for _, _, ids in waiting]
            coded = iter(R.encode_blocks([b for c in cuts for b in c]))
            for (doc_ids, counts, ids), cut in zip(waiting, cuts):
                payload = pack_frame(doc_ids, counts, [next(coded) for _ in cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([state["frame"]], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (state["start"], len(doc_ids), len(ids))), pa.array([payload], pa.binary())],
                    names=["part", "frame", "start_in_part", "n_docs", "n_tokens", "payload"],
                )
                state["frame"] += 1
                state["start"] += len(ids)
            waiting.clear()

        for batch in batches:
            done = 0
            while done < len(batch):  # about a MB of text at a time
                rows = batch.slice(done, 256)
                done += len(rows)
                ids, counts = pieces.encode(rows.column(1))
                counts = counts + 1
                ends = np.cumsum(counts)
                # Two bytes an id while it waits, where that holds it.
                out = np.full(int(ends[-1]), end_id, np.uint16 if pieces.most < 1 << 16 > end_id else np.uint32)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                doc_ids, first = rows.column(0).to_pylist(), 0
                while first < len(doc_ids):
                    base = int(ends[first - 1]) if first else 0
                    last = min(len(doc_ids), int(np.searchsorted(ends, base + FRAME, side="left")) + 1)
                    waiting.append((doc_ids[first:last], counts[first:last], out[base : int(ends[last - 1])]))
                    first = last
                if sum(len(w[2]) for w in waiting) >= GROUP:
                    yield from flush()
        yield from flush()
        A.release()  # the worker goes on to other stages

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(frames, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files under ``path``."""
    frames = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(2)
            done = 0
            while done < len(batch):
                end = min(len(batch), done + max(1, GROUP // FRAME))
                parts = [unpack_frame(payloads[i].as_py()) for i in range(done, end)]
                blocks = iter(R.decode_blocks([b for p in parts for b in p[2]]))
                for i, (doc_ids, counts, own) in zip(range(done, end), parts):
                    ids = np.concatenate([next(blocks) for _ in own]).astype("<u4")
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(doc_ids), batch.column(0)[i].as_py(), np.int32)), pa.array(starts + batch.column(1)[i].as_py()), pa.array(counts), pa.array(crcs, pa.int64())],
                        names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                    )
                done = end
        A.release()

    # One row a written file here, however many documents.
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = frames.select("part", "start_in_part", "payload").mapInArrow(decode, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return rows.join(before, F.col("part") == F.col("p")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
