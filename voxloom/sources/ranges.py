"""Audio files read by ranges of blocks, so that one long file is many tasks and no cell holds a file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxloom.sources.readers import BLOCK, wav_header, wav_values

#: Bytes of a file that one task reads, about; blocks of one Arrow batch.
RANGE_BYTES, BATCH_BLOCKS = 64 << 20, 64
SCHEMA = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("block_start", pa.int64()), ("duration", pa.float64()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


@dataclass
class Part(InputPartition):
    """Files, and of each the share ``k`` of ``of`` of its blocks."""

    files: list[tuple[str, int, int, int]]


class AudioRanges(DataSource):
    """``spark.read.format("audio_ranges")`` with the options path, kind (wav or f32), block, range_bytes and check.

    Rows are those of ``readers.read_wav_blocks``; with ``check``, only the errors. The path is a folder or file of
    a store that ``pyarrow.fs`` opens: local, HDFS or an object store.
    """

    @classmethod
    def name(cls) -> str:
        return "audio_ranges"

    def schema(self) -> str:
        return "path string, rate int, block_start long, duration double, samples array<float>, error string"

    def reader(self, schema) -> DataSourceReader:
        return AudioRangeReader(self.options)


class AudioRangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options.get("kind", "wav")
        self.block, self.size = int(options.get("block", BLOCK)), int(options.get("range_bytes", RANGE_BYTES))
        self.check = options.get("check", "false") == "true"

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)

    def named(self, store: fs.FileSystem, path: str) -> str:
        return f"file:{path}" if store.type_name == "local" else self.path.split("://")[0] + "://" + path

    def partitions(self) -> list[Part]:
        """Large files are cut, small ones gathered; only names and sizes are read."""
        store, root = self.store()
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (self.kind != "wav" or f.path.endswith(".wav")))
        parts, held, size = [], [], 0
        for path, n in files:
            cuts = -(-n // self.size)
            if cuts > 1:
                parts += [Part([(path, n, k, cuts)]) for k in range(cuts)]
                continue
            if held and size + n > self.size:
                parts.append(Part(held))
                held, size = [], 0
            held.append((path, n, 0, 1))
            size += n
        return parts + [Part(held)] * bool(held)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = self.store()
        for path, size, k, of in part.files:
            name = self.named(store, path)
            with store.open_input_file(path) as file:
                read = lambda at, n: file.read_at(n, at)  # noqa: B023, E731
                try:
                    yield from self.raw(name, read, size, k, of) if self.kind == "f32" else self.wav(name, read, size, k, of)
                except ValueError as e:
                    yield self.rows(name, None, [None], None, [None], str(e))

    def wav(self, name: str, read, size: int, k: int, of: int) -> Iterator[pa.RecordBatch]:
        head = wav_header(read, size)
        if self.check and head.kind != 3:
            return
        frames = head.size // head.frame
        for starts in self.starts(frames, k, of):
            low, high = starts[0], min(starts[-1] + self.block, frames)
            mono = wav_values(read(head.data + low * head.frame, (high - low) * head.frame), head).mean(axis=1)
            if not self.check:
                yield self.rows(name, head.rate, starts, frames / head.rate, [mono[s - low : s - low + self.block] for s in starts], None)

    def raw(self, name: str, read, size: int, k: int, of: int) -> Iterator[pa.RecordBatch]:
        n = size // 4
        for starts in self.starts(n, k, of) if n else ():
            low, high = starts[0], min(starts[-1] + self.block, n)
            x = np.frombuffer(read(4 * low, 4 * (high - low)), "<f4")
            yield self.rows(name, None, starts, None, [x[s - low : s - low + self.block] for s in starts], None)

    def starts(self, n: int, k: int, of: int) -> Iterator[list[int]]:
        """The starts of the share's blocks, some at a time; a file without samples has one empty block."""
        blocks = max(1, -(-n // self.block))
        own = range(blocks * k // of, blocks * (k + 1) // of)
        for i in range(0, len(own), BATCH_BLOCKS):
            yield [b * self.block for b in own[i : i + BATCH_BLOCKS]]

    def rows(self, name, rate, starts, duration, samples, error) -> pa.RecordBatch:
        n = len(starts)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([name] * n, [rate] * n, starts, [duration] * n, samples, [error] * n), SCHEMA)], schema=SCHEMA)


def _read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(AudioRanges)
    return spark.read.format("audio_ranges").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def read_wav_ranges(spark: SparkSession, path: str, block: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As ``readers.read_wav_blocks``, for files of any length: a bad file is one row with its error.

    Headers are read by each task. A sample that isn't finite can turn up in any range, so float files are
    checked in a pass of their own, and no range of a bad file has rows.
    """
    errors = _read(spark, path, block=block, range_bytes=range_bytes, check=True).where("error is not null").groupBy("path").agg(F.min("error").alias("bad"))
    rows = _read(spark, path, block=block, range_bytes=range_bytes).where("error is null")
    good = rows.join(errors.select("path"), "path", "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rate", "int"), ("block_start", "long"), ("duration", "double"), ("samples", "array<float>"))]
    return good.unionByName(errors.select("path", *none, F.col("bad").alias("error")))


def read_raw_ranges(spark: SparkSession, path: str, block: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As ``readers.read_raw_f32``, for files of any length."""
    return _read(spark, path, kind="f32", block=block, range_bytes=range_bytes).where("error is null").select("path", "block_start", "samples")
