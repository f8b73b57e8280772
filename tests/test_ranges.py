"""Audio files read by ranges give the rows of whole files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sources import ranges, readers


def table(df, *names):
    return sorted((tuple(str(r[c]) if c != "samples" else r[c] and tuple(r[c]) for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("range_bytes", [5_000, 64 << 20])
def test_wav_ranges_equal_whole_files(spark, tmp_path, range_bytes):
    r = np.random.default_rng(1)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("long.wav", readers.wav_bytes(r.uniform(-1, 1, (9_001, 2)), 48_000))
    put("deep/short.wav", readers.wav_bytes(r.uniform(-1, 1, (70, 1)), 16_000))
    put("empty.wav", readers.wav_bytes(np.zeros((0, 1)), 8_000))
    put("bad.wav", b"RIFF and nothing more")
    put("note.txt", b"no audio")

    def floats(x):
        data, fmt = x.astype("<f4").tobytes(), b"".join(v.to_bytes(n, "little") for v, n in ((3, 2), (1, 2), (16_000, 4), (64_000, 4), (4, 2), (32, 2)))
        body = b"WAVEfmt " + (16).to_bytes(4, "little") + fmt + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + b"data" + len(data).to_bytes(4, "little") + data
        return b"RIFF" + len(body).to_bytes(4, "little") + body

    x = r.uniform(-2, 2, 7_000)
    put("float.wav", floats(x))
    x[6_900] = np.nan
    put("nan.wav", floats(x))
    put("cut.wav", floats(x[:6_000])[:-5])
    path = str(tmp_path / "in")
    names = ("path", "rate", "block_start", "duration", "samples", "error")
    assert table(ranges.read_wav_ranges(spark, path, 512, range_bytes), *names) == table(readers.read_wav_blocks(spark, path, 512), *names)
    if range_bytes < 10_000:
        read = ranges._read(spark, f"file:{path}/long.wav", block=512, range_bytes=range_bytes)
        assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 7


def test_raw_ranges_equal_whole_files(spark, tmp_path):
    r = np.random.default_rng(2)
    for name, n in (("a", 5_000), ("b", 3), ("c", 0)):
        (tmp_path / name).write_bytes(r.normal(size=n).astype("<f4").tobytes() + b"\1" * (name == "b"))
    got = ranges.read_raw_ranges(spark, str(tmp_path), 300, 4_000)
    assert table(got, "path", "block_start", "samples") == table(readers.read_raw_f32(spark, str(tmp_path), 300), "path", "block_start", "samples")
