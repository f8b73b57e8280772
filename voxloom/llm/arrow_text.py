"""Word boundaries and hashes over whole Arrow text batches.

A batch is taken in slices of some MB, so memory doesn't depend on the batch size; only a single
text larger than a slice is held whole. All loops over characters and words are numpy operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: Bytes that are hashed at once, so that tables of powers stay small; a longer span is hashed whole.
HASH_BYTES = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that separate words; all others, UTF-8 lead and tail bytes too, are in words."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, HASH_BYTES + 1), base, dtype=U64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; spans ascend and don't overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
        first, last = int(starts[i]), int(ends[j - 1])
        n = last - first
        sums = np.zeros(n + 1, U64)
        np.cumsum((data[first:last].astype(U64) + U64(1)) * _power(_BASE, n)[:n], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * _power(_BASE_INVERSE, n + 1)[a]
        i = j
    return mix(out)


@cache
def _libc_trim() -> Callable[[int], int] | None:
    """Only glibc has it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return None


def release() -> None:
    """Give freed memory back to the system, as Python workers live on and their executor's memory is shared.

    Else the C library keeps up to 64 MB at the end of its heap, and all that lies free in between.
    """
    pa.default_memory_pool().release_unused()
    if trim := _libc_trim():
        trim(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of about ``limit`` bytes and at most 65,536 texts."""
    data, off = text_buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, i + 65_536, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; a run ends with its text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a slice: byte spans, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = runs(table[self.data], off)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def shingles(words: Words, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``width`` words; a text with fewer words, but not none, is one shingle if ``short``."""
    h, doc, n = words.hashes, words.doc, len(words.hashes)
    acc = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        acc = acc * U64(0xD6E8FEB86659FD93) + h[k : n - width + 1 + k] if len(acc) else acc
    whole = doc[: len(acc)] == doc[width - 1 :] if len(acc) else np.zeros(0, bool)
    docs, out = doc[: len(acc)][whole], mix(acc[whole])
    if short and (few := np.flatnonzero((words.counts > 0) & (words.counts < width))).size:
        extra = np.zeros(len(few), U64)
        for k in range(width - 1):
            has = words.counts[few] > k
            at = np.minimum(words.first[few] + k, n - 1)
            extra = np.where(has, extra * U64(0xA0761D6478BD642F) + h[at] + U64(k + 1), extra)
        docs, out = np.concatenate([docs, few]), np.concatenate([out, mix(extra ^ U64(0x5851F42D4C957F2D))])
    return docs, out


#: Bits of a shingle's hash in a set.
SET_BITS = 48


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as 48-bit numbers, sorted within each text, and their offsets by text."""
    docs, h = shingles(words, width)
    keys = np.sort((docs.astype(U64) << U64(SET_BITS)) | (h >> U64(64 - SET_BITS)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    bounds = np.searchsorted(keys, np.arange(len(words.counts) + 1, dtype=U64) << U64(SET_BITS)) if len(words.counts) < 1 << 16 else np.concatenate([np.searchsorted(keys, np.arange(len(words.counts), dtype=U64) << U64(SET_BITS)), [len(keys)]])
    return keys & U64((1 << SET_BITS) - 1), bounds


def annotate(docs: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Append the columns that ``fn`` computes from the text column, in one narrow pass.

    An input column with the name of an appended one is replaced.
    """
    names = {f.name for f in fields}
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c == text or c not in names])
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    def run(batches):
        for batch in batches:
            new = fn(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + new, names=kept + [f.name for f in fields])
        release()

    return docs.mapInArrow(run, schema)
