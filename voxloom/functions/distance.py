"""Edit distance of texts by words of bits, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The first distance that is tried; it doubles until it is enough.
BAND = 32


def _trimmed(a: str, b: str) -> tuple[str, str]:
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    k = 0
    while k < n - i and a[len(a) - 1 - k] == b[len(b) - 1 - k]:
        k += 1
    return a[i : len(a) - k], b[i : len(b) - k]


def _places(pattern: str) -> dict[str, int]:
    """For each character the bits of the places that hold it."""
    spots: dict[str, list[int]] = {}
    for i, c in enumerate(pattern):
        spots.setdefault(c, []).append(i)
    size = len(pattern) // 8 + 1
    out = {}
    for c, at in spots.items():
        bits = bytearray(size)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[c] = int.from_bytes(bits, "little")
    return out


def _within(pattern: str, places: dict[str, int], text: str, most: int) -> int:
    """The distance if it is at most ``most``, else any number above; ``pattern`` is no shorter and longer than ``most``.

    A column of the distance table is two numbers, whose bits say where it rises and falls. Only the
    2 * most + 1 cells around the diagonal are kept: the window slides down a cell with each column, and the
    distance is followed along its lower edge, then along the last row.
    """
    width, m = 2 * most + 1, len(pattern)
    mask, edge = (1 << width) - 1, 1 << (width - 1)
    up, down, distance = mask & ~((1 << most) - 1), 0, most
    row = edge >> 1
    for j, c in enumerate(text):
        start = j - most
        bits = places.get(c, 0)
        match = ((bits >> start) if start >= 0 else (bits << -start)) & mask
        zero = (((match & up) + up) ^ up) | match | down
        zero &= mask
        rise, fall = down | (mask & ~(zero | up)), zero & up
        if j < m - most:
            distance += not zero & edge
        else:
            distance += bool(rise & row) - bool(fall & row)
            row >>= 1
        zero >>= 1
        up, down = fall | (mask & ~(zero | rise)), zero & rise
    return distance


def _whole(places: dict[str, int], m: int, text: str) -> int:
    """The distance with all cells of a column in one number."""
    mask, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = mask, 0, m
    for c in text:
        match = places.get(c, 0)
        zero = ((((match & up) + up) ^ up) | match | down) & mask
        rise, fall = down | (mask & ~(zero | up)), zero & up
        distance += bool(rise & last) - bool(fall & last)
        rise = ((rise << 1) | 1) & mask
        up, down = ((fall << 1) & mask) | (mask & ~(zero | rise)), zero & rise
    return distance


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and changes of characters from ``a`` to ``b``; time grows with length times distance / 64."""
    a, b = _trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places, band = _places(a), max(BAND, len(a) - len(b))
    while 2 * band < len(a):
        if (found := _within(a, places, b, band)) <= band:
            return found
        band *= 2
    return _whole(places, len(a), b)


def with_distance(rows: DataFrame, a: str, b: str, name: str = "distance") -> DataFrame:
    """``rows`` with the edit distance of the columns ``a`` and ``b``; null counts as empty."""
    kept = [c for c in rows.columns if c != name]
    rows = rows.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(kept.index(a)), batch.column(kept.index(b)))
            found = [edit_distance(x.as_py() or "", y.as_py() or "") for x, y in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*kept, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())]))
