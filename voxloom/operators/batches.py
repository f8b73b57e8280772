"""Arrow batches of rows that are dealt and sorted by a key: many small groups at once, none of them split.

A Python call for each group costs far more than the work of a small one, so a call gets all groups of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Values of the list column that a call gets at once, more only if they are of a single group.
VALUES = 1 << 20


def group_starts(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows at which another group begins, the first row too."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = table.column(k)
        a, b = c.slice(1), c.slice(0, max(table.num_rows - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False) if isinstance(differ, pa.Array) else differ.to_numpy()
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the starts of their groups; a group that goes on in the next batch waits for its end."""
    held: list[pa.RecordBatch] = []

    def together(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        whole = table.to_batches()[0]
        return whole, group_starts(whole, keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(group_starts(batch, keys)[-1])
        if held and last == 0 and len(group_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 1:
            held.append(batch)
            continue
        if held or last:
            yield together([*held, batch.slice(0, last)] if last else held)
        held = [batch.slice(last)]
    if held:
        yield together(held)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of the lists in their flat values, and those values."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def map_groups(rows: DataFrame, keys: list[str], order: list[str], values: str, run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` over the rows of whole groups of ``keys``, each group's in ``order``, and the starts of the groups.

    A call gets the groups of about :data:`VALUES` values of the list column ``values``.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, keys):
            ends = np.append(starts[1:], batch.num_rows)
            share = lists(batch.column(values))[0][ends] // VALUES
            cuts = (np.flatnonzero(np.diff(share)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(starts)]):
                part = batch.slice(int(starts[a]), int(ends[b - 1] - starts[a]))
                yield run(part, starts[a:b] - starts[a])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(over, schema)
