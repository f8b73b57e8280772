"""Substring dedup with compact windows.

Tokens are five-word shingles. A passage is a run of ``min_words`` words; longer ones are unions of
runs, as one at the similarity always holds a run at it. Under each of some hash functions, the
Cartesian tree of a text's tokens has a node for every smallest token; the subsequences that a
node is the smallest of share that part of their signature. A node over at least a run's tokens is
a compact window: one row with one key for all its subsequences. Rows whose key one document only
holds are dropped; an interval join of the rest, within each document, keeps the runs that lie in
the windows of enough functions. Rows of different documents with the same key are possible
passages. Their spans, not their texts, are compared:

1. each with the span of the smallest document of its keys that most of them name, along the lines
   on which shared keys lie; this settles groups of copies;
2. what lies outside of confirmed passages, by spans of its own: spans that repeat their tokens meet
   the smallest one with an equal run; runs with too many tokens that no other span holds are dropped,
   and spans that share one of the rarest tokens of a run are compared in full, so that documents
   with a common line don't meet as pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm import arrow_text as A
from voxloom.llm.scratch import saved


@dataclass(frozen=True)
class Passages:
    """Words of the shortest passage, words of a shingle, Jaccard similarity, hash functions, how many must agree.

    Two runs at the similarity agree in a function with that probability: of four, two agree with 0.973.
    """

    min_words: int = 50
    width: int = 5
    similarity: float = 0.8
    functions: int = 4
    agree: int = 2

    @property
    def shingles(self) -> int:
        return self.min_words - self.width + 1

    @property
    def need(self) -> int:
        """Least shingles in common of two runs that reach the similarity."""
        return int(np.ceil(self.shingles * 2 * self.similarity / (1 + self.similarity) - 1e-9))


#: Positions that are searched at once.
STRETCH = 1 << 22
#: Shared places of a pair that are held at once.
PLACES = 1 << 20
_PLACE_BITS = 23
#: Low bits of a key that name its hash function.
_FUNCTION_BITS = 4


def smallest(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest value (the leftmost of equals) of every run of ``w``, by doubling."""
    low = (values >> A.U64(_PLACE_BITS) << A.U64(_PLACE_BITS)) | np.arange(len(values), dtype=A.U64)
    have = 1
    while 2 * have <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[: len(low) - (w - have)], low[w - have :])
    return (low & A.U64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def positional(words: A.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, hash) of every shingle, in order."""
    docs, h = A.shingles(words, width, short=False)
    first = np.searchsorted(docs, np.arange(len(words.counts)))
    return docs, np.arange(len(docs)) - first[docs], h


def nearest_smaller(v: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, or -1, by jumps from one to the next."""
    left = np.arange(-1, len(v) - 1)
    todo = np.flatnonzero(left >= 0)
    todo = todo[v[left[todo]] > v[todo]]
    while len(todo):
        left[todo] = left[left[todo]]
        todo = todo[left[todo] >= 0]
        todo = todo[v[left[todo]] > v[todo]]
    return left


def compact_windows(docs: np.ndarray, place: np.ndarray, h: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, (first, last, at)): the windows [l, r] of the nodes of the Cartesian trees over at least a run.

    ``at`` is the node's place; the runs that it is the smallest token of start at ``first`` to
    ``last``, which are all starts from l to ``at`` that leave room for a run up to r.
    """
    w, keys, owners, spans = p.shingles, [], [], []
    for f in range(p.functions):
        values, nodes = A.mix(h ^ A.mix(np.array([f + 1], A.U64) * A.U64(0x9FB21C651E98DF25))), []
        for a in range(0, max(0, len(h) - w + 1), STRETCH):
            low = smallest(values[a : a + STRETCH + w - 1], w) + a
            start = np.arange(a, a + len(low))
            low = low[docs[start] == docs[start + w - 1]]
            nodes.append(low[np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]])
        c = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        if not len(c):
            continue
        c = c[np.diff(c, prepend=-1) > 0]  # the leftmost smallest of runs in order never goes back
        # Every ancestor of a node has a larger window, so the nodes know their bounds from each other.
        value = (values[c] >> A.U64(_PLACE_BITS) << A.U64(_PLACE_BITS)) | (c % (1 << _PLACE_BITS)).astype(A.U64)
        edge = np.flatnonzero(np.concatenate([[True], docs[c][1:] != docs[c][:-1]]))
        v, at = np.insert(value, edge, 0), np.insert(c, edge, -1)  # a text's nodes stand between zeros
        n = len(v)
        left = nearest_smaller(v)
        right = n - 1 - nearest_smaller(v[::-1])[::-1]
        real = np.flatnonzero(at >= 0)
        d, x = docs[c], place[c]
        size = np.bincount(docs, minlength=int(docs[-1]) + 1)
        l = np.where(at[left[real]] >= 0, place[at[left[real]]] + 1, 0)
        after = np.where(right[real] < n, right[real], 0)
        r = np.where((right[real] < n) & (at[after] >= 0), place[at[after]] - 1, size[d] - 1)
        keys.append(values[c] >> A.U64(_FUNCTION_BITS) << A.U64(_FUNCTION_BITS) | A.U64(f))
        owners.append(d)
        spans.append(np.stack([np.maximum(l, x - w + 1), np.minimum(x, r - w + 1), x], 1).astype(np.int32))
    if not keys:
        return np.zeros(0, A.U64), np.zeros(0, np.int64), np.zeros((0, 3), np.int32)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(spans)


def windows(source: DataFrame, p: Passages) -> DataFrame:
    """(key, id, first, last, at) rows of all texts."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, off in A.slices(batch.column(1)):
                keys, owner, spans = compact_windows(*positional(A.Words(data, off, A.NON_SPACE), p.width), p)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), ids.slice(i, j - i).take(pa.array(owner)), *(pa.array(spans[:, k].copy()) for k in range(3))], names=["key", "id", "first", "last", "at"])

    return source.mapInArrow(run, "key long, id long, first int, last int, at int")


def of_shared_keys(rows: DataFrame) -> DataFrame:
    """The rows whose key more than one document holds.

    Both sides read one shuffle, so the windows are found once. A key is one row of the side that is
    built, and the rows of a common one only pass by, so none is sorted or held.
    """
    rows = rows.repartition("key")
    # Places aren't negative; they are asked for so that both sides have the same columns, else Spark would shuffle twice.
    far = F.max(F.col("first") + F.col("last") + F.col("at")).alias("far")
    keys = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), far).where("low < high and far >= 0").select("key")
    return rows.join(keys.hint("shuffle_hash"), "key")


def runs_of_enough_windows(first: np.ndarray, last: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal stretches of starts that lie in ``agree`` of the intervals [first, last]."""
    at = np.concatenate([first, last + 1])
    order = np.argsort(at, kind="stable")
    at, depth = at[order], np.cumsum(np.repeat([1, -1], len(first))[order])
    whole = np.concatenate([at[1:] != at[:-1], [True]])[: len(at)]
    at, enough = at[whole], depth[whole] >= agree
    change = np.flatnonzero(enough != np.concatenate([[False], enough])[: len(enough)])
    return at[change[::2]], at[change[1::2]]


def agreeing(rows: DataFrame, p: Passages, within: tuple[str, ...] = ("id",)) -> DataFrame:
    """Of each document, the rows with a run in the windows of enough functions, cut to such runs.

    ``span`` is the first run of the stretch of neighbouring rows that a row belongs to, ``span_end``
    the end of its last run. A document's rows come together; they are fewer than its words. The
    functions are counted ``within`` groups of these columns.
    """
    n = len(within)

    def run(batches):
        for batch in batches:
            lists = batch.column(n)
            owner, flat = pa.compute.list_parent_indices(lists).to_numpy(), lists.flatten()
            key, first, last, at = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            # One line for all documents of the batch; a gap of two keeps them apart.
            length = np.zeros(len(lists), np.int64)
            np.maximum.at(length, owner, last + 3)
            base = np.cumsum(length) - length
            first, last = first + base[owner], last + base[owner]
            low, high = runs_of_enough_windows(first, last, p.agree)
            a, b = np.searchsorted(high, first, "right"), np.searchsorted(low, last, "right") - 1
            on = np.flatnonzero(a <= b)
            owner, key, at = owner[on], key[on], at[on]
            first, last = np.maximum(first[on], low[a[on]]), np.minimum(last[on], high[b[on]] - 1)
            begin, end = runs_of_enough_windows(first, last, 1)
            k = np.searchsorted(begin, first, "right") - 1
            off = base[owner]
            cols = [pa.array(key), *(batch.column(c).take(pa.array(owner)) for c in range(n)), *(pa.array((x - off).astype(np.int32)) for x in (first, last))]
            cols += [pa.array(at), *(pa.array((x - off).astype(np.int32)) for x in (begin[k], end[k] - 1 + p.shingles))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", *within, "first", "last", "at", "span", "span_end"])

    lists = rows.groupBy(*within).agg(F.collect_list(F.struct("key", "first", "last", "at")).alias("rows"))
    groups = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in within)
    return lists.mapInArrow(run, f"key long, {groups}, first int, last int, at int, span int, span_end int")


def in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of 32 bits sorted, and the place of each; equal ones by place."""
    keys = np.sort((x.astype(A.U64) << A.U64(32)) | np.arange(len(x), dtype=A.U64))
    return keys >> A.U64(32), (keys & A.U64(0xFFFFFFFF)).astype(np.int64)


def before(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Last place before of the same value, or -1, from values in order."""
    again = np.flatnonzero(values[1:] == values[:-1])
    out = np.full(len(values), -1, np.int64)
    out[places[again + 1]] = places[again]
    return out


def holding(places: np.ndarray, earlier: np.ndarray, n: int, w: int) -> np.ndarray:
    """Count of distinct values of every run of ``w`` of n values, of those at ``places``; ``earlier`` is the same value's place before."""
    first = np.maximum(np.maximum(places - w + 1, earlier + 1), 0)
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(places + 1, minlength=n + 1))[: n - w + 1]


def aligned(x: np.ndarray, y: np.ndarray, n: int, m: int, w: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(start in a, start in b) of the runs of ``w`` with ``need`` equal shingles at equal places."""
    keys = np.sort(((x - y + m) << 32) | x)
    x, d = keys & 0xFFFFFFFF, (keys >> 32) - m
    i = np.arange(max(0, len(x) - need + 1))
    i = i[(d[i] == d[i + need - 1]) & (x[i + need - 1] - x[i] < w)]
    low = np.maximum(np.maximum(x[i + need - 1] - w + 1, 0), d[i])
    count = np.maximum(np.minimum(np.minimum(x[i], n - w), m - w + d[i]) - low + 1, 0)
    start = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    return start, start - np.repeat(d[i], count)


def repeats(a: np.ndarray, b: np.ndarray, p: Passages) -> list[tuple[int, int, int]]:
    """(first word in a, end word in a, first word in b) of the passages of a that b holds.

    a and b are shingles in order, as numbers of 32 bits. Every run of a is tried; first against b
    along lines of shared shingles, then, as words put in or left out shift the line, against every
    run of b.
    """
    w, n, m = p.shingles, len(a), len(b)
    if n < w or m < w:
        return []
    (a_values, a_places), (b_values, order) = in_order(a), in_order(b)
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    low[a_places], high[a_places] = (np.searchsorted(b_values, a_values, side) for side in ("left", "right"))
    before_a = before(a_values, a_places)
    own, shared = holding(np.arange(n), before_a, n, w), np.flatnonzero(high > low)
    there = holding(shared, before_a[shared], n, w)
    if not (there >= p.similarity * own - 1e-9).any():
        return []
    before_b = before(b_values, order)
    others = holding(np.arange(m), before_b, m, w)
    at = np.concatenate([[0], np.cumsum(high - low)])
    other = np.full(n - w + 1, -1, np.int64)
    begin = 0
    while begin < n - w + 1:  # stretches of a, so that few places are held at once
        end = min(n - w + 1, max(begin + 1, int(np.searchsorted(at, at[begin] + PLACES)) - w))
        x = np.repeat(np.arange(begin, end + w - 1), (high - low)[begin : end + w - 1])
        y = order[np.arange(len(x)) + at[begin] - at[x] + low[x]]
        start, t = aligned(x, y, n, m, w, p.need)
        inside = (start >= begin) & (start < end)
        start, t = start[inside], t[inside]
        sure = (own[start] == w) & (others[t] == w)  # with repeated shingles, equal places say less
        other[start[sure]] = t[sure]
        begin = end
    least = p.similarity / (1 + p.similarity) * (own + np.maximum(others.min(), p.similarity * own))
    rest, step = np.flatnonzero((other < 0) & (there >= least - 1e-9)), max(1, PLACES // (m + w))
    for part in np.split(rest, range(step, len(rest), step)):
        if not len(part):
            continue
        x = part[:, None] + np.arange(w)
        row, k = np.nonzero((before_a[x] < part[:, None]) & (high > low)[x])  # each shingle of a run once
        x = x[row, k]
        count = (high - low)[x]
        row, y = np.repeat(row, count), order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low[x], count)]
        # A place of b counts in the runs that it is in and its value's place before isn't.
        first = np.maximum(np.maximum(y - w + 1, before_b[y] + 1), 0)
        size = len(part) * (m + 1)
        same = np.bincount(row * (m + 1) + first, minlength=size) - np.bincount(row * (m + 1) + y + 1, minlength=size)
        same = np.cumsum(same.reshape(len(part), m + 1), axis=1)[:, : m - w + 1]
        share = same / (own[part][:, None] + others - same)
        t = share.argmax(axis=1)
        good = share[np.arange(len(part)), t] >= p.similarity - 1e-9
        other[part[good]] = t[good]
    return merged_runs(other, p)


def span_tokens(rows: DataFrame, source: DataFrame, p: Passages) -> DataFrame:
    """(id, span, tokens): the shingles of each span, 32 bits of each hash, as bytes."""
    spans = rows.groupBy("id", "span").agg(F.max("span_end").alias("end")).groupBy("id").agg(F.collect_list(F.struct("span", "end")).alias("spans"))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            owner, flat = pa.compute.list_parent_indices(lists).to_numpy(), lists.flatten()
            begin, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for i, j, data, off in A.slices(batch.column(1)):
                docs, _, h = positional(A.Words(data, off, A.NON_SPACE), p.width)
                first, h = np.searchsorted(docs, np.arange(j - i)), (h >> A.U64(32)).astype(np.uint32)
                a, b = np.searchsorted(owner, [i, j])
                low = first[owner[a:b] - i]
                out = [h[x + s : x + e].tobytes() for x, s, e in zip(low.tolist(), begin[a:b].tolist(), end[a:b].tolist())]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[a:b])), pa.array(begin[a:b].astype(np.int32)), pa.array(out, pa.binary())], names=["id", "span", "tokens"])

    return source.join(spans.hint("merge"), "id").select("id", "text", "spans").mapInArrow(run, "id long, span int, tokens binary")


def along_lines(a: np.ndarray, b: np.ndarray, lines: np.ndarray, p: Passages) -> np.ndarray:
    """For each run of a, the start of a run of b that is like it on one of the lines (place in a - place in b), or -1.

    With e unequal places, d distinct tokens lose e at most and gain e at most, so (d - e) / (d + e) is
    the least similarity.
    """
    w, n, m, need = p.shingles, len(a), len(b), p.need
    other, own = np.full(max(0, n - w + 1), -1, np.int64), None
    for line in lines.tolist():
        low, high = max(0, line), min(n, m + line)
        if high - low < w:
            continue
        unequal = np.concatenate([[0], np.cumsum(a[low:high] != b[low - line : high - line])])
        unequal = unequal[w:] - unequal[:-w]
        start = np.flatnonzero(unequal <= w - need)
        if not len(start):
            continue
        if own is None:
            own = holding(np.arange(n), before(*in_order(a)), n, w)
        e = unequal[start]
        start = start[own[start + low] * (1 - p.similarity) >= e * (1 + p.similarity) - 1e-9] + low
        other[start] = start - line
    return other


def merged_runs(other: np.ndarray, p: Passages) -> list[tuple[int, int, int]]:
    """(first word in a, end word in a, first word in b) of the passages that runs with a match make together."""
    found = np.flatnonzero(other >= 0)
    if not len(found):
        return []
    new = np.flatnonzero(np.diff(found, prepend=-p.min_words - 1) > p.min_words)
    last = found[np.append(new[1:], len(found)) - 1]
    return list(zip(found[new].tolist(), (last + p.min_words).tolist(), other[found[new]].tolist()))


def verify(pairs: DataFrame, tokens: DataFrame, p: Passages) -> DataFrame:
    """(id, other, start_word, end_word, other_start) of pairs of spans (id, span, other, other_span).

    With ``lines``, on which shared keys lie in the texts, only these are tried.
    """
    lined = "lines" in pairs.columns
    theirs = tokens.select(F.col("id").alias("other"), F.col("span").alias("other_span"), F.col("tokens").alias("others"))
    both = pairs.join(tokens.hint("merge"), ["id", "span"]).join(theirs.hint("merge"), ["other", "other_span"])

    def run(batches):
        for batch in batches:
            out = []
            ids, span, other, other_span = (batch.column(k).to_pylist() for k in range(4))
            for k in range(len(batch)):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in (4, 5))
                if lined:
                    lines = batch.column(6)[k].values.to_numpy() - span[k] + other_span[k]
                    found = merged_runs(along_lines(a, b, lines, p), p)
                else:
                    found = repeats(a, b, p)
                out += [(ids[k], other[k], span[k] + x, span[k] + y, other_span[k] + z) for x, y, z in found]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "other", "start_word", "end_word", "other_start"])

    rows = both.select("id", "span", "other", "other_span", "tokens", "others", *["lines"] * lined)
    return rows.mapInArrow(run, "id long, other long, start_word long, end_word long, other_start long")


def outside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (id, at) whose place is in no passage of ``found``."""
    spans = found.groupBy("id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("passages"))
    free = rows.join(spans.hint("merge"), "id", "left").where("passages is null or not exists(passages, s -> s.start_word <= at and at < s.end_word)")
    return free.drop("passages")


def parts_of(rows: DataFrame, tokens: DataFrame, p: Passages) -> DataFrame:
    """(id, span, tokens, plain, runs): the stretches of each span that rows (id, span, first, last, open) cover.

    ``plain`` tells that no token repeats within a run, ``runs`` are the distinct open (first, last).
    """

    def run(batches):
        for batch in batches:
            h, at = token_buffer(batch.column(2))
            begin = batch.column(1).to_numpy().astype(np.int64)
            owner, flat = pa.compute.list_parent_indices(batch.column(3)).to_numpy(), batch.column(3).flatten()
            first, last, is_open = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            # All spans of the batch lie in one line; a span's last run ends before the next span, so none touch.
            first, last = first + (at[:-1] - begin)[owner], last + (at[:-1] - begin)[owner]
            low, high = runs_of_enough_windows(first, last, 1)
            span = np.searchsorted(at, low, "right") - 1
            size = high - 1 + p.shingles - low
            ends = np.concatenate([[0], np.cumsum(size)])
            part = np.repeat(np.arange(len(low)), size)
            tokens = h[np.arange(ends[-1]) - ends[part] + low[part]]
            # A token twice in a run of its part.
            keys = (part.astype(A.U64) << A.U64(32)) | tokens
            order = np.argsort(keys, kind="stable")
            twice = (keys[order[1:]] == keys[order[:-1]]) & (order[1:] - order[:-1] < p.shingles)
            plain = np.ones(len(low), bool)
            plain[part[order[1:][twice]]] = False
            a, b = runs_of_enough_windows(first[is_open], last[is_open], 1)
            mine = np.searchsorted(low, a, "right") - 1
            off = (begin - at[:-1])[span]
            runs = pa.StructArray.from_arrays([pa.array((x + off[mine]).astype(np.int32)) for x in (a, b - 1)], names=["first", "last"])
            run_ends = np.searchsorted(mine, np.arange(len(low) + 1)).astype(np.int32)
            cols = [batch.column(0).take(pa.array(span)), pa.array((low + off).astype(np.int32)), token_column(tokens, ends), pa.array(plain), pa.ListArray.from_arrays(pa.array(run_ends), runs)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "span", "tokens", "plain", "runs"])

    lists = rows.groupBy("id", "span").agg(F.collect_list(F.struct("first", "last", "open")).alias("rows"))
    both = tokens.join(lists.hint("merge"), ["id", "span"]).select("id", "span", "tokens", "rows")
    return both.mapInArrow(run, "id long, span int, tokens binary, plain boolean, runs array<struct<first:int,last:int>>")


def token_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all rows, place of the first of each row and the end) of a column of token bytes."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    h = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint32) if data is not None and data.size else np.zeros(0, np.uint32)
    return h, (at - at[0]) // 4


def token_column(tokens: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A column of token bytes; ``ends`` are the places of the first token of each row, and the end."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(tokens))]).cast(pa.binary())


def distinct_tokens(parts: DataFrame) -> DataFrame:
    """(token, plain, id, span) of every part's distinct tokens."""

    def run(batches):
        for batch in batches:
            h, at = token_buffer(batch.column(2))
            keys = (np.repeat(np.arange(len(batch), dtype=A.U64), np.diff(at)) << A.U64(32)) | h
            keys = np.unique(keys)
            owner = pa.array((keys >> A.U64(32)).astype(np.int64))
            token = pa.array((keys & A.U64(0xFFFFFFFF)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([token, batch.column(3).take(owner), batch.column(0).take(owner), batch.column(1).take(owner)], names=["token", "plain", "id", "span"])

    return parts.select("id", "span", "tokens", "plain").mapInArrow(run, "token long, plain boolean, id long, span int")


def placed_tokens(parts: DataFrame, p: Passages) -> DataFrame:
    """(token, id, span, at) of the places of the runs that start in ``runs``."""

    def run(batches):
        for batch in batches:
            h, at = token_buffer(batch.column(2))
            owner, flat = pa.compute.list_parent_indices(batch.column(3)).to_numpy(), batch.column(3).flatten()
            first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(2))
            off = batch.column(1).to_numpy() - at[:-1]
            low, high = runs_of_enough_windows(first - off[owner], last - off[owner] + p.shingles - 1, 1)
            size = high - low
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - low, size)
            part = np.searchsorted(at, place, "right") - 1
            mine = pa.array(part)
            yield pa.RecordBatch.from_arrays([pa.array(h[place].astype(np.int64)), batch.column(0).take(mine), batch.column(1).take(mine), pa.array((place + off[part]).astype(np.int32))], names=["token", "id", "span", "at"])

    return parts.select("id", "span", "tokens", "runs").mapInArrow(run, "token long, id long, span int, at int")


def run_sets(parts: DataFrame, p: Passages, only_open: bool) -> DataFrame:
    """(token, id, span, at): a hash of the set of tokens of each run, for the runs that are open or for all."""

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(3)]
            for k, runs in enumerate(batch.column(3).to_pylist()):
                h, begin = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint32), batch.column(1)[k].as_py()
                same, value = before(*in_order(h)), A.mix(h.astype(A.U64) + A.U64(1))
                place = np.arange(len(h))
                # A place counts in the runs that it is in and its token's place before isn't.
                sums = np.zeros(len(h) + 1, A.U64)
                np.add.at(sums, np.maximum(np.maximum(place - p.shingles + 1, same + 1), 0), value)
                np.subtract.at(sums, place + 1, value)
                sums = np.cumsum(sums)[: max(0, len(h) - p.shingles + 1)]
                starts = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in runs]) - begin if only_open else np.arange(len(sums))
                first = np.unique(sums[starts], return_index=True)[1] if len(starts) else starts
                for col, x in zip(cols, (sums[starts[first]].view(np.int64), np.full(len(first), k), (starts[first] + begin).astype(np.int32))):
                    col.append(x)
            flat, owner, at = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            mine = pa.array(owner.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column(0).take(mine), batch.column(1).take(mine), pa.array(at.astype(np.int32))], names=["token", "id", "span", "at"])

    return parts.select("id", "span", "tokens", "runs").mapInArrow(run, "token long, id long, span int, at int")


def rarest(at: np.ndarray, token: np.ndarray, count: np.ndarray, starts: np.ndarray, plain: bool, p: Passages) -> np.ndarray:
    """Indexes of the places whose tokens are among the rarest of a run, of those that another span holds.

    ``at`` ascends; ``count`` is the number of other spans that hold the token. A run of d distinct
    tokens needs a share of them in common with any run at the similarity, and more if that one's tokens
    are all distinct (``plain``). Of one more than it may lack, the rarest, one is in common. If
    nobody else holds these, the run has no match. Runs of three distinct tokens or fewer are left
    out, as only an equal set is like theirs.
    """
    w, n = p.shingles, len(at)
    same = before(*in_order(token))
    index = np.searchsorted(at, starts)
    own = holding(np.arange(n), same, n, w)[index]
    alone = np.flatnonzero(count == 0)
    singles = holding(alone, same[alone], n, w)[index]
    need = p.similarity / (1 + p.similarity) * (own + w) if plain else p.similarity * own
    spare = own - np.ceil(need - 1e-9).astype(np.int64)
    # A union with one token more is too large for the smallest sets.
    on = (singles <= spare) & (own >= p.similarity * (own + 1) - 1e-9)
    index, spare = index[on], spare[on]
    picked = np.zeros(n, bool)
    if not len(index):
        return np.flatnonzero(picked)
    order = np.lexsort((token, count))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    step = max(1, PLACES // w)
    for a in range(0, len(index), step):
        first, most = index[a : a + step], spare[a : a + step]
        x = first[:, None] + np.arange(w)
        once = same[x] < first[:, None]
        ranks = np.sort(np.where(once, rank[x], n), axis=1)
        picked[x[once & (rank[x] <= ranks[np.arange(len(first)), most][:, None])]] = True
    return np.flatnonzero(picked & (count > 0))


def rare_tokens(parts: DataFrame, p: Passages) -> DataFrame:
    """(id, span, token, plain, at) of the rarest tokens of the runs, among plain parts and among the others.

    ``held`` lists (at, token, plain parts that hold it, other parts that do), the part itself among them.
    """

    def run(batches):
        for batch in batches:
            cols, lists = [[] for _ in range(5)], batch.column(4)
            ids, span, own_plain = (batch.column(c).to_pylist() for c in range(3))
            for k, runs in enumerate(batch.column(3).to_pylist()):
                at, token, *counts = (lists[k].values.field(c).to_numpy(zero_copy_only=False) for c in range(4))
                order = np.argsort(at)
                starts = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in runs]))
                for plain, count in zip((True, False), counts):
                    count = np.maximum(count - (own_plain[k] == plain), 0)
                    i = order[rarest(at[order], token[order], count[order], starts, plain, p)]
                    for col, x in zip(cols, (np.full(len(i), ids[k]), np.full(len(i), span[k], np.int32), token[i], np.full(len(i), plain), at[i])):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, kinds)], names=["id", "span", "token", "plain", "at"])

    return parts.select("id", "span", "plain", "runs", "held").mapInArrow(run, "id long, span int, token long, plain boolean, at int")


def apart(still: DataFrame, rows: DataFrame, tokens: DataFrame, p: Passages) -> list[DataFrame]:
    """Passages of the rows ``still`` open, against every earlier span that may hold one."""
    keys = saved(still.select("key").distinct(), "passage-open-keys")
    met = rows.join(keys.hint("merge"), "key").select("id", "span", "first", "last", F.lit(False).alias("open"))
    met = met.union(still.select("id", "span", "first", "last", F.lit(True).alias("open")))
    parts = saved(parts_of(met, tokens, p), "passage-parts")
    each = saved(distinct_tokens(parts), "passage-each")
    count = lambda c: F.count(F.when(c, 1))
    lowest = lambda c: F.min(F.when(c, F.struct("id", "span")))
    plain = F.col("plain")
    held = each.groupBy("token").agg(count(plain).alias("n_plain"), count(~plain).alias("n_other"), lowest(plain).alias("low_plain"), lowest(~plain).alias("low_other"))
    held = saved(held.where("n_plain + n_other > 1"), "passage-held")
    open_parts = parts.where("size(runs) > 0")
    own = placed_tokens(open_parts, p).join(held.select("token", "n_plain", "n_other").hint("merge"), "token", "left")
    n = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_plain", "n_other")]
    own = own.groupBy("id", "span").agg(F.collect_list(F.struct("at", "token", *n)).alias("held"))
    # Runs that repeat their tokens can have few distinct ones, which many texts hold: first equal sets.
    mixed = parts.where("not plain")
    lowest = run_sets(mixed, p, False).groupBy("token").agg(F.min(F.struct("id", "span")).alias("low"), F.max("id").alias("high")).where("low.id < high")
    lowest = saved(lowest.select("token", F.col("low.id").alias("other"), F.col("low.span").alias("other_span")), "passage-sets")
    equal = run_sets(mixed.where("size(runs) > 0"), p, True).join(lowest.hint("merge"), "token").where("other < id").select("id", "span", "other", "other_span").distinct()
    compared = saved(equal, "passage-pairs")
    found = [saved(verify(compared, parts, p), "passages")]
    rare = outside(rare_tokens(open_parts.select("id", "span", "plain", "runs").join(own.hint("merge"), ["id", "span"]), p), found[0])
    rare, pair = saved(rare, "passage-rare"), ["id", "span", "other", "other_span"]
    low = [held.select("token", F.lit(c == "low_plain").alias("plain"), F.col(f"{c}.id").alias("other"), F.col(f"{c}.span").alias("other_span")).where("other is not null") for c in ("low_plain", "low_other")]
    # Then the smallest holder of each rare token, then, for what is still open, all of them.
    for holders in (low[0].union(low[1]), each.select("token", "plain", F.col("id").alias("other"), F.col("span").alias("other_span"))):
        pairs = rare.join(holders.hint("merge"), ["token", "plain"]).where("other < id").select(pair).distinct()
        pairs = saved(pairs.join(compared.hint("merge"), pair, "left_anti"), "passage-pairs")
        compared = compared.union(pairs)
        found.append(saved(verify(pairs, parts, p), "passages"))
        rare = saved(outside(rare, found[-1]), "passage-rare")
    return found


def repeated_passages(docs: DataFrame, p: Passages = Passages(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, source_id, source_start): passages that an earlier document (by id) holds too.

    Words are split at white space and A-Z lower-cased. A passage that an earlier document holds is
    listed, or shares a word with one that is; it can be listed with more than one source. Documents
    with fewer than ``min_words`` words, null or empty texts and null ids have no passages. Of rows
    that repeat an id, the smallest text counts. Other columns are ignored; an empty table gives an
    empty result.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    if not source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        source = saved(source.groupBy("id").agg(F.min("text").alias("text")), "passage-texts")
    rows = windows(source, p)
    rows = saved(agreeing(of_shared_keys(rows), p), "passage-windows")
    tokens = saved(span_tokens(rows, source, p), "passage-tokens")
    lowest = rows.groupBy("key").agg(F.min(F.struct("id", "span", "at")).alias("lowest"), F.max("id").alias("high")).where("lowest.id < high")
    lowest = lowest.select("key", F.col("lowest.id").alias("other"), F.col("lowest.span").alias("other_span"), F.col("lowest.at").alias("other_at"))
    met = saved(rows.join(saved(lowest, "passage-anchors").hint("merge"), "key").where("other < id"), "passage-rows")
    # Each span is compared with the smallest document that most of its keys name.
    lines = F.collect_set(F.col("at") - F.col("other_at")).alias("lines")
    counts = met.groupBy("id", "span", "other", "other_span").agg(F.count(F.lit(1)).alias("n"), lines)
    pairs = counts.groupBy("id", "span").agg(F.max_by(F.struct("other", "other_span", "lines"), F.struct("n", -F.col("other"))).alias("o"))
    found = saved(verify(pairs.select("id", "span", "o.*"), tokens, p), "passages")
    still = outside(met.select("key", "id", F.col("span").alias("within"), "first", "last", "at"), found)
    # A passage without a word of a listed one has all its rows here, so enough of them agree still.
    still = agreeing(still, p, ("id", "within")).select("key", "id", F.col("within").alias("span"), "first", "last", "at")
    still = saved(still, "passage-open")
    out = reduce(DataFrame.unionAll, [found, *apart(still, rows, tokens, p)])
    return out.select(F.col("id").alias(id_col), "start_word", "end_word", F.col("other").alias("source_id"), F.col("other_start").alias("source_start"))
