"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once.

A byte-level BPE never joins a non-space with a following space, so a text is cut there into pieces
(white space, then other characters), around the last white space unless it's a space, and behind Latin letters, as its pattern takes letters alone. Known pieces are looked up in numpy tables, by all of their
bytes; new ones go to the library, many in one call. Long pieces, and whole
texts with Unicode white space or with a token added to the vocabulary, go to the library each time.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from voxloom.llm import arrow_text as A

#: Distinct pieces that a worker keeps before it starts anew (some 50 bytes each), slots for them, and bytes of the longest.
CACHE, SLOT_BITS, LONGEST = 500_000, 21, 64
#: New pieces in one call of the library.
CALL = 256
#: The letters that byte-level models have for bytes; a line feed stays, as it ends a word here.
OWN = np.isin(np.arange(256), np.r_[33:127, 161:173, 174:256])
CHARS = np.where(OWN, np.arange(256), 255 + np.cumsum(~OWN)).astype("<u2")
CHARS[10] = 10
#: Masks for the first 0 to 8 bytes of a little-endian word.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], A.U64)


def is_space(data: np.ndarray) -> np.ndarray:
    """ASCII white space, as comparisons of bytes are faster than a table."""
    return (data == 32) | (data - np.uint8(9) < 5)


def is_letter(data: np.ndarray) -> np.ndarray:
    return (data | np.uint8(32)) - np.uint8(97) < 26


def is_latin(data: np.ndarray) -> np.ndarray:
    """Whether each byte but the last begins a letter of U+00C0 to U+017F, which has two bytes."""
    a, b = data[:-1], data[1:]
    return (a - np.uint8(0xC3) < 3) & ((a > 0xC3) | (b != 0x97) & (b != 0xB7))


def piece_slots(first: np.ndarray) -> np.ndarray:
    """The slot of each hash."""
    return (first >> A.U64(64 - SLOT_BITS)).astype(np.int64)


class Pieces:
    """The pieces of a slice: where they begin, their sizes, and their bytes as words of eight."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.begin, self.size = begin, size
        padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)])
        self.view = np.ndarray(len(data) + LONGEST - 8, "<u8", padded, strides=(1,))
        self.first = self.view[begin] & MASKS.take(size, mode="clip")
        self.longer = []  # (k, the pieces that have a word k, these words) of all words behind the first
        at, k = np.flatnonzero(size > 8), 1
        while len(at):
            self.longer.append((k, at, self.word(k, at)))
            k += 1
            at = at[size[at] > 8 * k]

    def word(self, k: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Word ``k`` of the pieces ``at``; none may be over eight times ``k`` bytes short."""
        return self.view[self.begin[at] + 8 * k] & MASKS[np.minimum(self.size[at] - 8 * k, 8)]

    def hashes(self) -> np.ndarray:
        h = self.size.astype(A.U64)
        h *= A.U64(0x9E3779B97F4A7C15)
        h ^= self.first
        h *= A.U64(0xBF58476D1CE4E5B9)
        for _, at, word in self.longer:
            x = h[at]
            x ^= x >> A.U64(29)
            x ^= word
            x *= A.U64(0xD6E8FEB86659FD93)
            h[at] = x
        h ^= h >> A.U64(32)
        h *= A.U64(0x94D049BB133111EB)
        return h

    def table(self, at: np.ndarray) -> np.ndarray:
        """The words of the pieces ``at`` as rows, zeros behind their ends."""
        out, size = np.zeros((len(at), LONGEST // 8), A.U64), self.size[at]
        for k in range(LONGEST // 8):
            has = np.flatnonzero(size > 8 * k)
            if not len(has):
                break
            out[has, k] = self.word(k, at[has])
        return out


def _lines(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces, each with a line feed behind it."""
    ends = np.cumsum(size + 1)
    lines = data[np.minimum(np.arange(int(ends[-1])) + np.repeat(begin - (ends - size - 1), size + 1), len(data) - 1)]
    lines[ends - 1] = 10
    return lines


def one_word(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each piece is a run of letters of U+0041 to U+017F, with a space before it or none: one word of the model."""
    lines = _lines(data, begin, size)
    ends = np.cumsum(size + 1)
    letter, two = is_letter(lines), is_latin(lines)
    letter[:-1] |= two
    letter[1:] |= two
    first = ends - size - 1
    letter[first] |= (lines[first] == 32) & (size > 1)
    return np.add.reduceat(~letter, first, dtype=np.int64) == 1  # the line feed


def words_of(lines: np.ndarray) -> list[str]:
    """Lines of bytes in the model's letters."""
    return CHARS[lines].tobytes().decode("utf-16-le").split("\n")[:-1]


class PieceTokenizer:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = max(self.library.get_vocab(with_added_tokens=True).values(), default=0)
        self.newline = self.ids("\n")
        whole = lambda word: [t.id for t in self.library.model.tokenize(words_of(np.frombuffer(word.encode() + b"\n", np.uint8))[0])]
        self.byte_level = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None and all(whole(x) == self.ids(x) for x in (" the", "word", " Xqzjvk", "q", " \u00e9t\u00e9", "\u017fa\u00df")) and self.ids("ab,cd") == self.ids("ab") + self.ids(",cd")
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.reset()

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def reset(self) -> None:
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.n = 0
        self.sizes, self.starts, self.counts = (np.zeros(1 << 14, np.int32) for _ in range(3))  # of each piece: bytes, where its ids start, ids
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.more, self.more_starts, self.more_used = np.zeros(1 << 14, A.U64), np.zeros(1 << 14, A.U64), np.zeros(1 << 14, np.int32), 0

    def _room(self, name: str, n: int) -> None:
        had = getattr(self, name)
        if n > len(had):
            new = np.zeros(max(n, len(had) * 3 // 2), had.dtype)
            new[: len(had)] = had
            setattr(self, name, new)

    def add(self, sizes: np.ndarray, words: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of new pieces."""
        n, m = self.n, len(sizes)
        rest = words[:, 1:][np.arange(1, words.shape[1])[None, :] * 8 < sizes[:, None]]
        behind = np.maximum(sizes - 1, 0) // 8
        for name, size in (("sizes", n + m), ("starts", n + m), ("counts", n + m), ("first", n + m), ("more_starts", n + m), ("flat", self.used + len(ids)), ("more", self.more_used + len(rest))):
            self._room(name, size)
        self.sizes[n : n + m], self.counts[n : n + m], self.first[n : n + m] = sizes, counts, words[:, 0]
        self.starts[n : n + m] = self.used + np.cumsum(counts) - counts
        self.more_starts[n : n + m] = self.more_used + np.cumsum(behind) - behind
        self.flat[self.used : self.used + len(ids)] = ids
        self.more[self.more_used : self.more_used + len(rest)] = rest
        self.n, self.used, self.more_used = n + m, self.used + len(ids), self.more_used + len(rest)
        return np.arange(n, n + m)

    def known(self, pieces: Pieces, at: np.ndarray) -> np.ndarray:
        """Whether each piece has all the bytes of that at the place ``at``; -1: no."""
        same = (at >= 0) & (self.sizes.take(at) == pieces.size) & (self.first.take(at) == pieces.first)
        for k, i, word in pieces.longer:
            on = same[i]
            i, word = i[on], word[on]
            same[i[self.more.take(self.more_starts.take(at[i]) + (k - 1)) != word]] = False
        return same

    def learn(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces that the library encodes."""
        wordy = one_word(data, begin, size) if self.byte_level and len(begin) else np.zeros(len(begin), bool)
        if not wordy.any():
            return self._calls(data, begin, size)
        at, n_words = [], []
        for word in words_of(_lines(data, begin[wordy], size[wordy])):
            got = self.library.model.tokenize(word)
            n_words.append(len(got))
            at += [t.id for t in got]
        if wordy.all():
            return np.array(at, np.uint32), np.array(n_words, np.int64)
        others, n_others = self._calls(data, begin[~wordy], size[~wordy])
        n = np.zeros(len(begin), np.int64)
        n[wordy], n[~wordy] = n_words, n_others
        own, out = np.repeat(wordy, n), np.empty(int(n.sum()), np.uint32)
        out[own], out[~own] = at, others
        return out, n

    def _calls(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(begin), CALL):
            x, n = self._call(data, begin[k : k + CALL], size[k : k + CALL])
            ids.append(x)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _call(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, z = data[begin], data[np.minimum(begin + 1, len(data) - 1)], data[begin + size - 1]
        # At most one space at the beginning, so a line feed in between is a token of its own.
        plain = (z > 32) & ((a < 9) | (a > 13)) & ((size < 2) | (a != 32) | (b > 32))
        i = np.flatnonzero(plain)
        got, n = np.zeros(0, np.uint32), np.zeros(len(begin), np.int64)
        if len(i) and len(self.newline) == 1:
            ids = np.array(self.library.encode_batch_fast([_lines(data, begin[i], size[i]).tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            cut = ids == self.newline[0]
            at = np.flatnonzero(cut)
            if len(at) == len(i):
                got, n[i] = ids[~cut], np.diff(at, prepend=-1) - 1
                if len(i) == len(begin):
                    return got, n
            else:
                i = i[:0]
        else:
            i = i[:0]
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(begin)
        for k, x in zip(i.tolist(), np.split(got, np.cumsum(n[i])[:-1]) if len(i) else []):
            parts[k] = x
        for k in np.setdiff1d(np.arange(len(begin)), i).tolist():
            parts[k] = np.array(self.ids(data[begin[k] : begin[k] + size[k]].tobytes().decode()), np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text); null counts as empty."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, _, data, off in A.slices(column):
            x, n = self._slice(data, off)
            ids.append(x)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = unicode_space(data, off)
        whole = data.tobytes()
        for token in self.added:  # no piece may cut it
            at = whole.find(token)
            while at >= 0:
                odd[np.searchsorted(off, at, side="right") - 1] = True
                at = whole.find(token, at + 1)
        space, letter = is_space(data), is_letter(data)
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = space[1:] & ~space[:-1]
        start[off] = True
        if self.byte_level:
            goes_on = letter | space | (data >= 128)  # or may
            letter[1:] |= is_latin(data)
            start[1:-1] |= letter[:-1] & ~goes_on[1:]
            # The last white space before another character goes to what follows if it's a space, else it's alone.
            last = space[:-1] & ~space[1:]
            last[off[(off > 0) & (off < len(data))] - 1] = False
            start[:-2] |= last
            start[1:-1] |= last & (data[:-1] != 32)
        begin = np.flatnonzero(start[:-1])
        size = np.diff(begin, append=len(data))
        n_pieces = np.diff(np.searchsorted(begin, off))
        if odd.any():
            plain = np.repeat(~odd, n_pieces)
            begin, size = begin[plain], size[plain]
            n_pieces[odd] = 0
        if self.n > CACHE:
            self.reset()
        at, kept = self.places(data, begin, size)
        counts = self.counts.take(at)
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        where = np.repeat(self.starts.take(at) - ends[:-1], counts)
        where += np.arange(len(where))
        ids = self.flat.take(where)
        self.n, self.used, self.more_used = kept  # pieces that aren't kept go
        if len(self.flat) > 4 * self.used + (1 << 20):
            self.flat = self.flat[: self.used + (1 << 16)].copy()
        sizes = np.diff(ends[np.concatenate([[0], np.cumsum(n_pieces)])])
        if not odd.any():
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for d in np.flatnonzero(odd):
            parts[d] = np.array(self.ids(data[off[d] : off[d + 1]].tobytes().decode()), np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def places(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
        """The place of each piece, and what of the tables is kept; the rest holds until the next call."""
        place, short = np.zeros(len(begin), np.int64), np.flatnonzero(size <= LONGEST)
        pieces = Pieces(data, begin[short], size[short])
        hashes = pieces.hashes() if len(short) else np.zeros(0, A.U64)
        slot = piece_slots(hashes)
        at = self.slots.take(slot)
        miss = np.flatnonzero(~self.known(pieces, at)) if len(short) else short
        place[short] = at
        _, one, each = np.unique(hashes[miss], return_index=True, return_inverse=True)
        words = pieces.table(miss)
        # Equal hashes don't prove equal pieces.
        other = (pieces.size[miss] != pieces.size[miss[one[each]]]) | (words != words[one[each]]).any(axis=1)
        new = miss[one]
        ids, counts = self.learn(data, pieces.begin[new], pieces.size[new])
        added = self.add(pieces.size[new], words[one], ids, counts)
        self.slots[slot[new]] = added
        place[short[miss]] = added[each]
        kept = self.n, self.used, self.more_used
        once = np.concatenate([np.flatnonzero(size > LONGEST), short[miss[other]]])
        if len(once):
            ids, counts = self.learn(data, begin[once], size[once])
            place[once] = self.add(np.zeros(len(once), np.int64), np.zeros((len(once), 1), A.U64), ids, counts)
        return place, kept


@cache
def worker_tokenizer(path: str) -> PieceTokenizer:
    """The tokenizer of this Python worker. Spark reuses workers, so later tasks find the pieces of earlier ones.

    Workers keep it as long as they live, in other stages too, so its tables are small: some 40 MB at most.
    """
    return PieceTokenizer(path)


def unicode_space(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text may hold white space beyond ASCII (some other characters of the same rows count too)."""
    a, b = data[:-1], data[1:]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)
    at = np.flatnonzero(hit)
    odd = np.zeros(len(off) - 1, bool)
    odd[np.searchsorted(off, at, side="right") - 1] = True
    return odd
