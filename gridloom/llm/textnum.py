"""Vectorised text kernels on Arrow string buffers: words, hashes, shingles and byte-level BPE.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters, with A-Z lower-cased.
Hashes are 64-bit: a polynomial over random byte codes, then a finalizer. They depend on the bytes of the word alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
_SHINGLE = [int(x) | 1 for x in _RNG.integers(1, 2**63, 16, dtype=np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in enumerate((_RADIX, _RADIX_INV)):
            run = np.full(size, _U(base))
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hasher(data: np.ndarray):
    """A function from (starts, ends) to the 64-bit hash of each data[start:end]."""
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODE[data] * up[: len(data)], out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends)


def words_and_stems(raw: np.ndarray, off: np.ndarray, lengths: range = range(4, 9)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the leading bytes (each of the lengths) of longer words, by text, and their bounds."""
    starts, ends, h, bounds = words(raw, off)
    hasher, doc = span_hasher(_LOWER[raw]), np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    found, owner = [h], [doc]
    for n in lengths:
        long = np.flatnonzero(ends - starts > n)
        found.append(hasher(starts[long], starts[long] + n) ^ _U(_SHINGLE[n]))
        owner.append(doc[long])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(len(off)))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, about limit bytes together; a longer text stands alone, whole."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each text and the number of words) of all texts."""
    data = _LOWER[raw]
    inside = _IS_WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = off[:-1], off[1:]
    full = last > first
    before[first[full]] = False
    after[last[full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, off)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words (of all its words for a shorter text; none for no words) and their bounds by text."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], count)
    end = np.repeat(bounds[1:], count)
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        ok = at + j < end
        total += np.where(ok, h[np.minimum(at + j, max(len(h) - 1, 0))] * _U(_SHINGLE[j]), _U(0)) if len(h) else _U(0)
    return mix(total), out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def different(x: np.ndarray) -> np.ndarray:
    """The different values in ascending order; for many short arrays faster than np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class PieceTable:
    """Open-addressing table from a 64-bit hash to a row number; grows to the given number of entries, then starts anew."""

    def __init__(self, bits: int = 21):
        self.mask = _U((1 << bits) - 1)
        self.most = 1 << (bits - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.rows = np.zeros(int(self.mask) + 1, np.int32)
        self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for none."""
        slot = h & self.mask
        key = self.keys[slot]
        out = np.where(key == h, self.rows[slot], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + _U(1)) & self.mask
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, first_row: int) -> None:
        """Give the different new hashes the row numbers from first_row on."""
        rows = np.arange(first_row, first_row + len(h), dtype=np.int32)
        slot = h & self.mask
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            at, one = np.unique(slot[free], return_index=True)
            self.keys[at], self.rows[at] = h[free[one]], rows[free[one]]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + _U(1)) & self.mask
        self.used += len(h)


_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
_KIND[[9, 10, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)  # bytes that the fast way leaves to the library
_ODD[:9] = _ODD[11:13] = _ODD[14:32] = _ODD[127] = _ODD[128:] = True
_AFTER_QUOTE = np.zeros(256, bool)
_AFTER_QUOTE[list(b"stmdrvl")] = True


def single_piece(path: str):
    """A function from the bytes of one piece to its ids, by the merges of the tokenizer file."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # Fixed rule of byte-level BPE files: printable bytes stand for themselves, the others for 256, 257, ...
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    ranks = {t: i for t, i in ranks.items() if i < 256 + len(model["merges"])}
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class ByteBPE:
    """ids of a byte-level BPE tokenizer file, equal to those of the `tokenizers` library.

    Texts of ASCII and of Latin-1 letters are cut into pieces by array operations, and each different piece is
    merged once, in order of rank, as the library does; every other text (and one that holds `<|` or a contraction) goes to the library whole.
    """

    most_ids = 1 << 24  # kept in all, or those of one slice

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = not special
        self.one = single_piece(path)
        self.table = PieceTable()
        self._reset()

    def _reset(self) -> None:
        self.table.clear()
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.end, self.n = np.zeros(1 << 18, np.uint32), 0, 0

    def _odd(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        odd = _ODD[raw]
        lead = np.flatnonzero(raw == 0xC3)
        if len(lead):
            tail = raw[lead + 1]
            lead = lead[(tail != 0x97) & (tail != 0xB7)]
            odd[lead] = odd[lead + 1] = False
        if len(raw) > 1:
            odd[:-1] |= (raw[:-1] == 39) & _AFTER_QUOTE[raw[1:]]
            odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
        seen = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(odd, out=seen[1:])
        return seen[off[1:]] > seen[off[:-1]]

    def _pieces(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the pieces, which tile all texts."""
        kind = _KIND[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = kind[1:] != kind[:-1]
        cut[off[:-1][off[1:] > off[:-1]]] = True
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(raw))
        mark = np.zeros(len(raw) + 1, bool)
        first = np.zeros(len(raw) + 1, bool)
        first[off] = True
        space = kind[a] == 0
        s, e = a[space], b[space]
        closing = first[e]
        blank = raw[e - 1] == 32
        mark[s[closing | ~blank | (e - s > 1)]] = True
        mark[(e - 1)[~closing & ~blank]] = True
        r = a[~space]
        joined = (r > 0) & ~first[r] & (raw[r - 1] == 32)
        mark[r - joined] = True
        return np.flatnonzero(mark[:-1])

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        h, at = np.unique(h, return_index=True)
        data = raw.tobytes()
        got = [self.one(data[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        count = np.array([len(x) for x in got], np.int64)
        new = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count.sum()))
        while self.n + len(got) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.end + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.end : self.end + len(new)] = new
        self.first[self.n : self.n + len(got)] = self.end + np.cumsum(count) - count
        self.count[self.n : self.n + len(got)] = count
        self.table.add(h, self.n)
        self.end += len(new)
        self.n += len(got)

    def _plain(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts = self._pieces(raw, off)
        ends = np.append(starts[1:], len(raw))
        h = hash_spans(raw, starts, ends)
        h[h == 0] = 1
        row = self.table.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            # many long pieces fill the ids long before the table is full
            if self.table.used + len(new) > self.table.most or self.end and self.end + len(raw) > self.most_ids:
                self._reset()
                new = np.arange(len(h))
                if len(np.unique(h)) > self.table.most:
                    self.table = PieceTable(int(np.ceil(np.log2(len(h)))) + 2)
            self._learn(raw, starts[new], ends[new], h[new])
            row = self.table.find(h)
        count = self.count[row].astype(np.int64)
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return self.flat[ranges(self.first[row], count)], total[np.searchsorted(starts, off)]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by text)."""
        odd = self._odd(raw, off)
        if not odd.any():
            return self._plain(raw, off)
        keep = np.flatnonzero(~odd)
        size = np.diff(off)
        near = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(size[keep], out=near[1:])
        ids, bounds = self._plain(raw[ranges(off[keep], size[keep])], near)
        parts: list = [None] * len(size)
        for k, i in enumerate(keep):
            parts[i] = ids[bounds[k] : bounds[k + 1]]
        data = raw.tobytes()
        rest = np.flatnonzero(odd)
        for i, e in zip(rest, self.lib.encode_batch([data[off[i] : off[i + 1]].decode() for i in rest], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        out = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=out[1:])
        return np.concatenate(parts).astype(np.uint32), out


_kept: dict[tuple, ByteBPE] = {}


def byte_bpe(path: str, special: bool = True) -> ByteBPE:
    """One tokenizer a worker process: its table of pieces serves all tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, special) not in _kept:
        _kept[path, special] = ByteBPE(path, special)
    return _kept[path, special]
