"""Byte-level BPE by prefix dynamic programming: encoding, decoding, exact appends and re-encoding near edits.

The encoding of every byte prefix of a piece ends with one token, and that token is the only one ending there which the
merges leave apart from the last token of the prefix before it. So one pass over the tokens that end at each byte
(an Aho-Corasick automaton names them) fills an array of last tokens, and the ids are read off it backwards. The array of a
prefix doesn't depend on what follows: an append goes on where it stops, an edit is computed from its place on
until the last tokens agree with the old ones for as long as a token can be.

In bulk each different piece is encoded once a worker (pieces are told apart by 64-bit hashes); plain texts are cut
into pieces by array operations, the others by the pattern itself.

Defined results: a null text is empty and an empty one has no ids; null ids and repeated rows are encoded like others;
an empty table gives an empty result; columns besides the id and the text are ignored, whatever their names. Ids that the
vocabulary lacks can't be decoded: ValueError.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textnum

_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """The tokens of a rank file with the merge that makes each: bytes have the least ranks, a merge's rank is its token's."""

    def __init__(self, path: str):
        import ahocorasick

        self.ranks = read_ranks(path)
        if sorted(self.ranks.get(bytes([b]), -1) for b in range(256)) != list(range(256)):
            raise ValueError("the ranks 0 to 255 must be the 256 bytes")
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.odd = set()  # tokens that no merge makes: they stand for whole pieces alone
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
                if a < rank and b < rank and a not in self.odd and b not in self.odd and self._apart(a, b):
                    self.left[rank], self.right[rank], self.pairs[a, b] = a, b, rank
                    break
            else:
                self.odd.add(rank)
        self.known.clear()
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if rank not in self.odd:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def _apart(self, a: int, b: int) -> bool:
        """Whether two neighbours stay tokens of their own.

        Their merges are undone, the latest first (of one rank the right one, as merges go from left to right). They stay
        apart unless, at some moment, the two at the border would have merged before the merge just undone.
        """
        before = _NEVER
        while self.pairs.get((a, b), _NEVER) >= before:
            if a < 256 and b < 256:
                return True
            if a > b:
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]
        return False

    def apart(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= 1 << 18:
                self.known.clear()
            found = self.known[a, b] = self._apart(a, b)
        return found

    def last_tokens(self, piece: bytes, known: array | None = None, old: array | None = None, same: int = 0) -> tuple[array, int]:
        """(the last token of each byte prefix, how many had to be found).

        The first ones may be known. The piece may end in the same `same` bytes as an older one, whose last tokens are `old`.
        """
        last = array("I", known or ())
        first, run, found = len(last), 0, 0
        apart, shift = self.apart, len(old or ()) - len(piece)
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1"), max(0, first + 1 - self.longest)):
            if end != len(last):  # shorter tokens where the one is found, or what is known
                continue
            start = end - size
            if start >= -1 and (start < 0 or apart(last[start], token)):
                last.append(token)
                found += 1
                if end >= len(piece) - same:
                    run = run + 1 if old[end + shift] == token else 0
                    if run == self.longest:
                        last.extend(old[end + shift + 1 :])
                        break
        return last, found

    def read_off(self, piece: bytes, last: array) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        ids, at = [], len(piece)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.read_off(piece, self.last_tokens(piece)[0])


def spans(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """Start and end of every piece; an empty text has none."""
    return list(zip(starts, [*starts[1:], len(text)], strict=True)) if starts else []


class Prefixes:
    """A text cut into pieces with the last token of every byte prefix of each; positions are code points."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = "", starts: list[int] | None = None, last: list[array] | None = None):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.starts, self.last = "", [], []
        if starts is None:
            self.append(text)
        else:
            self.text, self.starts, self.last = text, list(starts), list(last)

    def ids(self) -> list[int]:
        pieces = zip(spans(self.text, self.starts), self.last, strict=True)
        return list(itertools.chain.from_iterable(self.vocabulary.read_off(self.text[a:b].encode(), x) for (a, b), x in pieces))

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, at: int, end: int, new: str) -> int:
        """Put `new` in the place of text[at:end]; how many last tokens had to be found."""
        old, starts = self.text, self.starts
        at = min(max(at, 0), len(old))
        end = min(max(end, at), len(old))
        text = old[:at] + new + old[end:]
        shift, fresh = len(text) - len(old), at + len(new)
        ends = [e for _, e in spans(old, starts)]
        keep = bisect_right(ends, at - 2)  # a match has looked at one character beyond its end and the one after at most
        rest, cut = len(starts), []
        for m in self.pattern.finditer(text, ends[keep - 1] if keep else 0):
            s = m.start()
            if s >= fresh and (k := bisect_left(starts, s - shift)) < len(starts) and starts[k] == s - shift:
                rest = k  # from here on the same text is cut from the same place
                break
            cut.append((s, m.end()))
        found, last = 0, []
        for s, e in cut:
            known = tail = None
            same = 0
            k = bisect_left(starts, s)
            if s <= at and k < len(starts) and starts[k] == s:
                known = self.last[k][: len(text[s : min(at, ends[k], e)].encode())]
            k = bisect_left(ends, e - shift)
            if e >= fresh and k < len(ends) and ends[k] == e - shift:
                tail, same = self.last[k], len(text[max(s, fresh, starts[k] + shift) : e].encode())
            x, n = self.vocabulary.last_tokens(text[s:e].encode(), known, tail, same)
            last.append(x)
            found += n
        self.text = text
        self.starts = [*starts[:keep], *(s for s, _ in cut), *(s + shift for s in starts[rest:])]
        self.last = [*self.last[:keep], *last, *self.last[rest:]]
        return found


class PrefixBPE(textnum.ByteBPE):
    """All texts of a batch at once: different pieces are encoded once and found again by their hashes."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.one, self.pattern = self.vocabulary.encode_piece, regex.compile(pattern)
        self.table = textnum.PieceTable()
        self._reset()

    def _pieces(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        starts = super()._pieces(raw, off)
        odd = np.flatnonzero(self._odd(raw, off))
        if not len(odd):
            return starts
        mine = np.zeros(len(off), bool)
        mine[odd] = True
        parts = [starts[~mine[np.searchsorted(off, starts, "right") - 1]]]
        for i in odd:
            data = raw[off[i] : off[i + 1]]
            place = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
            parts.append(off[i] + place[[m.start() for m in self.pattern.finditer(data.tobytes().decode())]])
        return np.sort(np.concatenate(parts))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by text)."""
        return self._plain(raw, off)


class TokenBytes:
    """The bytes of all tokens in one array."""

    def __init__(self, path: str):
        tokens = {i: t for t, i in read_ranks(path).items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.size = np.array([len(x) for x in parts], np.int64)
        self.bytes, self.at = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bounds by text)."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        size = self.size[ids]
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.bytes[textnum.ranges(self.at[ids], size)], total[bounds]


_kept: dict[tuple[str, str], PrefixBPE] = {}


def prefix_bpe(path: str, pattern: str) -> PrefixBPE:
    """One a worker process."""
    if (path, pattern) not in _kept:
        _kept[path, pattern] = PrefixBPE(path, pattern)
    return _kept[path, pattern]


_bytes: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    if path not in _bytes:
        _bytes[path] = TokenBytes(path)
    return _bytes[path]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(path, pattern)
        for b in batches:
            for i, j, raw, off in textnum.text_slices(b.column(1)):
                ids, bounds = bpe.encode(raw, off)
                found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([b.column(0).slice(i, j - i), found], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded): the bytes of the ids, which are UTF-8 where they come from a whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for b in batches:
            lists = b.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            step = 0
            while step < len(lists):  # about a slice of ids at a time
                end = max(step + 1, int(np.searchsorted(off, off[step] + textnum.SLICE_BYTES, "right")) - 1)
                data, at = tokens.decode(ids[off[step] - off[0] : off[end] - off[0]], off[step : end + 1] - off[step])
                out = pa.Array.from_buffers(pa.large_binary(), end - step, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.record_batch([b.column(0).slice(step, end - step), lists.slice(step, end - step), out], schema=schema)
                step = end

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


_STORED = "doc_id long, text string, starts array<int>, last array<int>"
_STORED_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("starts", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])


def _flat(p: Prefixes) -> tuple[str, list[int], list[int]]:
    return p.text, p.starts, list(itertools.chain.from_iterable(p.last))


def _kept_prefixes(bpe: PrefixBPE, text: str, starts: list[int], last: list[int]) -> Prefixes:
    size = [len(text[a:b].encode()) for a, b in spans(text, starts)]
    ends = list(itertools.accumulate(size))
    return Prefixes(bpe.vocabulary, bpe.pattern.pattern, text, starts, [array("I", last[e - n : e]) for e, n in zip(ends, size, strict=True)])


def prefixes(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, starts, last): texts with the starts of their pieces and the last token of every byte prefix, for later edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(path, pattern)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.record_batch([[x] for x in (doc, *_flat(Prefixes(bpe.vocabulary, pattern, text or "")))], schema=_STORED_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _STORED)


def edited(stored: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """`prefixes` after edits (doc_id, seq, at, end, new), those of a document in the order of seq, each on the text so far.

    A null `at` appends, a null `end` replaces nothing, a null `new` deletes; places beyond the text are its end. Documents without edits go through as they are; edits of documents
    that aren't there do nothing. All rows of a doc_id get its edits.
    """
    steps = edits.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "end", "new"))).alias("_edits"))
    joined = stored.select("doc_id", "text", "starts", "last").join(steps, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(path, pattern)
        for b in batches:
            for r in b.to_pylist():
                p = _kept_prefixes(bpe, r["text"], r["starts"], r["last"])
                for e in r["_edits"]:
                    at = len(p.text) if e["at"] is None else e["at"]
                    p.edit(at, at if e["end"] is None else e["end"], e["new"] or "")
                yield pa.record_batch([[x] for x in (r["doc_id"], *_flat(p))], schema=_STORED_ARROW)

    return joined.where("_edits is null").drop("_edits").unionByName(joined.where("_edits is not null").mapInArrow(run, _STORED))


def read_ids(stored: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of stored prefixes, read off without encoding anything."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(path, pattern)
        for b in batches:
            rows = b.to_pylist()
            yield pa.record_batch([[r["doc_id"] for r in rows], [_kept_prefixes(bpe, r["text"], r["starts"], r["last"]).ids() for r in rows]], schema=schema)

    return stored.select("doc_id", "text", "starts", "last").mapInArrow(run, "doc_id long, ids array<int>")
