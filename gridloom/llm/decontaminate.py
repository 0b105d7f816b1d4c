"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of the training texts.

Items are the indexed documents, passages (windows of words, half overlapping, long enough for any item of the wave)
the queries. The score of an item is its BM25 score for the words of the passage, divided by its score for its own
words, so one threshold serves all items and a passage that holds the item scores 1. Number, mean length and word
frequencies are those of all items, counted once.

Postings are in blocks of items, in block-max WAND's manner. As all above a fixed threshold is asked for, the pivot is
fixed too: an item that reaches it must share one of its weightiest words, those that hold just over 1 - threshold of
its weight. Only (passage, block) pairs with such a word are looked at; those whose block maxima add up to less than
the threshold are passed over; the others are scored item by item. So nothing at or above the threshold is missed, and
what is kept of the index is as large as its postings. Retrieved pairs are verified: enough of the question's and of the
answer's word runs must stand in the passage.

Items go through in waves of at most `wave_words` words, by length class (a power of two of words, 64 at least, which is
half the passage); waves bound memory alone, no result depends on them. Each wave is one pass over the texts. Defined
results: null and empty texts and items have no passages and match nothing; a part of fewer words than `run` is matched as
one run; repeated items and documents each give their rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common, textnum

SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
_SQL_SCHEMA = "doc_id long, item_id long, start long, score double, question_overlap double, answer_overlap double"
K1, B = 1.2, 0.75


def _runs(h: np.ndarray, run: int) -> np.ndarray:
    """Hashes of the different runs of so many words."""
    return np.unique(textnum.shingles(h, np.array([0, len(h)]), run)[0])


class Index:
    """Inverted index over word hashes, with block maxima.

    `questions` and `answers` are word hashes; `frequency` maps the different words of these items, sorted, to the number of
    items that hold them among all `n`, whose mean length is `mean`.
    """

    def __init__(self, ids: list[int], questions: list[np.ndarray], answers: list[np.ndarray], frequency: tuple[np.ndarray, np.ndarray], n: int, mean: float, theta: float, block: int = 4, run: int = 4):
        full = [np.concatenate(x) for x in zip(questions, answers, strict=True)]
        self.ids, self.theta, self.block = np.array(ids, np.int64), theta, block
        # a part of fewer words than a run is one run of all its words
        self.questions, self.answers = ([(size := min(run, len(x)), _runs(x, max(size, 1))) for x in part] for part in (questions, answers))
        self.vocabulary, df = frequency
        terms = [np.unique(x, return_counts=True) for x in full]
        item = np.repeat(np.arange(len(ids)), [len(t) for t, _ in terms])
        term = np.searchsorted(self.vocabulary, np.concatenate([t for t, _ in terms]))
        tf = np.concatenate([c for _, c in terms]).astype(float)
        length = np.array([len(x) for x in full], float)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)[item])
        w /= np.bincount(item, w, len(ids))[item]
        # the weightiest words of each item, as many as hold more than 1 - theta of its weight
        order = np.lexsort((-w, item))
        upto = np.cumsum(w[order])
        start = np.searchsorted(item[order], item[order])
        pivot = order[upto - w[order] - np.append(0, upto)[start] <= 1 - theta + 1e-9]
        self.blocks = -(-len(ids) // block)
        lead = np.unique(term[pivot] * self.blocks + item[pivot] // block)
        self.lead = lead % max(self.blocks, 1)
        self.lead_at = np.searchsorted(lead // max(self.blocks, 1), np.arange(len(self.vocabulary) + 1))
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], w[order]
        cells = term[order] * self.blocks + self.item // block
        self.cells, first = np.unique(cells, return_index=True)
        self.cell_at = np.append(first, len(cells))
        self.peak = np.maximum.reduceat(self.weight, first) if len(cells) else self.weight
        self.half = 64
        while len(length) and self.half < length.max():
            self.half *= 2
        bits = max(8, int(np.ceil(np.log2(len(self.vocabulary) + 1))) + 4)
        self.shift = np.uint64(64 - bits)
        slot = (self.vocabulary >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << bits) + 1)).astype(np.int32)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words that are in the vocabulary, their terms): sorted hashes, reached by their leading bits."""
        slot = (h >> self.shift).astype(np.int64)
        lo, hi = self.first[slot], self.first[slot + 1]
        at = np.flatnonzero(hi > lo)
        pos, term = [], []
        lo, hi, key = lo[at], hi[at], h[at]
        while len(at):
            hit = self.vocabulary[lo] == key
            pos.append(at[hit])
            term.append(lo[hit])
            lo = lo + 1
            more = ~hit & (lo < hi)
            at, lo, hi, key = at[more], lo[more], hi[more], key[more]
        if not pos:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, term = np.concatenate(pos), np.concatenate(term).astype(np.int64)
        order = np.argsort(pos, kind="stable")
        return pos[order], term[order]

    def search(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, end word, item, score) of every passage and item at theta or above."""
        pos, term = self.look_up(h)
        if not len(pos):
            return
        doc = np.searchsorted(bounds, pos, "right") - 1
        halves = np.maximum(-(-np.diff(bounds) // self.half), 1)
        base = np.append(0, np.cumsum(halves))
        n = len(self.vocabulary)
        both = textnum.different((base[doc] + (pos - bounds[doc]) // self.half) * n + term)  # each word once a half window
        at, term = both // n, both % n
        # pivot words call up their blocks, in the passage that begins with their half and in the one before
        size = self.lead_at[term + 1] - self.lead_at[term]
        half, block = np.repeat(at, size), self.lead[textnum.ranges(self.lead_at[term], size)]
        follows = np.ones(base[-1] + 1, bool)
        follows[base[:-1]] = False  # the first half of a text
        ends = ~follows[half + 1]  # the last half of a text begins no passage unless it is the only one
        only = ends & ~follows[half]
        pairs = textnum.different(np.concatenate([half[~ends | only] * self.blocks + block[~ends | only], (half[follows[half]] - 1) * self.blocks + block[follows[half]]]))
        token = np.searchsorted(at, np.arange(base[-1] + 2))
        for lo in range(0, len(pairs), 4096):
            yield from self._evaluate(pairs[lo : lo + 4096], token, follows, term, bounds, base)

    def _evaluate(self, pairs: np.ndarray, token: np.ndarray, follows: np.ndarray, term: np.ndarray, bounds: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        window, k = pairs // self.blocks, pairs % self.blocks
        lo, hi = token[window], token[window + 1 + follows[np.minimum(window + 1, len(follows) - 1)]]
        pick = np.repeat(np.arange(len(pairs)), hi - lo)
        cell = term[textnum.ranges(lo, hi - lo)] * self.blocks + k[pick]
        place = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        hit = self.cells[place] == cell
        # a word in both halves of a passage counts once
        key = textnum.different(pick[hit] * len(self.cells) + place[hit])
        pick, place = key // len(self.cells), key % len(self.cells)
        reach = np.bincount(pick, self.peak[place], len(pairs)) >= self.theta - 1e-9
        pick, place = pick[reach[pick]], place[reach[pick]]
        count = self.cell_at[place + 1] - self.cell_at[place]
        spans = textnum.ranges(self.cell_at[place], count)
        score = np.bincount(np.repeat(pick, count) * self.block + self.item[spans] % self.block, self.weight[spans], len(pairs) * self.block)
        for x in np.flatnonzero(score >= self.theta):
            c, i = divmod(int(x), self.block)
            d = int(np.searchsorted(base, window[c], "right")) - 1
            start = int(bounds[d] + (window[c] - base[d]) * self.half)
            yield d, start, int(min(start + 2 * self.half, bounds[d + 1])), int(k[c]) * self.block + i, float(score[x])

    def verify(self, h: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's runs in the passage (1 for a part without words)."""
        return tuple(float(np.isin(runs, _runs(h, size)).mean()) if size else 1.0 for size, runs in (self.questions[item], self.answers[item]))


def item_words(items: DataFrame) -> DataFrame:
    """(id, q, a): items (id, q, a as texts) with the hashes of their words; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for c in (1, 2):
                found = [textnum.words(raw, off) for _, _, raw, off in textnum.text_slices(b.column(c), 1 << 40)]
                h, bounds = (found[0][2], found[0][3]) if found else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
                parts.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64))))
            yield pa.record_batch([b.column(0), *parts], names=["id", "q", "a"])

    return items.select("id", "q", "a").mapInArrow(run, "id long, q array<long>, a array<long>").where("size(q) + size(a) > 0")


def contaminated(docs: DataFrame, items: DataFrame, theta: float = 0.6, question_share: float = 0.5, answer_share: float = 0.5, wave_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(doc_id, item_id, start, score, question_overlap, answer_overlap): the best passage of every document and item at or above all thresholds."""
    spark = docs.sparkSession
    clean = item_words(items.select(F.col(item_id).cast("long").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a")))
    size = F.size("q") + F.size("a")
    clean = common.durable(clean.withColumns({"n": size, "class": F.greatest(F.lit(6), F.ceil(F.log2(size))).cast("int")}))
    every = clean.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    df = common.durable(clean.select(F.explode(F.array_distinct(F.concat("q", "a"))).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found: DataFrame | None = None
    for kind, total in sorted((r[0], r[1]) for r in clean.groupBy("class").agg(F.sum("n")).collect()):
        waves = -(-total // wave_words)
        for w in range(waves):
            # items that share words stand together, which makes block maxima tight
            wave = clean.where((F.col("class") == kind) & (F.pmod(F.xxhash64("id", "q"), F.lit(waves)) == w)).orderBy("q", "a", "id")
            words = wave.select(F.explode(F.concat("q", "a")).alias("word")).distinct().join(df, "word").toArrow()
            word = words.column("word").to_numpy().view(np.uint64)
            order = np.argsort(word)
            rows = wave.select("id", "q", "a").toArrow()
            if not rows.num_rows:
                continue
            parts = [np.split(pc.list_flatten(c := rows.column(x).combine_chunks()).to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))[:-1]) for x in ("q", "a")]
            shared = spark.sparkContext.broadcast(Index(rows.column("id").to_pylist(), *parts, (word[order], words.column("df").to_numpy()[order].astype(float)), every["n"], every["mean"], theta))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                index = shared.value
                for b in batches:
                    ids = b.column(0).to_pylist()
                    best: dict[tuple[int, int], tuple] = {}
                    for i, _, raw, off in textnum.text_slices(b.column(1)):
                        _, _, h, bounds = textnum.words(raw, off)
                        for d, first, end, item, score in index.search(h, bounds):
                            q, a = index.verify(h[first:end], item)
                            if q >= question_share and a >= answer_share:
                                key, row = (i + d, item), (round(score, 9), q, a, -(first - int(bounds[d])))
                                if key not in best or row > best[key]:
                                    best[key] = row
                    rows = [(ids[d], int(index.ids[item]), -s, score, q, a) for (d, item), (score, q, a, s) in best.items()]
                    yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, SCHEMA, strict=True)], schema=SCHEMA)

            part = slim.mapInArrow(run, _SQL_SCHEMA)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], _SQL_SCHEMA) if found is None else found


def split_item(text_col: str = "text", share: float = 0.7):
    """(question, answer) columns of items that are one text: the first 70 % of the words and the rest."""
    words = F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"\s+")
    n = F.ceil(F.size(words) * share).cast("int")
    return F.array_join(F.slice(words, 1, n), " "), F.array_join(F.slice(words, n + 1, F.greatest(F.size(words), F.lit(1))), " ")
