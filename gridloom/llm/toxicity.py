"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; the model of each also sees the probabilities of the earlier categories,
which in training are out-of-fold predictions. Inputs are indicators of words, and of their first four to eight bytes. A
category's model takes all that reach a chi-squared of `min_chi2` for it over the training rows, however many, and in at
least `min_docs` of them, so that the words of one category never push out those of another. The fits are sparse.

The models are fitted on at most `sample` labelled rows (the smallest hashes of the id), the one bounded part: their texts
are written once to the shared folder and every training step reads that table. All documents are scored, over whole texts.

Defined results: a null or empty text has no word and gets what its missing words give; each category is fitted on the
rows that have its label, so a null label of one category leaves the others alone, and a category without labels has
probability 0; several labels of a document are averaged; of several texts of one labelled id the one of the least hash trains;
repeated rows are scored alike, and equal texts count once in training, with their mean label; labels without a document are
ignored; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common, textnum

MOST_STEPS = 60


def _over_texts(docs: DataFrame, carried: Sequence[str], schema: str, make) -> DataFrame:
    """make(list of one set of word hashes a text, the carried columns) -> the columns of `schema`, for some texts at a time."""
    n = len(carried)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rows, size = [], [], 0
        for b in batches:
            for i, j, raw, off in textnum.text_slices(b.column(n)):
                h, bounds = textnum.words_and_stems(raw, off)
                sets += [textnum.different(h[bounds[k] : bounds[k + 1]]) for k in range(j - i)]
                rows.append([b.column(k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in range(n)])
                size += len(h)
                if size > 1 << 22:
                    yield pa.record_batch(make(sets, [np.concatenate(c) for c in zip(*rows, strict=True)]), names=names)
                    sets, rows, size = [], [], 0
        if sets:
            yield pa.record_batch(make(sets, [np.concatenate(c) for c in zip(*rows, strict=True)]), names=names)

    return docs.select(*carried, "_text").mapInArrow(run, schema)


class Sparse:
    """A 0/1 matrix by rows, of any width, with dense columns at its end."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, width: int, dense: np.ndarray | None = None):
        self.row, self.column, self.rows, self.width = row.astype(np.int32), column.astype(np.int32), rows, width
        self.dense = np.zeros((rows, 0)) if dense is None else dense
        self.by_column: tuple | None = None

    @staticmethod
    def _sums(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Sums of x by its ascending owner."""
        out = np.zeros(n)
        if len(x):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] = np.add.reduceat(x, first)
        return out

    def times(self, beta: np.ndarray) -> np.ndarray:
        return self._sums(beta[self.column], self.row, self.rows) + self.dense @ beta[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed matrix times r."""
        if self.by_column is None:
            order = np.argsort(self.column, kind="stable")
            self.by_column = self.row[order], self.column[order]
        row, column = self.by_column
        return np.concatenate([self._sums(r[row], column, self.width), self.dense.T @ r])

    def rows_of(self, keep: np.ndarray) -> Sparse:
        place, at = np.cumsum(keep) - 1, keep[self.row]
        return Sparse(place[self.row[at]], self.column[at], int(keep.sum()), self.width, self.dense[keep])

    def columns_of(self, keep: np.ndarray) -> Sparse:
        place, at = np.cumsum(keep) - 1, keep[self.column]
        return Sparse(self.row[at], place[self.column[at]], self.rows, int(keep.sum()), self.dense)

    def beside(self, more: np.ndarray) -> Sparse:
        out = Sparse(self.row, self.column, self.rows, self.width, np.concatenate([self.dense, more[:, None]], axis=1))
        out.by_column = self.by_column
        return out


def logistic(x: Sparse, y: np.ndarray, ridge: float = 0.3, steps: int = MOST_STEPS, memory: int = 8) -> np.ndarray:
    """Ridge logistic regression by limited-memory quasi-Newton steps; the last coefficient is the free intercept. y may be shares."""
    z = x.beside(np.ones(x.rows))
    pull = np.full(z.width + z.dense.shape[1], ridge)
    pull[-1] = 1e-4
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    beta = np.zeros(len(pull))
    beta[-1] = np.log(share / (1 - share))

    def value(beta: np.ndarray) -> tuple[float, np.ndarray]:
        t = z.times(beta)
        slope = z.back(1 / (1 + np.exp(-np.clip(t, -30, 30))) - y) + pull * beta
        return float((np.logaddexp(0, t) - y * t).sum() + (pull * beta * beta).sum() / 2), slope

    # curvature of each coefficient alone, with which every direction starts
    scale = 1 / (z.back(np.full(x.rows, max(share * (1 - share), 1e-3))) + pull)
    now, slope = value(beta)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, used = slope.copy(), []
        for s, g, rho in reversed(pairs):
            a = rho * (s @ way)
            way -= a * g
            used.append(a)
        way *= scale
        for (s, g, rho), a in zip(pairs, reversed(used), strict=True):
            way += (a - rho * (g @ way)) * s
        gain, part = slope @ way, 1.0
        while True:
            then, new = value(beta - part * way)
            if then <= now - 1e-4 * part * gain or part < 1e-6:
                break
            part /= 2
        step, turn = -part * way, new - slope
        if step @ turn > 1e-12:
            pairs = [*pairs[1 - memory :], (step, turn, 1 / (step @ turn))]
        beta, slope, before, now = beta + step, new, now, then
        if before - now < 1e-5 * (1 + abs(now)):
            break
    return beta


def predict(x: Sparse, beta: np.ndarray) -> np.ndarray:
    """Probabilities."""
    return 1 / (1 + np.exp(-np.clip(x.times(beta[:-1]) + beta[-1], -30, 30)))


def fit_chain(x: Sparse, y: np.ndarray, own: np.ndarray, folds: int = 4) -> list[np.ndarray | None]:
    """One coefficient vector a category (None without labels). y: labels, NaN for none; own: which columns each category takes.

    The inputs of the later categories end with the earlier ones' out-of-fold probabilities; a row without the label is
    foreign to every fit, so the model of all labelled rows serves it.
    """
    fold, chain, earlier = np.arange(x.rows) % folds, [], np.zeros((x.rows, 0))
    for k in range(y.shape[1]):
        known = ~np.isnan(y[:, k])
        if not known.any():
            chain.append(None)
            earlier = np.concatenate([earlier, np.zeros((x.rows, 1))], axis=1)
            continue
        seen = x.columns_of(own[k])
        seen.dense = earlier
        whole = logistic(seen.rows_of(known), y[known, k])
        beta = np.zeros(x.width + len(whole) - seen.width)
        beta[np.append(np.flatnonzero(own[k]), np.arange(x.width, len(beta)))] = whole
        chain.append(beta)
        out = predict(seen, whole)
        for f in range(folds):
            rest, held = known & (fold != f), known & (fold == f)
            if rest.any() and held.any():
                out[held] = predict(seen.rows_of(held), logistic(seen.rows_of(rest), y[rest, k]))
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return chain


def apply_chain(x: Sparse, chain: list[np.ndarray | None]) -> np.ndarray:
    for beta in chain:
        x = x.beside(predict(x, beta) if beta is not None else np.zeros(x.rows))
    return x.dense


def _places(h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where h holds words of the sorted vocabulary, and which."""
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == h)
    return hit, at[hit]


def _indicators(h: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray) -> Sparse:
    hit, at = _places(h, vocabulary)
    width = max(len(vocabulary), 1)
    cell = textnum.different((np.searchsorted(bounds, hit, "right") - 1) * width + at)
    return Sparse(cell // width, cell % width, len(bounds) - 1, len(vocabulary))


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = 20_000, min_chi2: float = 30.0, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>...) of every document; `categories` maps names, in the order of the chain, to 0/1 columns over `labels`."""
    spark, names = docs.sparkSession, list(categories)
    ys = [f"_y{k}" for k in range(len(names))]
    marks = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *(c.cast("double").alias(y) for y, c in zip(ys, categories.values(), strict=True)))
    marks = marks.groupBy("_id").agg(*(F.avg(y).alias(y) for y in ys)).where(F.coalesce(*ys).isNotNull())
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    slim = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))
    kind = dict(slim.dtypes)["_id"]
    # at most `sample` rows go out to meet the texts, which are written once; equal texts become one row with their mean label
    one = F.min(F.struct(F.xxhash64("_text").alias("_h"), F.length("_text").alias("_n"), "_text"))
    texts = slim.join(F.broadcast(marks), "_id").groupBy("_id").agg(one.alias("_t"), *(F.first(y).alias(y) for y in ys))
    texts = texts.groupBy("_t._h", "_t._n").agg(F.first("_t._text").alias("_text"), *(F.avg(y).alias(y) for y in ys))
    texts = common.written(texts.select("_h", "_text", *ys), "toxicity")

    def counted(sets: list[np.ndarray], c: list[np.ndarray]) -> list[pa.Array]:
        word, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        some = [np.bincount(at, (~np.isnan(y))[owner], len(word)) for y in c]
        return [pa.array(word.view(np.int64)), *(pa.array(x) for x in some), *(pa.array(np.bincount(at, np.nan_to_num(y)[owner], len(word))) for y in c)]

    # of each category: rows with its label, and the sum of the labels
    total = texts.agg(*(F.count(y).alias(f"n{k}") for k, y in enumerate(ys)), *(F.coalesce(F.sum(y), F.lit(0.0)).alias(y) for y in ys)).first()
    ns = [f"_n{k}" for k in range(len(names))]
    partial = _over_texts(texts, ys, "word long" + "".join(f", {c} double" for c in [*ns, *ys]), counted)
    by_word = partial.groupBy("word").agg(*(F.sum(c).alias(c) for c in [*ns, *ys]))
    goes = []
    for k, (y, n) in enumerate(zip(ys, ns, strict=True)):
        rows, positive = total[f"n{k}"], total[y]
        expected = F.col(n) * F.lit(positive / max(rows, 1))
        spread = expected * F.lit(1 - positive / max(rows, 1)) * F.greatest(F.lit(1) - F.col(n) / F.lit(max(rows, 1)), F.lit(1e-3))
        chi2 = F.when(spread > 0, (F.col(y) - expected) * (F.col(y) - expected) / spread).otherwise(0.0)
        goes.append(((chi2 >= min_chi2) & (F.col(n) >= min_docs)).alias(f"_g{k}"))
    best = by_word.select("word", *goes).where(" or ".join(f"_g{k}" for k in range(len(names)))).toArrow()
    word = best.column("word").to_numpy().view(np.uint64) if best.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(word)
    vocabulary, own = word[order], np.array([best.column(f"_g{k}").to_numpy()[order].astype(bool) for k in range(len(names))]).reshape(len(names), len(word))

    def indicated(sets: list[np.ndarray], c: list[np.ndarray]) -> list[pa.Array]:
        places = [_places(x, vocabulary)[1].astype(np.int32) for x in sets]
        return [pa.array(c[0], pa.int64()), pa.array(places, pa.list_(pa.int32())), *(pa.array(y) for y in c[1:])]

    train = _over_texts(texts, ["_h", *ys], "_h long, words array<int>" + "".join(f", {y} double" for y in ys), indicated).toArrow()
    chain: list[np.ndarray | None] = [None] * len(names)
    if train.num_rows:
        order = np.argsort(train.column("_h").to_numpy(), kind="stable")
        words = train.column("words").combine_chunks().take(pa.array(order))
        row = np.repeat(np.arange(train.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        x = Sparse(row, pc.list_flatten(words).to_numpy(zero_copy_only=False), train.num_rows, len(vocabulary))
        chain = fit_chain(x, np.stack([train.column(y).to_numpy().astype(float)[order] for y in ys], axis=1), own)
    shared = spark.sparkContext.broadcast((vocabulary, chain))  # a few numbers a word of at most `sample` texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, chain = shared.value
        for b in batches:
            for i, j, raw, off in textnum.text_slices(b.column(1)):
                h, bounds = textnum.words_and_stems(raw, off)
                p = apply_chain(_indicators(h, bounds, vocabulary), chain)
                yield pa.record_batch([b.column(0).slice(i, j - i), *(pa.array(p[:, k]) for k in range(len(names)))], names=["_id", *(f"p_{c}" for c in names)])

    out = slim.mapInArrow(run, f"_id {kind}, " + ", ".join(f"`p_{c}` double" for c in names))
    return out.withColumnRenamed("_id", id_col)
