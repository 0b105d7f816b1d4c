"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are computed once and written to the checkpoint folder. Moments, normal equations and
the calibration histogram are sums over partitions, merged in a second level of tasks before the driver adds the last
few, so all labelled rows count at any size. Two halves of the training rows score each other for the calibration.

Defined results: a null text counts as empty, and an empty text is scored like any other; labels that are null are
ignored, several labels of a document are averaged; without any label every score is 0.5; repeated rows are scored
alike; only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common, textnum

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t", *".,;:!?'\"|#$%&*@+-=/\\<>()[]{}_~^`"]
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _k, _chars in enumerate(_GROUPS):
    _CLASS[list(_chars.encode())] = _k
_CLASS[128:] = len(_GROUPS) + 1
_N_CLASS = len(_GROUPS) + 2
DIM = _N_CLASS + 12


def _distinct(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of different hashes in each text."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    both = textnum.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    s = both[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return np.bincount(doc[order[new]], minlength=n)


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of DIM numbers for each text."""
    n, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(n), size)
    per = np.bincount(doc * _N_CLASS + _CLASS[raw], minlength=n * _N_CLASS).reshape(n, _N_CLASS).astype(float)
    starts, ends, h, bounds = textnum.words(raw, off)
    count = np.diff(bounds)
    word = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    some = np.maximum(count, 1)
    total = lambda x: np.bincount(word, x, minlength=n)
    upper = np.zeros(len(raw) + 1)
    np.cumsum((raw >= 65) & (raw <= 90), out=upper[1:])
    caps = upper[ends] - upper[starts]
    follow = np.append(raw, 32)[ends] if len(ends) else np.zeros(0)
    line = raw == 10
    cut = np.union1d(np.flatnonzero(line) + 1, off[:-1][size > 0]).astype(np.int64)
    cut = cut[cut < len(raw)]
    stop = np.append(cut[1:], len(raw)).astype(np.int64)
    lines = textnum.hash_spans(raw, cut, np.maximum(stop - (raw[stop - 1] == 10), cut)) if len(cut) else np.zeros(0, np.uint64)
    line_bounds = np.searchsorted(cut, off)
    n_lines = np.diff(line_bounds)
    mean = total(length) / some
    out = [
        np.log1p(size),
        np.log1p(count),
        mean,
        np.sqrt(np.maximum(total(length**2) / some - mean**2, 0)),
        _distinct(h, bounds) / some,
        total(caps == length) / some,
        total((length > 3) & (caps == length)) / some,
        total(length <= 2) / some,
        total(length >= 12) / some,
        total((follow != 32) & (follow != 10)) / some,
        np.log1p(n_lines),
        np.where(n_lines > 0, _distinct(lines, line_bounds) / np.maximum(n_lines, 1), 1),
    ]
    rates = np.log1p(1000 * per / np.maximum(size, 1)[:, None])
    return np.concatenate([rates, np.stack(out, axis=1)], axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: str | None = None) -> DataFrame:
    """(id, x array<double>, carried): of another column, a number, if one is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, off in textnum.text_slices(b.column(1)):
                x = statistics(raw, off)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * DIM), pa.array(x.ravel())), b.column(2).slice(i, j - i)], names=["id", "x", "carried"])

    more = (F.col(carried) if carried else F.lit(None)).cast("long").alias("carried")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), more).mapInArrow(run, "id long, x array<double>, carried long")


def _rows(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def partition_sum(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(batch) over all rows: one array a task, which merge sixteen at a time, level by level, until the driver gets one."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(b)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer())
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    left = df.rdd.getNumPartitions()
    found = df.mapInArrow(first, "sum binary")
    while left > 1:
        left = -(-left // 16)
        found = found.repartition(left).mapInArrow(merge, "sum binary")
    return sum((np.frombuffer(r[0]) for r in found.collect()), np.zeros(size))


def isotonic(positive: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: (centre bin, value) of each block."""
    blocks: list[list[float]] = []  # sum of positives, weight, sum of bin x weight
    for k in np.flatnonzero(weight):
        blocks.append([positive[k], weight[k], k * weight[k]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Everything that a score needs; a few hundred KB whatever the input."""

    def __init__(self, mean, std, seed: int, dim: int, width: float):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w = rng.standard_normal((DIM, dim)) / (width * np.sqrt(DIM))
        self.b = rng.uniform(0, 2 * np.pi, dim)
        self.beta = np.zeros(dim + 1)
        self.at, self.value = np.zeros(0), np.zeros(0)

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6) @ self.w + self.b
        return np.concatenate([np.cos(z) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)

    def bin(self, raw: np.ndarray, bins: int = 2048) -> np.ndarray:
        return np.clip((raw + 0.5) / 2 * bins, 0, bins - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.bin(self.fourier(x) @ self.beta), self.at, self.value), 0, 1)


def fit(rows: DataFrame, dim: int = 384, ridge: float = 1e-3, width: float = 0.7, seed: int = 7, bins: int = 2048) -> Model:
    """Fit on (x array<double>, y double, half int 0 or 1)."""
    moments = partition_sum(rows.select("x"), lambda b: np.concatenate([[b.num_rows], (x := _rows(b.column(0))).sum(0), (x * x).sum(0)]), 1 + 2 * DIM)
    n = max(moments[0], 1)
    mean = moments[1 : 1 + DIM] / n
    std = np.sqrt(np.maximum(moments[1 + DIM :] / n - mean**2, 0))
    model = Model(mean, np.where(std > 1e-9, std, 1), seed, dim, width)
    if not moments[0]:
        return model
    m = dim + 1

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z, y, half = model.fourier(_rows(b.column(0))), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        return np.concatenate([np.append((z[half == k].T @ z[half == k]).ravel(), [z[half == k].T @ y[half == k], np.append(np.zeros(m - 1), (half == k).sum())]) for k in (0, 1)])

    both = partition_sum(rows.select("x", "y", "half"), normal, 2 * (m * m + 2 * m)).reshape(2, -1)

    def solve(s: np.ndarray) -> np.ndarray:
        pull = np.eye(m) * ridge * max(s[-1], 1)
        pull[-1, -1] = 1e-9
        return np.linalg.solve(s[: m * m].reshape(m, m) + pull, s[m * m : m * m + m])

    other = [solve(both[1]), solve(both[0])]  # each half is scored by the model of the other

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        z, y, half = model.fourier(_rows(b.column(0))), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        at = model.bin(np.where(half == 0, z @ other[0], z @ other[1]), bins).astype(int)
        return np.concatenate([np.bincount(at, y, bins), np.bincount(at, minlength=bins)])

    h = partition_sum(rows.select("x", "y", "half"), histogram, 2 * bins)
    model.beta = solve(both.sum(0))
    model.at, model.value = isotonic(h[:bins], h[bins:])
    return model


def classify(docs: DataFrame, labels: DataFrame, learn: Column, half: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", carried: str | None = None) -> DataFrame:
    """(id, score, predicted) of every document, and the column `carried`, a number, if one is named. `learn` and `half` (0 or 1) read the column `id`: which labelled rows to learn from."""
    x = common.durable(features(docs, id_col, text_col, carried))
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("y"))
    rows = common.durable(x.where(learn).join(y, "id").select("x", "y", half.cast("int").alias("half")))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.score(_rows(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), b.column(2)], names=["id", "score", "predicted", "carried"])

    scored = x.mapInArrow(run, "id long, score double, predicted int, carried long")
    return scored.select(F.col("id").alias(id_col), "score", "predicted", *([F.col("carried").alias(carried)] if carried else []))
