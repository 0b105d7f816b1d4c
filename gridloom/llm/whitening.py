"""Whitening of embeddings by a tiled covariance.

Entries become whole numbers x = floor(scale * c) + shift. One pass sums them by dimension. The second cuts the rows of each task
into row blocks and those into column blocks, less the whole number next to the mean. A tile key is a pair of column
blocks; each row block's column blocks are shuffled to the tile keys that need them, the two are multiplied, products are summed per tile.
The assembled matrix, dimensions squared, is all that the driver gets; from it come the components.

Products and sums of what is left after centring are whole numbers in doubles, so they are exact and the same in any order
while they stay below 2**53; the small rest of the mean is taken off with whole numbers too.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; vectors of different
lengths are different fit lists, each whitened by itself; an empty vector has no components and gives no rows; null ids and repeated rows are
rows like others; an x beyond +-2**62 becomes that end, a deviation beyond a long its largest value; a component without
variance is 0 in all rows (and shows as an identity error of 1); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import topk

_END = 1 << 62
_LONG = np.iinfo(np.int64)


def whole_numbers(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    x = np.floor(c * float(scale))
    # a double of 2**62 and a shift would leave the longs
    return np.clip(np.clip(x, -float(_END), float(_END)).astype(np.int64), -_END + abs(shift), _END - abs(shift)) + shift


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of the columns as whole numbers of any size."""
    if int(np.abs(x).max(initial=0)) * max(len(x), 1) < _END:
        return [int(v) for v in x.sum(axis=0)]
    return [int(v) for v in x.astype(object).sum(axis=0)]


def blocks(batches: Iterator[pa.RecordBatch], rows: int, scale: int, shift: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, ids, x) of at most `rows` vectors of one length; vectors of a task are gathered over its batches."""
    held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
    count: dict[int, int] = {}

    def out(d: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        ids, x = pa.concat_arrays([i for i, _ in held[d]]), np.concatenate([x for _, x in held[d]])
        held[d], count[d] = [], 0
        for at in range(0, len(x), rows):
            yield d, ids.slice(at, rows), x[at : at + rows]

    for b in batches:
        vec = b.column(1)
        size = vec.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            held.setdefault(int(d), []).append((b.column(0).take(pa.array(at)), whole_numbers(topk._matrix(vec, at, int(d)), scale, shift)))
            count[int(d)] = count.get(int(d), 0) + len(at)
            if count[int(d)] >= rows:
                yield from out(int(d))
    for d in held:
        if count[d]:
            yield from out(d)


def taking_part(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the fit list, null ids among them."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(x.isNotNull() & ~bad & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))


def sums(data: DataFrame, rows: int, scale: int, shift: int) -> dict[int, tuple[int, list[int]]]:
    """For each length the number of vectors and the sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for d, _, x in blocks(batches, rows, scale, shift):
            total[d] = [a + b for a, b in zip(total.get(d, [0] * (d + 1)), [len(x), *exact_sum(x)], strict=True)]
        for d, found in total.items():
            yield pa.record_batch([pa.array([d] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([str(v) for v in found])], names=["d", "at", "s"])

    parts = data.mapInArrow(run, "d int, at int, s string").groupBy("d", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, list[int]] = {}
    for d, at, s in sorted((r.d, r.at, int(r.s)) for r in parts.collect()):  # a row a dimension
        out.setdefault(d, []).append(s)
    return {d: (s[0], s[1:]) for d, s in out.items()}


def near_means(found: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    return {d: np.array([(2 * v + n) // (2 * n) for v in s], np.int64) for d, (n, s) in found.items()}


def products(data: DataFrame, centre: dict[int, np.ndarray], rows: int, tile: int, scale: int, shift: int) -> DataFrame:
    """(d, i, j, at, s): sums over all vectors of the products of the centred entries, `at` within the tile of column blocks i <= j."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, (d, _, x) in enumerate(blocks(batches, rows, scale, shift)):
            y = (x - centre[d]).astype("<f8")
            parts = [np.ascontiguousarray(y[:, at : at + tile]).tobytes() for at in range(0, d, tile)]
            n = len(parts)
            yield pa.record_batch([pa.array([task + k] * n), pa.array([d] * n, pa.int32()), pa.array([len(x)] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(parts, pa.large_binary())], names=["row_block", "d", "n", "block", "cells"])

    last = F.ceil(F.col("d") / tile).cast("int") - 1
    partner = F.explode(F.sequence(F.lit(0), last))
    pairs = data.mapInArrow(cut, "row_block long, d int, n int, block int, cells binary").withColumn("_o", partner).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")}).drop("_o")

    def multiply(key: tuple, group: pa.Table) -> pa.Table:
        n, cells = group.column("n")[0].as_py(), {k: np.frombuffer(c, "<f8") for k, c in zip(group.column("block").to_pylist(), group.column("cells").to_pylist(), strict=True)}
        a, b = (cells[key[c].as_py()].reshape(n, -1) for c in (2, 3))
        return pa.table({"d": pa.array([key[1].as_py()], pa.int32()), "i": pa.array([key[2].as_py()], pa.int32()), "j": pa.array([key[3].as_py()], pa.int32()), "cells": pa.array([(a.T @ b).tobytes()], pa.binary())})

    tiles = pairs.groupBy("row_block", "d", "i", "j").applyInArrow(multiply, "d int, i int, j int, cells binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One tile a key and task."""
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for d, i, j, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one = np.frombuffer(cells, "<f8")
                total[d, i, j] = total[d, i, j] + one if (d, i, j) in total else one
        for (d, i, j), s in total.items():
            ints = (pa.array(np.full(len(s), v), pa.int32()) for v in (d, i, j))
            yield pa.record_batch([*ints, pa.array(np.arange(len(s)), pa.int32()), pa.array(s)], names=["d", "i", "j", "at", "s"])

    return tiles.mapInArrow(add, "d int, i int, j int, at int, s double").groupBy("d", "i", "j", "at").agg(F.sum("s").alias("s"))


def covariances(data: DataFrame, found: dict[int, tuple[int, list[int]]], rows: int, tile: int, scale: int, shift: int) -> dict[int, np.ndarray]:
    centre = near_means(found)
    total = {d: np.zeros((d, d)) for d in found}
    for d, i, j, at, s in products(data, centre, rows, tile, scale, shift).collect():  # dimensions squared
        width = min(tile, d - j * tile)
        r, c = i * tile + at // width, j * tile + at % width
        total[d][r, c] = total[d][c, r] = s
    for d, (n, s) in found.items():
        rest = [int(v) - n * int(m) for v, m in zip(s, centre[d].tolist(), strict=True)]  # at most n / 2 each
        small = np.array([r / n for r in rest])
        total[d] = total[d] / n - np.outer(small, small)
    return total


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest on, unit eigenvectors as columns), at most `most`."""
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    return np.maximum(e[order], 0.0), u[:, order]


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """sum((n x - s)**2) of each row, exact, or the largest long."""
    m = near_means({1: (n, s)})[1]
    rest = [int(v) - n * int(c) for v, c in zip(s, m.tolist(), strict=True)]
    most = int(np.abs(x - m).max(initial=0)) * n + max(map(abs, rest), default=0)
    if most * most * max(x.shape[1], 1) <= _LONG.max:
        return (((x - m) * n - np.array(rest, np.int64)) ** 2).sum(axis=1)
    exact = (((x.astype(object) - m.astype(object)) * n - np.array(rest, object)) ** 2).sum(axis=1)
    return np.array([min(v, _LONG.max) for v in exact], np.int64)


class Whitener:
    """What a task needs to whiten vectors of one length."""

    def __init__(self, n: int, s: list[int], v: np.ndarray, most: int):
        self.n, self.s = n, s
        self.centre = near_means({1: (n, s)})[1]
        self.small = np.array([(int(a) - n * int(m)) / n for a, m in zip(s, self.centre.tolist(), strict=True)])
        e, u = components(v, most)
        trace = float(np.trace(v))
        self.explained = e / trace if trace > 0 else np.zeros(len(e))
        alive = e > 1e-12 * max(trace, 1e-300)
        self.turn = np.where(alive, u / np.sqrt(np.where(alive, e, 1.0)), 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.small) @ self.turn


def identity_errors(data: DataFrame, shared, rows: int, scale: int, shift: int) -> dict[int, float]:
    """The largest absolute entry of the covariance of the whitened rows, less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, _, x in blocks(batches, rows, scale, shift):
            w = shared.value[d].project(x)
            one = np.vstack([w.T @ w, w.sum(axis=0)])
            total[d] = total[d] + one if d in total else one
        for d, s in total.items():
            yield pa.record_batch([pa.array(np.full(s.size, d), pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(s.ravel())], names=["d", "at", "s"])

    out: dict[int, dict[int, float]] = {}
    for d, at, s in data.mapInArrow(run, "d int, at int, s double").groupBy("d", "at").agg(F.sum("s")).collect():  # components squared
        out.setdefault(d, {})[at] = s
    errors = {}
    for d, found in out.items():
        k = shared.value[d].turn.shape[1]
        full = np.array([found[i] for i in range(len(found))]).reshape(k + 1, k) / shared.value[d].n
        errors[d] = float(np.abs(full[:k] - np.outer(full[k], full[k]) - np.eye(k)).max())
    return errors


def whiten(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shift: int = 100_000, rows: int = 4096, tile: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of the fit list and each of its first `most` components."""
    data = taking_part(vectors, id_col, vec_col)
    found = sums(data, rows, scale, shift)
    cov = covariances(data, found, rows, tile, scale, shift)
    shared = data.sparkSession.sparkContext.broadcast({d: Whitener(*found[d], cov[d], most) for d in found})  # a vector a component
    errors = identity_errors(data, shared, rows, scale, shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, ids, x in blocks(batches, rows, scale, shift):
            white = shared.value[d]
            w, far = white.project(x), deviations(x, white.n, white.s)
            m, k = w.shape
            again = np.repeat(np.arange(m), k)
            cols = [ids.take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, white.n, np.int64)), pa.array(far[again]), pa.array(w.ravel()), pa.array(np.tile(white.explained, m)), pa.array(np.full(m * k, errors[d]))]
            yield pa.record_batch(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = data.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("vec_id", id_col)

