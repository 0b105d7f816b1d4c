"""Exact top-k by tiled matrix products.

Vectors are turned into integers floor(scale * x). Queries form waves and vectors shards of bounded bytes. A single wave
goes out to all tasks; more of them meet every shard in tasks of their own, one for each wave and shard. A task multiplies
tiles of its shard with its wave and keeps a partial top list per query; the lists are merged in two levels, by query and
group of tasks, then by query.

Products are exact: in float64 while they stay below 2**53, in 64-bit integers below 2**63, in whole numbers of any size
beyond. Scores that a long can't hold become its nearest end and tie there.

Defined results: null vectors, null ids and vectors with null or non-finite components take no part; only vectors of the
query's length are candidates; a repeated query id is asked once (smallest vector), repeated candidate rows each count;
ties go to the smaller id; fewer than k candidates give them all; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

_LONG = np.iinfo(np.int64)


def taking_part(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))


def _matrix(column: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    return pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), d)


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python ints; a float of 2**53 or more is whole."""
    return np.array([int(np.floor(e * scale)) if abs(e) < 2.0**53 else int(e) * scale for e in x.ravel()], object).reshape(x.shape)


def products(q: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Exact inner products of the quantised rows of q and x, as longs."""
    d = q.shape[1]
    with np.errstate(over="ignore"):
        a, b = np.floor(q * scale), np.floor(x * scale)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1)
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    # rows apart by size, so that a few large ones don't slow down the rest
    most = float(np.abs(a).max(initial=0)) * max(d, 1)
    size = np.abs(b).max(axis=1, initial=0)
    out = np.zeros((len(q), len(x)), np.int64)
    small, mid = size * most < 2.0**53, size * most < 2.0**62
    large = ~mid
    mid &= ~small
    if small.any():
        out[:, small] = (a @ b[small].T).astype(np.int64)
    if mid.any():
        out[:, mid] = a.astype(np.int64) @ b[mid].astype(np.int64).T
    if large.any():
        exact = _whole(q, scale) @ _whole(x[large], scale).T
        out[:, large] = np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)
    return out


class Lists:
    """The k best (score, id) of each row of a block of queries so far."""

    def __init__(self, k: int):
        self.k, self.row, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        least = np.where(allowed, score, _LONG.min)
        if len(ids) > self.k:  # all that tie with the k-th stay until ids decide
            floor = np.partition(least, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
            allowed = allowed & (score >= floor)
        r, c = np.nonzero(allowed)
        row, s, i = np.append(self.row, r), np.append(self.score, score[r, c]), np.append(self.id, ids[c])
        order = np.lexsort((i, ~s, row))  # ~s turns the order of longs around
        row = row[order]
        first = np.searchsorted(row, np.arange(row[-1] + 1 if len(row) else 0))
        keep = order[np.arange(len(row)) - first[row] < self.k]
        keep.sort()
        self.row, self.score, self.id = np.append(self.row, r)[keep], s[keep], i[keep]


class Search:
    """Partial top lists of one wave over any number of tiles."""

    def __init__(self, wave: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: int, tile: int):
        self.wave, self.k, self.scale, self.tile, self.best = wave, k, scale, tile, {}

    @staticmethod
    def by_length(ids: pa.Array, vec: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        size = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
        return {int(d): (ids.to_numpy()[rows := np.flatnonzero(size == d)], _matrix(vec, rows, int(d))) for d in np.unique(size)}

    def add(self, ids: pa.Array, vec: pa.Array) -> None:
        size = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
        own = ids.to_numpy()
        for d, (qid, q) in self.wave.items():
            same = np.flatnonzero(size == d)
            for at in range(0, len(same), self.tile):
                rows = same[at : at + self.tile]
                x, some = _matrix(vec, rows, d), own[rows]
                for lo in range(0, len(qid), 1024):
                    part = qid[lo : lo + 1024]
                    self.best.setdefault((d, lo), Lists(self.k)).add(products(q[lo : lo + 1024], x, self.scale), part[:, None] != some[None, :], some)

    def found(self) -> pa.Table:
        parts = [(self.wave[d][0][lo + x.row], x.id, x.score) for (d, lo), x in self.best.items()]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        context = TaskContext.get()
        return pa.table([*map(pa.array, cols), pa.array(np.full(len(cols[0]), context.partitionId() if context else 0, np.int64))], names=["query_id", "vec_id", "score", "part"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, wave_bytes: int = 64 << 20, tile: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): every query's k highest inner products over all rows but its own. `is_query` reads the id column."""
    spark = vectors.sparkSession
    data = taking_part(vectors, id_col, vec_col)
    asked = taking_part(vectors.where(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    size = lambda df: int(df.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0)
    waves = max(1, -(-size(asked) // wave_bytes))
    schema = "query_id long, vec_id long, score long, part long"
    if waves == 1:
        wave = asked.toArrow().combine_chunks()  # at most wave_bytes
        flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in wave.columns]
        shared = spark.sparkContext.broadcast(Search.by_length(*flat) if wave.num_rows else {})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value, k, scale, tile)
            for b in batches:
                search.add(b.column(0), b.column(1))
            yield from search.found().to_batches()

        parts = data.mapInArrow(run, schema)
    else:
        shards = max(1, -(-size(data) // wave_bytes))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = data.withColumn("_shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("_wave", every(waves))
        queries = asked.withColumn("_wave", F.pmod(F.xxhash64("id"), F.lit(waves)).cast("int")).withColumn("_shard", every(shards))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return Search({}, k, scale, tile).found()
            one = lambda t, c: t.column(c).combine_chunks()
            search = Search(Search.by_length(one(left, "id"), one(left, "v")), k, scale, tile)
            search.add(one(right, "id"), one(right, "v"))
            return search.found()

        parts = queries.groupBy("_wave", "_shard").cogroup(rows.groupBy("_wave", "_shard")).applyInArrow(meet, schema)
    best = [F.desc("score"), F.col("vec_id")]
    group = F.expr("part div 32")  # the first level merges the lists of 32 tasks
    first = parts.withColumn("_g", group).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_g").orderBy(*best))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
