"""Importance resampling towards a target distribution over hashed word n-grams.

A streaming ring of CRC states: one scan of a text keeps the running zlib states of the last n starts, extends each by a
space and the next word, and emits a bucket for every run that ends there, so no run is ever joined as a string. Counts of the
buckets over all source and all target texts (two tables of `buckets` numbers, the only thing on the driver) give
each bucket a gain; a second scan adds up the gains of each document. Gumbel noise from a hash of the id makes the highest
scores a draw without replacement.

Ranks come from a range-partitioned sort: a row's rank is its place in its part and the number of rows in the parts
before, so no task sees more than a part; rows of one score and id are dealt out by their number.

Defined results: null and empty texts have no features and weight 0; a null id counts as the empty text in the hash and comes first
among ties; repeated rows are rows of their own, with equal scores and different ranks; an empty table gives an empty result; columns besides the id
and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 20


def text_words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about a megabyte, which end between words."""
    data = (text or "").encode().translate(_LOWER)
    at = 0
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        if end < len(data) and (m := _WORD.match(data, end)):
            end = m.end()
        yield _WORD.findall(data, at, end)
        at = end


def ring(words: list[bytes], n: int, states: list[int]) -> list[int]:
    """CRCs of all runs of 1 to n words that end with one of `words`; `states` are those of the last n - 1 starts and go on."""
    if n == 1:  # no start goes on
        return list(map(crc32, words))
    out: list[int] = []
    for w in words:
        states[:] = [crc32(w, crc32(b" ", s)) for s in states]
        states.append(crc32(w))
        out += states
        if len(states) == n:
            del states[0]
    return out


def text_buckets(text: str | None, n: int, buckets: int) -> tuple[int, list[np.ndarray]]:
    """(number of words, the buckets of all runs, block by block)."""
    states: list[int] = []
    words, found = 0, []
    for block in text_words(text):
        words += len(block)
        found.append(np.array(ring(block, n, states), np.int64) % buckets)
    return words, found


def bucket_counts(docs: DataFrame, n: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for found in text_buckets(text.as_py(), n, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, count in parts.groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket at most
        out[bucket] = count
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    size = len(source)
    s, t = float(source.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log(float(b + 1) * s / (float(a + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, n: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, found = text_buckets(text.as_py(), n, len(gain))
                weight = sum(int(gain[x].sum()) for x in found)
                rows.append((doc, words, sum(map(len, found)), weight, weight + noise(doc, seed)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def ranked(rows: DataFrame, order: list, parts: int) -> tuple[DataFrame, DataFrame]:
    """(rows with `_part` and `_at`, their place in a range-partitioned sort by `order`; rows a part with `_before`, those of the parts before)."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _part long, _at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(np.full(len(b), part, np.int64)), pa.array(np.arange(seen, seen + len(b)))], names=[*names, "_part", "_at"])
            seen += len(b)

    placed = common.durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    count = dict(placed.groupBy("_part").count().collect())  # a row a part
    before = np.cumsum([0, *(count.get(k, 0) for k in range(max(count, default=0)))]).tolist()
    return placed, placed.sparkSession.createDataFrame(list(enumerate(before)), "_part long, _before long")


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; share[0]/share[1] of the documents with at least `least_words` words are drawn and have a rank."""
    gain = gains(bucket_counts(docs, n, buckets, text_col), bucket_counts(target, n, buckets, target_text_col))
    path = common.shared_path(docs.sparkSession, "scores")
    scores(docs, gain, n, seed, id_col, text_col).withColumn("_n", F.monotonically_increasing_id()).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    able = F.col("n_words") >= least_words
    drawn = found.where(able).count() * share[0] // share[1]
    order = [F.desc(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_n")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, before = ranked(found, order, parts)
    common.delete(docs.sparkSession, path)
    rank = F.col("_before") + F.col("_at") + 1
    out = placed.join(F.broadcast(before), "_part")
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
