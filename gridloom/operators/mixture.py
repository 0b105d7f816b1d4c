"""Gaussian mixtures with full covariances by EM over DataFrames; dimensions may be emphasised.

The E-step of mixtures of every wanted size runs in one pass: a task leaves the sums of its rows, counts, values and
products, a size, and Spark adds these up. The M-step, on the driver, sees components times dimensions squared. Starts come from a bounded
sample of the different vectors (those of the least hashes, with their numbers), where several seeded starts are tried.

Emphasis f on a dimension makes it count more: in every M-step the deviations of all other dimensions are widened by the root of f,
so they tell components apart less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.cluster import _vectors

LEAST = 1e-6  # on every variance


class Mixture(NamedTuple):
    """Components: weight (k), mean (k, d), covariance (k, d, d)."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray


def widening(columns: list[str], emphasis: dict[str, float] | None) -> np.ndarray:
    """By how much each dimension's deviation is widened."""
    given = emphasis or {}
    if unknown := set(given) - set(columns):
        raise ValueError(f"no such column: {sorted(unknown)}")
    if min(given.values(), default=1.0) <= 0:
        raise ValueError("an emphasis is above 0")
    return np.array([math.sqrt(math.prod(f for c, f in given.items() if c != own)) for own in columns])


def joint(x: np.ndarray, m: Mixture) -> np.ndarray:
    """Log of weight times density, rows by components."""
    out = np.empty((len(x), len(m.weight)))
    for k, (w, mean, cov) in enumerate(zip(m.weight, m.mean, m.cov, strict=True)):
        root = np.linalg.cholesky(cov)
        z = np.linalg.solve(root, (x - mean).T)
        out[:, k] = math.log(max(w, 1e-300)) - (z * z).sum(axis=0) / 2 - np.log(np.diag(root)).sum() - x.shape[1] * math.log(2 * math.pi) / 2
    return out


def posterior(x: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """(posterior probabilities, log likelihood of each row)"""
    f = joint(x, m)
    top = f.max(axis=1, keepdims=True)
    p = np.exp(f - top)
    total = p.sum(axis=1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def expect(x: np.ndarray, m: Mixture, times: np.ndarray | None = None) -> np.ndarray:
    """The sums of an E-step in a row: the log likelihood, then for each component the weight, values and products."""
    r, ll = posterior(x, m)
    if times is not None:
        r, ll = r * times[:, None], ll * times
    k, d = m.mean.shape
    products = np.stack([(r[:, i, None] * x).T @ x for i in range(k)])
    return np.concatenate([[ll.sum()], r.sum(axis=0), (r.T @ x).ravel(), products.ravel()])


def maximise(sums: np.ndarray, k: int, d: int, wide: np.ndarray) -> Mixture:
    weight = sums[1 : 1 + k] + 10 * np.finfo(float).eps
    mean = sums[1 + k : 1 + k + k * d].reshape(k, d) / weight[:, None]
    cov = sums[1 + k + k * d :].reshape(k, d, d) / weight[:, None, None] - mean[:, :, None] * mean[:, None, :]
    cov = (cov + cov.transpose(0, 2, 1)) / 2 + LEAST * np.eye(d)
    # rounding may leave a flat direction below zero
    e, u = np.linalg.eigh(cov)
    cov = (u * np.maximum(e, LEAST)[:, None, :]) @ u.transpose(0, 2, 1)
    return Mixture(weight / weight.sum(), mean, cov * np.outer(wide, wide))


def _start(x: np.ndarray, times: np.ndarray, k: int, wide: np.ndarray, seed: int, tries: int, rounds: int) -> Mixture:
    """Of several seeded starts on a sample the likeliest after some rounds."""
    scale = np.sqrt(np.maximum(np.average((x - np.average(x, axis=0, weights=times)) ** 2, axis=0, weights=times), LEAST))
    z, best, top = x / scale, None, -np.inf
    for n in range(tries if k > 1 else 1):
        rng = np.random.default_rng([seed, k, n])
        centres = z[[int(rng.choice(len(z), p=times / times.sum()))]]
        while len(centres) < k:
            far = times * ((z[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.vstack([centres, z[int(rng.choice(len(z), p=far / far.sum()))] if far.sum() > 0 else centres[0]])
        own = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        r = (own[:, None] == np.arange(k)) * times[:, None]
        sums = np.concatenate([[0.0], r.sum(axis=0), (r.T @ x).ravel(), np.stack([(r[:, i, None] * x).T @ x for i in range(k)]).ravel()])
        m, before = maximise(sums, k, x.shape[1], wide), -np.inf
        for _ in range(rounds):
            sums = expect(x, m, times)
            if abs(sums[0] - before) <= 1e-4 * times.sum():
                break
            before, m = sums[0], maximise(sums, k, x.shape[1], wide)
        if sums[0] > top:
            best, top = m, sums[0]
    return best


def fit(rows: DataFrame, columns: list[str], sizes: list[int], emphasis: dict[str, float] | None = None, seed: int = 1, rounds: int = 100, tolerance: float = 1e-4, sample: int = 1024, starts: dict[int, Mixture] | None = None) -> dict[int, tuple[Mixture, float, int]]:
    """For each size (mixture, log likelihood, number of rows): EM until the likelihood a row changes by `tolerance` at most. Nulls count as 0."""
    data = _vectors(rows, columns).select(vector_to_array("_raw").alias("x")).persist()
    try:
        wide, d = widening(columns, emphasis), len(columns)
        counted = data.groupBy("x").agg(F.count("*").alias("n")).orderBy(F.xxhash64("x"), "x").limit(sample).collect()
        if not counted:
            return {}
        first, times = np.array([r.x for r in counted], float).reshape(-1, d), np.array([r.n for r in counted], float)
        centre = np.average(first, axis=0, weights=times)  # sums of products keep their digits near it
        models = {k: starts[k]._replace(mean=starts[k].mean - centre) if starts else _start(first - centre, times, k, wide, seed, 4, 50) for k in sizes}
        likelihood, done, n = dict.fromkeys(sizes, -math.inf), set(), 0

        def passed(some: dict[int, Mixture]) -> dict[int, np.ndarray]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for b in batches:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - centre
                    for at in range(0, len(x), 8192):
                        for k, m in some.items():
                            one = np.append(expect(x[at : at + 8192], m), len(x[at : at + 8192]))
                            total[k] = total[k] + one if k in total else one
                for k, v in total.items():
                    yield pa.record_batch([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["k", "i", "v"])

            out: dict[int, dict[int, float]] = {}
            for k, i, v in data.mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():  # a number a parameter
                out.setdefault(k, {})[i] = v
            return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}

        for _ in range(rounds):
            for k, sums in passed({k: m for k, m in models.items() if k not in done}).items():
                n = int(sums[-1])
                if abs(sums[0] - likelihood[k]) <= tolerance * n:
                    done.add(k)
                else:
                    models[k] = maximise(sums[:-1], k, d, wide)
                likelihood[k] = float(sums[0])
            if len(done) == len(sizes):
                break
        return {k: (m._replace(mean=m.mean + centre), likelihood[k], n) for k, m in models.items()}
    finally:
        data.unpersist()


def placed(rows: DataFrame, columns: list[str], m: Mixture) -> DataFrame:
    """rows with `component`, `_sure` (the posterior of it) and `_far` (its squared Mahalanobis distance)."""
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in columns]

    def number(v: float) -> Column:
        return F.lit(float(v))

    far, scores = [], []
    for w, mean, cov in zip(m.weight, m.mean, m.cov, strict=True):
        inverse = np.linalg.inv(cov)
        off = [v - number(c) for v, c in zip(x, mean, strict=True)]
        far.append(sum((off[i] * off[j] * number(inverse[i, j] * (1 if i == j else 2)) for i in range(len(off)) for j in range(i, len(off))), number(0)))
        scores.append(number(math.log(max(w, 1e-300)) - np.linalg.slogdet(cov)[1] / 2) - far[-1] / 2)
    out = rows.withColumns({"_scores": F.array(*scores), "_fars": F.array(*far)})
    out = out.withColumn("component", (F.array_position("_scores", F.array_max("_scores")) - 1).cast("int"))
    top = F.array_max("_scores")
    sure = 1 / F.aggregate("_scores", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return out.withColumns({"_sure": sure, "_far": F.get("_fars", F.col("component"))}).drop("_scores", "_fars")
