"""Training of states and chains: k-means states by silhouette, Gaussian hidden Markov chains by EM.

A chain's E-step runs over parts of a series of bounded length, in as many tasks as there are parts; what leaves a task are the
part's sums. The M-step adds the sums of a meter up. So no task holds a series, and models stay in a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.disaggregate import kmeans_1d
from gridloom.operators.sections import US, known
from gridloom.operators.wiring import _cut


def silhouette(x: np.ndarray, weight: np.ndarray, own: np.ndarray) -> float:
    """The mean silhouette of clusters of values on a line, each value standing there `weight` times; of absolute distances."""
    names = np.unique(own)
    if len(names) < 2:
        return -1.0
    order = np.argsort(x, kind="stable")
    x, weight, own = x[order], weight[order].astype(float), own[order]
    away = np.zeros((len(names), len(x)))  # mean distance of each value to each cluster
    size = np.array([weight[own == c].sum() for c in names])
    for k, c in enumerate(names):
        w = np.where(own == c, weight, 0.0)
        below, total = np.cumsum(w), np.cumsum(w * x)
        away[k] = x * below - total + (total[-1] - total) - x * (below[-1] - below)
    mine = np.searchsorted(names, own)
    a = away[mine, np.arange(len(x))] / np.maximum(size[mine] - 1, 1)
    others = away / size[:, None]
    others[mine, np.arange(len(x))] = np.inf
    b = others.min(axis=0)
    s = np.where(size[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(np.average(s, weights=weight))


def states_by_silhouette(readings: DataFrame, most: int = 3, least: float = 10, few: int = 20) -> DataFrame:
    """(meter, states array<int>, score): 0 and the rounded k-means centres of the values above `least`, k from 2 to most - 1 by the best silhouette.

    Fewer than `few` such values give 0 alone, a silhouette of no two clusters one centre. Values are counted in bins of 1 W
    first, so a task holds a histogram, which keeps every value's weight, not the series.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x, n = rows["w"].to_numpy(float), rows["n"].to_numpy()
        if n.sum() < few:
            found, score = [], None
        else:
            found, score = kmeans_1d(x, 1, weight=n), -1.0
            for k in range(2, min(most - 1, len(x)) + 1):
                centres = kmeans_1d(x, k, weight=n)
                now = silhouette(x, n, np.abs(x[:, None] - centres[None]).argmin(1))
                if now > score:
                    found, score = centres, now
        return pd.DataFrame({"meter": [rows["meter"].iloc[0]], "states": [sorted({0, *np.rint(found).astype(int).tolist()})], "score": [score]})

    kind = dict(readings.dtypes)["meter"]
    counted = known(readings).where(F.col("value") > least).groupBy("meter", F.round("value").alias("w")).agg(F.count("*").alias("n"))
    some = counted.groupBy("meter").applyInPandas(one, f"meter {kind}, states array<int>, score double")
    every = known(readings).select("meter").distinct()
    return every.join(some, "meter", "left").select("meter", F.coalesce("states", F.array(F.lit(0))).alias("states"), "score")


def parts(readings: DataFrame, gap_s: float, longest: int, key: str = "meter") -> DataFrame:
    """(key, v array<double>): the known values of a series in order, cut at gaps of more than gap_s and after `longest` of them.

    `key` names the chain that a part trains, by default its meter's; with another column, as an appliance's type, the parts of
    many meters train one chain.
    """
    order = Window.partitionBy("meter").orderBy("t", "id")
    rows = known(readings).withColumn("_new", F.when(F.col("t") - F.lag("t").over(order) <= round(gap_s * US), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("meter", "_run").orderBy("t", "id")
    rows = rows.withColumn("_n", F.row_number().over(inside) - 1).withColumn("_part", F.expr(f"_n div {longest}"))
    name = F.col(key).alias("key")
    packed = rows.groupBy("meter", "_run", "_part", name).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("v"))
    return packed.select("key", "v")


def _sums(v: np.ndarray, mean: np.ndarray, var: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray]:
    """(log likelihood, sums) of one part by the scaled forward and backward passes: first states, moves, weights, values, squares."""
    k, n = len(mean), len(v)
    fit = -((v[:, None] - mean) ** 2) / (2 * var) - np.log(2 * np.pi * var) / 2
    top = fit.max(axis=1)
    b = np.exp(fit - top[:, None])
    forth, scale = np.empty((n, k)), np.empty(n)
    now = start * b[0]
    for i in range(n):
        if i:
            now = (forth[i - 1] @ move) * b[i]
        scale[i] = max(now.sum(), 1e-300)
        forth[i] = now / scale[i]
    back, moves = np.ones(k), np.zeros((k, k))
    gamma = np.empty((n, k))
    gamma[-1] = forth[-1]
    for i in range(n - 2, -1, -1):
        ahead = b[i + 1] * back / scale[i + 1]
        moves += np.outer(forth[i], ahead) * move
        back = move @ ahead
        gamma[i] = forth[i] * back
    gamma /= np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)
    return float(np.log(scale).sum() + top.sum()), np.concatenate([gamma[0], moves.ravel(), gamma.sum(0), gamma.T @ v, gamma.T @ (v * v)])


def fit_chains(packed: DataFrame, states: int, rounds: int = 10, prior: float = 1.0, least_var: float = 1.0) -> DataFrame:
    """(key, mean, var, start, move, log_likelihood) of each chain of parts (key, v), states sorted by their mean.

    EM for Gaussian chains, from means spread over the values' quantiles; `prior` is added to every count of a start and a move.
    Each round is one pass over the parts, which should be durable. The likelihood is that of the model before the last step.
    """
    kind = dict(packed.dtypes)["key"]
    k = states
    values = packed.select("key", F.explode("v").alias("x"))
    share = [(i + 0.5) / k for i in range(k)]
    spread = values.groupBy("key").agg(F.percentile_approx("x", share, 10_000).alias("mean"), F.greatest(F.var_pop("x") / (k * k), F.lit(least_var)).alias("v0"))
    near = lambda i: F.array(*(F.lit(0.9 if i == j else 0.1 / max(k - 1, 1)) for j in range(k))) if k > 1 else F.array(F.lit(1.0))
    # equal quantiles would stay equal, so each is moved a little
    mean = F.transform("mean", lambda m, i: m + i * F.sqrt("v0") * 0.1)
    model = _cut(spread.select("key", mean.alias("mean"), F.array_repeat("v0", k).alias("var"), F.array_repeat(F.lit(1.0 / k), k).alias("start"), F.flatten(F.array(*(near(i) for i in range(k)))).alias("move"), F.lit(0.0).alias("ll")))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, v, mean, var, start, move in zip(*(rows[c] for c in ("key", "v", "mean", "var", "start", "move")), strict=True):
                ll, sums = _sums(np.asarray(v, float), *(np.asarray(x, float) for x in (mean, var, start)), np.asarray(move, float).reshape(k, k))
                out.append((key, ll, sums))
            yield pd.DataFrame(out, columns=["key", "ll", "sums"])

    def maximised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, ll, sums in zip(rows["key"], rows["ll"], rows["sums"], strict=True):
                s = np.asarray(sums, float)
                first, moves, weight, total, square = s[:k], s[k : k + k * k].reshape(k, k), *s[k + k * k :].reshape(3, k)
                weight = np.maximum(weight, 1e-9)
                mean = total / weight
                order = np.argsort(mean, kind="stable")
                var = np.maximum(square / weight - mean**2, least_var)
                start, move = (first + prior) / (first + prior).sum(), (moves + prior) / (moves + prior).sum(axis=1, keepdims=True)
                out.append((key, mean[order], var[order], start[order], move[np.ix_(order, order)].ravel(), ll))
            yield pd.DataFrame(out, columns=["key", "mean", "var", "start", "move", "ll"])

    shape = f"key {kind}, mean array<double>, var array<double>, start array<double>, move array<double>, ll double"
    for _ in range(rounds):
        done = packed.where(F.size("v") > 0).join(model.drop("ll"), "key").mapInPandas(expect, f"key {kind}, ll double, sums array<double>")
        each = done.select("key", "ll", F.posexplode("sums").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x"), F.sum("ll").alias("ll"))
        whole = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("sums"), F.first("ll").alias("ll"))
        model = _cut(whole.mapInPandas(maximised, shape))
    rows = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice("move", i * k + 1, F.lit(k)))
    return model.select("key", "mean", "var", "start", rows.alias("move"), F.col("ll").alias("log_likelihood"))
