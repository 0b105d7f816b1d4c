"""Nearest-neighbour estimates of entropy and mutual information, in units of log(base).

Ties are broken by a tiny shift that follows from the row's id, so that results repeat. A meter of k values or fewer has
a null estimate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import before, reach
from gridloom.operators.sections import known
from gridloom.operators.wiring import _cut

SHIFT = 1e-10
LEAST = 1e-15


def _digamma_number(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def digamma(n: Column) -> Column:
    """For n >= 1: the asymptotic series ten steps further on, and the recurrence back."""
    m = n + F.lit(10.0)
    back = sum((1 / (n + F.lit(float(i))) for i in range(1, 10)), 1 / n)
    return F.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - back


def shifted(value: str = "value", row: str = "id") -> Column:
    return F.col(value) + SHIFT * (F.pmod(F.col(row) * 7919, F.lit(1000003)) / 1000003)


def entropy_per_meter(readings: DataFrame, k: int = 3, base: float = 2) -> DataFrame:
    """(meter, entropy, n). On a line the k nearest are neighbours in the sorted order: j below and k - j above."""
    order = Window.partitionBy("meter").orderBy("z", "id")
    z = F.col("z")
    reach = []
    for j in range(k + 1):
        low = F.lag(z, j).over(order) if j else z
        high = F.lead(z, k - j).over(order) if j < k else z
        reach.append(F.when(low.isNotNull() & high.isNotNull(), F.greatest(z - low, high - z)))
    near = known(readings).withColumn("z", shifted()).withColumn("near", F.least(*reach))
    found = near.groupBy("meter").agg(F.count("z").alias("n"), F.avg(F.log(F.greatest("near", F.lit(LEAST)))).alias("mean"))
    n = F.col("n").cast("double")
    return found.select("meter", F.when(F.col("n") > k, (digamma(n) - _digamma_number(k) + math.log(2) + F.col("mean")) / math.log(base)).alias("entropy"), "n")


def _nearest(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int, own: bool = False, tile: int = 512) -> list[np.ndarray]:
    """The k smallest distances, the larger of both dimensions, from each (x, y) to the points (px, py); with `own` these are the same points and none is near itself."""
    found = []
    for a in range(0, len(x), tile):
        far = np.maximum(np.abs(x[a : a + tile, None] - px), np.abs(y[a : a + tile, None] - py))
        if own:
            at = np.arange(len(far))
            far[at, a + at] = np.inf
        least = min(k, far.shape[1])
        found.extend(np.sort(np.partition(far, least - 1, axis=1)[:, :least], axis=1))
    return found


def _pieces(rows: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Rows placed (`_before`, `_all`) within their key by `_u`, the dimension in which they lie farther apart; `name` is whether that is x."""
    spread = rows.groupBy(*keys).agg((F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias(name))
    return before(rows.join(spread, keys).withColumn("_u", F.when(F.col(name), F.col("x")).otherwise(F.col("y"))), keys, ["_u", *order])


def radii(points: DataFrame, by: list[str], k: int, cell: int = 512, asked: int = 20_000) -> DataFrame:
    """(by, _row, x, y, radius, n): the distance from each point (by, id, x, y) to the k-th nearest other point of its key, exactly; keys of k points or fewer are left out.

    A key's points are dealt into strips and these into cells of about `cell` points, each time by places in the order of the
    wider dimension, so that any density gives cells of like size. The k-th distance within the cell bounds the search: the
    places of both ends of that square name the strips and then the cells that it touches, and these answer with their own k
    nearest. A cell that many points ask is copied for each `asked` of them.
    """
    size = max(cell, 4 * (k + 1))
    first = _pieces(points.select(*by, "id", "x", "y"), by, "_x1", ["x", "y", "id"]).withColumnsRenamed({"_before": "_row", "_all": "n"}).where(F.col("n") > k)
    first = first.withColumn("_sides", F.ceil(F.sqrt(F.col("n") / size))).withColumn("_strip", F.expr("_row * _sides div n")).drop("id", "_u")
    second = _pieces(first, [*by, "_strip"], "_x2", ["_row"]).withColumn("_blocks", F.ceil(F.col("_all") / size)).withColumn("_block", F.expr("_before * _blocks div _all")).drop("_u", "_before").withColumnRenamed("_all", "_m")
    kinds = dict(points.dtypes)
    typed = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"].to_numpy(), part["y"].to_numpy()
        return part.assign(near=_nearest(x, y, x, y, k, own=True))

    rest = "n long, _row long, _sides long, _x1 boolean, _strip long, _x2 boolean, _m long, _blocks long, _block long, x double, y double"
    names = [*by, *(c.split()[0] for c in rest.split(", "))]
    own = _cut(second.select(*names).groupBy(*by, "_strip", "_block").applyInPandas(inside, f"{typed}, {rest}, near array<double>"))
    bound = own.withColumn("_r", F.element_at("near", k))

    u1, u2 = F.when(F.col("_x1"), F.col("x")).otherwise(F.col("y")), F.when(F.col("_x2"), F.col("x")).otherwise(F.col("y"))
    probes = bound.select(*by, "n", "_row", "_sides", F.col("_strip").alias("_home"), F.col("_block").alias("_home_block"), "x", "y", F.col("_r").alias("_r1"), u1.alias("_u"), "_r")
    strips = reach(bound.select(*by, "_row", u1.alias("_u")), probes, by).withColumn("_strip", F.explode(F.expr("sequence(_low * _sides div n, (greatest(_high, 1) - 1) * _sides div n)")))
    shape = own.select(*by, "_strip", "_x2", "_m", "_blocks").distinct()
    probes = strips.join(shape, [*by, "_strip"]).select(*by, "_strip", "_row", "_home", "_home_block", "x", "y", "_m", "_blocks", u2.alias("_u"), F.col("_r1").alias("_r"), "_r1")
    touched = reach(bound.select(*by, "_strip", "_row", u2.alias("_u")), probes, [*by, "_strip"]).where("_low < _high")
    touched = touched.withColumn("_block", F.explode(F.expr("sequence(_low * _blocks div _m, (_high - 1) * _blocks div _m)"))).where("_strip <> _home or _block <> _home_block")
    asks = touched.select(*by, "_strip", "_block", "_row", "x", "y", F.col("_r1").alias("r"))

    place = [*by, "_strip", "_block"]
    copies = asks.groupBy(*place).agg(F.ceil(F.count("*") / asked).alias("_copies"))
    left = asks.join(copies, place).withColumn("_copy", F.expr("_row % _copies")).drop("_copies").groupBy(*place, "_copy")
    cells = own.select(*place, "x", "y").join(copies, place).withColumn("_copy", F.explode(F.expr("sequence(0L, _copies - 1)"))).drop("_copies")
    right = cells.toDF(*(f"of_{c}" for c in cells.columns)).groupBy(*(f"of_{c}" for c in (*place, "_copy")))  # names of their own, as both sides stem from one frame

    def outside(key: tuple, ask: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(ask["x"].to_numpy(), ask["y"].to_numpy(), points["of_x"].to_numpy(), points["of_y"].to_numpy(), k) if len(points) else [np.array([])] * len(ask)
        better = [len(f) > 0 and f[0] < r for f, r in zip(found, ask["r"])]
        return pd.DataFrame({"_row": ask["_row"], "near": pd.Series(found, index=ask.index, dtype=object)} | {c: ask[c] for c in by})[better]

    others = left.cogroup(right).applyInPandas(outside, f"_row long, near array<double>, {typed}")
    all_near = own.select(*by, "_row", "x", "y", "n", "near").unionByName(others, allowMissingColumns=True)
    merged = all_near.groupBy(*by, "_row").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("n").alias("n"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.select(*by, "_row", "x", "y", F.element_at("near", k).alias("radius"), "n")


def mutual_information(pairs: DataFrame, k: int = 3, base: float = 2, by: Sequence[str] = ("meter",), cell: int = 512) -> DataFrame:
    """(by, mi, n) of rows (by, id, x, y), over all points of a key, however many.

    Rows with a null key don't count, nor do x or y that are null, NaN or infinite. The radius is that of the k-th nearest
    neighbour in the plane; the values within it on each axis are counted by places in the order of that axis.
    """
    by = list(by)
    fine = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    whole = F.lit(True)
    for c in by:
        whole = whole & F.col(c).isNotNull()
    points = pairs.where(fine("x") & fine("y") & whole).select(*by, "id", shifted("x").alias("x"), shifted("y").alias("y"))
    axis = lambda c: F.struct(F.lit(c).alias("_axis"), F.col(c).alias("_u"))
    sides = radii(points, by, k, cell).select(*by, "_row", "n", F.explode(F.array(axis("x"), axis("y"))).alias("_side"), (F.col("radius") - LEAST).alias("_r")).select(*by, "_row", "n", "_side.*", "_r")
    close = reach(sides, sides, [*by, "_axis"])
    inside = digamma(F.greatest(F.col("_high") - F.col("_low"), F.lit(1)).cast("double"))
    n = F.col("n").cast("double")
    found = close.groupBy(*by, "n").agg(F.sum(inside).alias("_sum")).select(*by, ((_digamma_number(k) + digamma(n) - F.col("_sum") / n) / math.log(base)).alias("mi"))
    return points.groupBy(*by).agg(F.count("*").alias("n")).join(found, by, "left").select(*by, "mi", "n")


def pairwise_mutual_information(readings: DataFrame, k: int = 3, base: float = 2, cell: int = 512) -> DataFrame:
    """(meter_a, meter_b, mi, n) of every two meters, the smaller first, with instants in common; of several readings of a meter at one instant the mean counts.

    Its rows are those of every pair and instant, which the estimate needs.
    """
    once = known(readings).groupBy("meter", "t").agg(F.avg("value").alias("value"))
    a, b = once.select(F.col("meter").alias("meter_a"), "t", F.col("value").alias("x")), once.select(F.col("meter").alias("meter_b"), "t", F.col("value").alias("y"))
    both = a.join(b, "t").where("meter_a < meter_b").withColumn("id", F.pmod("t", F.lit(1000003)))
    return mutual_information(both, k, base, ("meter_a", "meter_b"), cell)
