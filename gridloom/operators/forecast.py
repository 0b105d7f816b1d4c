"""Features and reference forecasts on gap-free grids (meter, t, value)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import day_group, hour_group
from gridloom.functions.statistics import pearson


def lag_features(grid: DataFrame, lags: list[int]) -> DataFrame:
    """Shifted values (a negative lag looks ahead); rows without the largest shift are dropped."""
    order = Window.partitionBy("meter").orderBy("t")
    rows = grid.select("meter", "t", "value", *(F.lag("value", k).over(order).alias(f"lag_{k}".replace("-", "ahead_")) for k in lags))
    return rows.dropna(subset=[f"lag_{max(lags)}"]) if max(lags) > 0 else rows


def horizon_features(grid: DataFrame, target_lags: list[int], last_lags: list[int], horizons: list[int]) -> DataFrame:
    """(meter, t, horizon, target, target_<k>..., last_<k>...): what a forecast of t + horizon knows at t.

    A lag of the target's kind counts back from the target (and must not reach past t), one of the last entry's kind from t;
    rows whose largest shift finds nothing are dropped. One ordered pass serves all horizons.
    """
    if any(k < h for k in target_lags for h in horizons):
        raise ValueError("a target's lag must be as long as the horizon")
    order = Window.partitionBy("meter").orderBy("t")
    shift = lambda k: (F.lag("value", k) if k >= 0 else F.lead("value", -k)).over(order)
    structs = [F.struct(F.lit(h).alias("horizon"), shift(-h).alias("target"), *(shift(k - h).alias(f"target_{k}") for k in target_lags), *(shift(k).alias(f"last_{k}") for k in last_lags)) for h in horizons]
    rows = grid.select("meter", "t", F.array(*structs).alias("_h")).select("meter", "t", F.explode("_h").alias("h")).select("meter", "t", "h.*")
    names = [f"target_{k}" for k in target_lags] + [f"last_{k}" for k in last_lags]
    return rows.dropna(subset=["target", *names])


def group_features(grid: DataFrame, day_groups: list[str], hour_groups: list[str]) -> DataFrame:
    """grid with a 0/1 column a group of weekdays (`days_0-4`) and of hours (`hours_06-09`)."""
    ts = F.timestamp_micros("t")
    return grid.withColumns({f"days_{g}": day_group(ts, g) for g in day_groups} | {f"hours_{g}": hour_group(ts, g) for g in hour_groups})


def with_external(grid: DataFrame, external: DataFrame, columns: list[str], horizon_us: int = 0) -> DataFrame:
    """grid with the external columns (meter, t, ...) of the instant a horizon later; null where there are none."""
    return grid.join(external.select("meter", (F.col("t") - horizon_us).alias("t"), *columns), ["meter", "t"], "left")


def classification_sample(spark: SparkSession, rows: int, width: int, classes: int, seed: int = 0) -> DataFrame:
    """(id, label, features array<double>): random points around their class; draws follow from the id, so partitions don't change them."""
    draw = lambda *k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), *(F.lit(x) for x in k)), 11) / float(1 << 53)
    label = F.floor(draw("label") * classes).cast("int")
    table = spark.range(rows).withColumn("label", label)
    return table.select("id", "label", F.array(*((F.col("label") + 1) * (draw("x", k) + 3.0) for k in range(width))).alias("features"))


def sweep(run: Callable[..., DataFrame], settings: list[dict]) -> DataFrame:
    """The rows of run(**setting) for each of the settings, with the setting as JSON; one plan, so they run together."""
    if not settings:
        raise ValueError("no settings")
    parts = [run(**x).withColumn("setting", F.lit(json.dumps(x, sort_keys=True))) for x in settings]
    return reduce(DataFrame.unionByName, parts)


def time_features(grid: DataFrame) -> DataFrame:
    ts = F.timestamp_micros("t")
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return grid.select("meter", "t", (F.weekday(ts) / 7).alias("weekday"), ((minutes - 720) / 1440).alias("time"), F.dayofyear(ts).alias("day"), F.weekday(ts).between(0, 4).cast("int").alias("workday"), ((F.hour(ts) >= 6) & (F.hour(ts) < 9)).cast("int").alias("morning"))


def seasonal(grid: DataFrame, shift_us: int) -> DataFrame:
    """(meter, t, pred, truth): the value one season ago, by an equi join on the shifted instant."""
    past = grid.select("meter", (F.col("t") + shift_us).alias("t"), F.col("value").alias("pred"))
    return grid.withColumnRenamed("value", "truth").join(past, ["meter", "t"]).select("meter", "t", "pred", "truth")


def correlation_vectors(grid: DataFrame, features: dict[str, Column]) -> DataFrame:
    """One row a meter: the correlation of its load with each feature, 0 where there is none."""
    return grid.groupBy("meter").agg(*(F.coalesce(pearson("value", x), F.lit(0.0)).alias(n) for n, x in features.items()))


SEASONS, DAY_TYPES = ("summer", "winter", "inter"), ("weekday", "saturday", "sunday")
ANCHORS = (21, 111, 202, 294)  # fixed values: the middle days of winter, spring, summer and autumn


def season_shares(day: Column) -> dict[str, Column]:
    """How far a day of the year belongs to each season: linear between the anchors."""
    winter, spring, summer, autumn = ANCHORS
    late = F.when(day < winter, day + 366).otherwise(day)
    after = {"winter": (day - winter) / (spring - winter), "spring": (day - spring) / (summer - spring), "summer": (day - summer) / (autumn - summer), "autumn": (late - autumn) / (winter - autumn + 366)}
    span = [day.between(a, b - 1) for a, b in zip(ANCHORS, ANCHORS[1:])]

    def pick(first: Column, second: Column, third: Column, fourth: Column) -> Column:
        return F.when(span[0], first).when(span[1], second).when(span[2], third).otherwise(fourth)

    none = F.lit(0.0)
    return {
        "winter": pick(1 - after["winter"], none, none, after["autumn"]),
        "summer": pick(none, after["spring"], 1 - after["summer"], none),
        "inter": pick(after["winter"], 1 - after["spring"], after["summer"], 1 - after["autumn"]),
    }


def load_profile(grid: DataFrame, profiles: dict[tuple[str, str], list[float]], factors: list[float], annual: Column, zone: str = "UTC", quarter: bool = False) -> DataFrame:
    """(meter, t, pred) by standard load profiles: 96 values for each (season, day type), a factor for each of 366 days, times the yearly use.

    The share of the next quarter-hour is minute / 60; with `quarter`, the true share of the quarter passed.
    """
    if any(len(profiles[x, y]) != 96 for x in SEASONS for y in DAY_TYPES) or len(factors) != 366:
        raise ValueError("a profile has 96 values, the factors are 366")
    spark = grid.sparkSession
    table = [(y, q, *(float(profiles[x, y][at % 96]) for at in (q, q + 1) for x in SEASONS)) for y in DAY_TYPES for q in range(96)]
    names = ", ".join(f"{x}{k} double" for k in (0, 1) for x in SEASONS)
    wide = F.broadcast(spark.createDataFrame(table, f"_type string, _quarter int, {names}"))  # 288 rows
    factor = F.broadcast(spark.createDataFrame(list(enumerate(map(float, factors), 1)), "_day int, _factor double"))  # 366 rows
    ts = F.timestamp_micros("t") if zone == "UTC" else F.from_utc_timestamp(F.timestamp_micros("t"), zone)
    kind = F.when(F.weekday(ts) < 5, "weekday").when(F.weekday(ts) == 5, "saturday").otherwise("sunday")
    share = (F.minute(ts) % 15) / 15 if quarter else F.minute(ts) / 60
    rows = grid.select("meter", "t", annual.cast("double").alias("_annual"), F.dayofyear(ts).alias("_day"), kind.alias("_type"), (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("int").alias("_quarter"), share.alias("_share"))
    mix = season_shares(F.col("_day"))
    pred = sum((((1 - F.col("_share")) * F.col(f"{x}0") + F.col("_share") * F.col(f"{x}1")) * mix[x] for x in SEASONS), F.lit(0.0))
    return rows.join(wide, ["_type", "_quarter"]).join(factor, "_day").select("meter", "t", (pred * F.col("_factor") * F.col("_annual")).alias("pred"))


def rank_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(meter, rho): Spearman, the correlation of average ranks; null where one side is constant."""
    some = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = some.select("meter", *((F.rank().over(Window.partitionBy("meter").orderBy(c)) + (F.count("*").over(Window.partitionBy("meter", c)) - 1) / 2).alias(f"_{k}") for k, c in enumerate((x, y))))
    return ranked.groupBy("meter").agg(pearson("_0", "_1").alias("rho"))


def _ties(values: np.ndarray) -> int:
    n = np.unique(values, return_counts=True)[1].astype(object)  # exact beyond 64 bits
    return int((n * (n - 1) // 2).sum()) if len(n) else 0


def _inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[i] > ranks[j]: they part at one highest bit, so each bit counts the ones before each zero among equal higher bits."""
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length()):
        order = np.argsort(ranks >> (bit + 1), kind="stable")
        head, one = ranks[order] >> (bit + 1), (ranks[order] >> bit) & 1
        ones = np.cumsum(one) - one
        start = np.searchsorted(head, head, "left")
        total += int((ones - ones[start])[one == 0].sum())
    return total


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float | None:
    """Tau-b; None where a side is constant. Sorted by x, then y, the discordant pairs are the inversions of y."""
    n = len(x)
    rx, ry = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    pairs, tx, ty = n * (n - 1) // 2, _ties(rx), _ties(ry)
    if pairs in (tx, ty):
        return None
    both = _ties(rx.astype(np.int64) * (int(ry.max()) + 1) + ry)
    swaps = _inversions(ry[np.lexsort((ry, rx))])
    return (pairs - tx - ty + both - 2 * swaps) / math.sqrt((pairs - tx) * (pairs - ty))


def kendall_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(meter, tau): Kendall's tau-b; null where one side is constant. n log^2 n in one task a meter; rows with a null or NaN don't count."""
    some = rows.select("meter", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tau = kendall_tau(part["_x"].to_numpy(), part["_y"].to_numpy())
        return pd.DataFrame({"meter": [part["meter"].iloc[0]], "tau": pd.array([tau], "Float64")})

    return some.groupBy("meter").applyInPandas(one, f"meter {dict(rows.dtypes)['meter']}, tau double")
