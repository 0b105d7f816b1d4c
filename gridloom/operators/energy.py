"""Energy and statistics of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.statistics import pearson
from gridloom.operators.sections import US, in_order, known

JOULES_PER_KWH = 3_600_000


def kwh(max_gap_s: float) -> Column:
    """Energy of the interval that begins at a reading: left Riemann, the gap clipped."""
    gap = (F.lead("t").over(in_order()) - F.col("t")) / US
    return (F.least(gap, F.lit(float(max_gap_s))) if max_gap_s else gap) * F.col("value") / JOULES_PER_KWH


def total_energy(readings: DataFrame, max_gap_s: float) -> DataFrame:
    return known(readings).withColumn("kwh", kwh(max_gap_s)).groupBy("meter").agg(F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("kwh"))


def energy_by_preference(readings: DataFrame, quantity: Column, max_gap_s: float) -> DataFrame:
    """One energy a meter from its best quantity: cumulative energy, then energy, then power."""
    rows = known(readings).withColumn("q", quantity)
    each = Window.partitionBy("meter", "q").orderBy("t", "id")
    gap = F.least((F.lead("t").over(each) - F.col("t")) / US, F.lit(float(max_gap_s)))
    rows = rows.withColumn("e", F.when(F.col("q") == "power", gap * F.col("value") / JOULES_PER_KWH).when(F.col("q") == "energy", F.col("value")))
    at = F.struct("t", "id")
    found = rows.groupBy("meter", "q").agg(F.when(F.first("q") == "cumulative energy", F.max_by("value", at) - F.min_by("value", at)).otherwise(F.coalesce(F.sum("e"), F.lit(0.0))).alias("kwh"))
    rank = F.when(F.col("q") == "cumulative energy", 0).when(F.col("q") == "energy", 1).otherwise(2)
    return found.groupBy("meter").agg(F.min_by("q", rank).alias("quantity"), F.min_by("kwh", rank).alias("kwh"))


def dropout_rate(readings: DataFrame, period_s: float) -> DataFrame:
    """1 - n / (round(duration / period) + 1), at least 0; null below five samples."""
    n, span = F.count("value"), (F.max("t") - F.min("t")) / US
    return known(readings).groupBy("meter").agg(F.when(n >= 5, F.greatest(F.lit(0.0), 1 - n / (F.rint(span / period_s) + 1))).alias("rate"), n.alias("n"))


def vampire_power(readings: DataFrame) -> DataFrame:
    return known(readings).groupBy("meter").agg(F.min("value").alias("vampire"))


def histogram(readings: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) over [lo, hi], the last bin closed."""
    at = F.least(F.floor((F.col("value") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return known(readings).where(F.col("value").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def activity_histogram(readings: DataFrame, threshold: float) -> DataFrame:
    """(meter, hour, on_days): on how many days the meter was on in each hour of the day."""
    return activity_bins(readings, threshold, 86400, 3600).withColumnsRenamed({"bin": "hour", "periods": "on_days"})


def activity_bins(readings: DataFrame, threshold: float, period_s: int, bin_s: int) -> DataFrame:
    """(meter, bin, periods): in how many periods the meter was on in each bin of the period; a period is whole bins and starts where its multiples do (weeks on a Thursday, as 1970 did)."""
    if period_s % bin_s:
        raise ValueError("a period is a whole number of bins")
    bins = known(readings).where(F.col("value") >= threshold).select("meter", F.expr(f"t div {bin_s * US}").alias("b")).distinct()
    return bins.groupBy("meter", F.pmod("b", F.lit(period_s // bin_s)).cast("int").alias("bin")).agg(F.count("*").alias("periods"))


def energy_per_period(readings: DataFrame, max_gap_s: float, period_s: float = 86400) -> DataFrame:
    """Average energy of a period: energy over the span in periods."""
    rows = known(readings).withColumn("kwh", kwh(max_gap_s)).groupBy("meter").agg(F.sum("kwh").alias("kwh"), ((F.max("t") - F.min("t")) / US / period_s).alias("periods"))
    return rows.select("meter", F.when(F.col("periods") > 0, F.col("kwh") / F.col("periods")).alias("kwh_per_period"))


def energy_per_uptime(readings: DataFrame, sections: DataFrame, max_gap_s: float, period_s: float = 86400) -> DataFrame:
    """Average energy of a period that the meter was up: energy over the uptime of its sections in periods; null without uptime."""
    up = sections.groupBy("meter").agg(F.sum(F.col("end") - F.col("start")).alias("_up"))
    periods = F.col("_up") / US / period_s
    return total_energy(readings, max_gap_s).join(up, "meter", "left").select("meter", F.when(periods > 0, F.col("kwh") / periods).alias("kwh_per_period"))


def dropout_in_sections(readings: DataFrame, sections: DataFrame, period_s: float) -> DataFrame:
    """(meter, rate, n): the dropout rate within sections alone, so gaps between them don't count: each section's rate, weighted by its samples. Sections are closed here."""
    rows = within(readings, sections.withColumn("end", F.col("end") + 1))
    span = (F.col("end") - 1 - F.col("start")) / US
    each = known(rows).groupBy("meter", "start", "end").agg(F.count("*").alias("n")).withColumn("rate", F.greatest(F.lit(0.0), 1 - F.col("n") / (F.rint(span / period_s) + 1)))
    return weighted_rate(each)


def weighted_rate(parts: DataFrame) -> DataFrame:
    """(meter, rate, n) of partial results (meter, rate, n): rates weighted by their samples, those without a rate left out."""
    some = parts.where("rate is not null and n > 0")
    return some.groupBy("meter").agg((F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("rate"), F.sum("n").alias("n"))


def mean_dropout(rates: DataFrame) -> DataFrame:
    """(rate): the plain mean over meters, for a group."""
    return rates.agg(F.avg("rate").alias("rate"))


def fraction_per_meter(energy: DataFrame) -> DataFrame:
    whole = energy.agg(F.sum("kwh").alias("whole"))
    return energy.crossJoin(F.broadcast(whole)).select("meter", F.expr("try_divide(kwh, whole)").alias("fraction"))  # one row


def top_k(energy: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    order = F.col("kwh").asc() if ascending else F.col("kwh").desc()
    return energy.orderBy(order, "meter").limit(k)


def top_k_by(rows: DataFrame, k: int, by: str, ascending: bool = False, others: bool = False) -> DataFrame:
    """(meter, by) of the k meters of the highest (or lowest) value, nulls left out, of equal ones the smaller meter; with `others` a row without meter that holds the sum of the rest."""
    order = [F.col(by).asc() if ascending else F.col(by).desc(), F.col("meter")]
    some = rows.where(F.col(by).isNotNull()).select("meter", by)
    best = some.orderBy(*order).limit(k)
    if not others:
        return best
    rest = some.join(F.broadcast(best.select("meter")), "meter", "left_anti").agg(F.sum(by).alias(by), F.count("*").alias("_n")).where("_n > 0")  # k rows
    return best.unionByName(rest.select(F.lit(None).cast(dict(rows.dtypes)["meter"]).alias("meter"), by))


def mean_over_types(energies: DataFrame, other: DataFrame) -> DataFrame:
    """(meter, proportion) of energies (meter, ac_type, kwh): over those of the other, the mean over the AC types that both have; types of which the other has 0 don't count."""
    both = energies.join(other.withColumnRenamed("kwh", "_other"), ["meter", "ac_type"]).where("_other <> 0")
    return both.groupBy("meter").agg(F.avg(F.col("kwh") / F.col("_other")).alias("proportion"))


def fraction_over_types(energies: DataFrame) -> DataFrame:
    """(meter, fraction) of energies (meter, ac_type, kwh): each meter counts with the largest over its AC types."""
    return fraction_per_meter(energies.groupBy("meter").agg(F.max("kwh").alias("kwh")))


def with_remainder(energy: DataFrame, mains_kwh: Column, label: int = -1) -> DataFrame:
    rest = energy.agg(F.sum("kwh").alias("kwh")).select(F.lit(label).cast(dict(energy.dtypes)["meter"]).alias("meter"), (mains_kwh - F.col("kwh")).alias("kwh"))
    return energy.unionByName(rest)


def within(readings: DataFrame, sections: DataFrame, day_us: int = 86400 * US) -> DataFrame:
    """Readings inside sections: an equi join on meter and day, then the exact range (a section stands in each day it touches)."""
    days = sections.select("meter", "start", "end", F.explode(F.sequence(F.expr(f"start div {day_us}"), F.expr(f"(end - 1) div {day_us}"))).alias("day"))
    return readings.withColumn("day", F.expr(f"t div {day_us}")).join(days, ["meter", "day"]).where("t >= start and t < end").drop("day")


def proportion_of_energy(own: DataFrame, other: DataFrame, good: DataFrame, max_gap_s: float) -> DataFrame:
    """Energy of a meter over that of the other on the other's good sections; null if the other's is 0, 0 if its own is missing."""
    a = total_energy(within(own, good), max_gap_s).withColumnRenamed("kwh", "a")
    b = total_energy(within(other, good), max_gap_s).withColumnRenamed("kwh", "b")
    return b.join(a, "meter", "left").select("meter", F.when(F.col("b") != 0, F.coalesce("a", F.lit(0.0)) / F.col("b")).alias("proportion"))


def gram_pairs(grid: DataFrame, block: int = 256, stretch: int = 1024) -> DataFrame:
    """(a, b, r, n) of rows (meter, g, value) with a <= b: the correlation over shared instants, null where either is constant.

    Meters are dealt into blocks and instants into stretches of at most `stretch` of those that occur, by hash. A block's
    stretch is a matrix of meters by instants with a mask of what is known; two of them meet in one task, which
    multiplies the masks, values and squares and leaves one row a pair of meters that share an instant. Values are
    less their meter's mean, so that the sums keep their digits. Of repeated instants of a meter the mean counts.
    """
    rows = grid.where("value is not null and not isnan(value)").groupBy("meter", "g").agg(F.avg("value").alias("value"))
    many = lambda c, most: F.greatest(F.lit(1), F.ceil(F.approx_count_distinct(c) * 1.1 / most)).cast("int")
    blocks, stretches = (int(x) for x in rows.agg(many("meter", block), many("g", stretch)).first())
    mean = rows.groupBy("meter").agg(F.avg("value").alias("_mean"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = rows.join(mean, "meter").select("meter", "g", (F.col("value") - F.col("_mean")).alias("v"), deal("meter", blocks).alias("own"), deal("g", stretches).alias("part"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = rows.withColumn("_o", others).withColumns({"lo": F.least("own", "_o"), "hi": F.greatest("own", "_o")}).drop("_o")
    kind = dict(grid.dtypes)["meter"]

    def multiply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[1], key[2]
        meters, at = np.unique(group["meter"].to_numpy(), return_inverse=True)
        instants, when = np.unique(group["g"].to_numpy(), return_inverse=True)
        x, mask = np.zeros((len(meters), len(instants))), np.zeros((len(meters), len(instants)))
        x[at, when], mask[at, when] = group["v"].to_numpy(float), 1.0
        side = np.zeros(len(meters), int)
        side[at] = group["own"].to_numpy()
        p, q = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        a, ma, b, mb = x[p], mask[p], x[q], mask[q]
        n = ma @ mb.T
        some = n > 0 if lo != hi else np.triu(n > 0)
        i, j = np.nonzero(some)
        sums = {"n": n, "x": a @ mb.T, "y": ma @ b.T, "xx": (a * a) @ mb.T, "yy": ma @ (b * b).T, "xy": a @ b.T}
        first, second = meters[p[i]], meters[q[j]]
        turn = first > second
        out = {k: v[i, j] for k, v in sums.items()}
        swap = lambda u, v: (np.where(turn, out[v], out[u]), np.where(turn, out[u], out[v]))
        out["x"], out["y"], out["xx"], out["yy"] = *swap("x", "y"), *swap("xx", "yy")
        return pd.DataFrame({"a": np.where(turn, second, first), "b": np.where(turn, first, second)} | out)

    found = sent.groupBy("part", "lo", "hi").applyInPandas(multiply, f"a {kind}, b {kind}, n double, x double, y double, xx double, yy double, xy double")
    # with one stretch each pair is complete where it is made, and not shuffled
    total = found if stretches == 1 else found.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    spread = lambda u: F.col(f"{u}{u}") - F.col(u) * F.col(u) / F.col("n")
    # what rounding leaves of a constant side isn't a spread
    alive = lambda u: F.when((F.col("n") > 1) & (spread(u) > 1e-12 * F.col(f"{u}{u}")), spread(u))
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.sqrt(alive("x")) * F.sqrt(alive("y")))
    return total.select("a", "b", F.when(F.col("a") == F.col("b"), F.when(alive("x").isNotNull(), 1.0)).when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"), F.col("n").cast("long").alias("n"))


def correlation_pairs(grid: DataFrame) -> DataFrame:
    """Pearson correlation of every two kinds of a series that share grid instants: rows (kind, g, value); null where a side is constant."""
    a, b = grid.select(F.col("kind").alias("a"), "g", F.col("value").alias("x")), grid.select(F.col("kind").alias("b"), "g", F.col("value").alias("y"))
    return a.join(b, "g").where("a <= b").groupBy("a", "b").agg(pearson("x", "y").alias("r"), F.count("*").alias("n"))


def describe(readings: DataFrame) -> DataFrame:
    return known(readings).groupBy("meter").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("peak"))


def autocorrelation(readings: DataFrame, lags: list[int]) -> DataFrame:
    """One row a meter: the correlation with the reading so many places before, null where a side is constant."""
    rows = known(readings).select("meter", "value", *(F.lag("value", k).over(in_order()).alias(f"l{k}") for k in lags))
    return rows.groupBy("meter").agg(*(pearson("value", f"l{k}").alias(f"r{k}") for k in lags))


def clip(readings: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """Values within the limits of their device, where it has both."""
    both = lower.isNotNull() & upper.isNotNull() & F.col("value").isNotNull()
    return readings.withColumn("value", F.when(both, F.greatest(lower, F.least(upper, F.col("value")))).otherwise(F.col("value")))


def repaired_total(total: DataFrame, active: DataFrame, meters: int) -> DataFrame:
    """(t, value) of a total (t, value) over meters of which only some send: the mean of the sending ones, of which `active` (t, n) has the number at each instant, times all `meters`. Instants at which none sends are left out."""
    return total.join(active, "t").where("n > 0 and value is not null").select("t", (F.col("value") / F.col("n") * meters).alias("value"))


def combine_partial(parts: DataFrame, known_types: tuple[str, ...] = ("active", "apparent", "reactive")) -> DataFrame:
    """(meter, ac_type, kwh) of partial results (meter, ac_type, start, end, kwh), added up.

    Results of a meter and type whose frames overlap raise ValueError, an unknown type raises KeyError; frames may touch.
    """
    unknown = parts.where(~F.col("ac_type").isin(*known_types) | F.col("ac_type").isNull()).select("ac_type").first()
    if unknown:
        raise KeyError(unknown.ac_type)
    before = F.max("end").over(Window.partitionBy("meter", "ac_type").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    clash = parts.select("meter", "start", before.alias("_before")).where("_before > start").first()
    if clash:
        raise ValueError(f"frames of meter {clash.meter} overlap at {clash.start}")
    return parts.groupBy("meter", "ac_type").agg(F.sum("kwh").alias("kwh"))
