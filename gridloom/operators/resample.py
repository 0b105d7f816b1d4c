"""Grids: as-of fill, bin means, interpolation, alignment of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.energy import within
from gridloom.operators.sections import US, in_order, known, merge_gaps


def bin_start(step_s: int, t: str = "t") -> Column:
    return F.expr(f"{t} - pmod({t}, {step_s * US})")


def steps(rows: DataFrame, first: str, last: str, step: int, name: str) -> DataFrame:
    """A row for every step from the column `first` to `last`, both on the grid of the multiples of `step`, named `name`.

    Days are listed first, then the steps of each, so that no array holds more than a day's steps or the days of a row.
    """
    day = 86400 * US
    rows = rows.withColumn("_day", F.explode_outer(F.sequence(F.expr(f"({first} - pmod({first}, {day})) div {day}"), F.expr(f"({last} - pmod({last}, {day})) div {day}"))))
    begin, end = F.col("_day") * day, F.col("_day") * day + (day - 1)
    rows = rows.withColumns({"_lo": F.greatest(F.col(first), begin + F.pmod(-begin, F.lit(step))), "_hi": F.least(F.col(last), end - F.pmod(end, F.lit(step)))}).where("_lo <= _hi")
    return rows.withColumn(name, F.explode(F.sequence("_lo", "_hi", F.lit(step)))).drop("_day", "_lo", "_hi")


def grid(readings: DataFrame, step_s: int) -> DataFrame:
    """(meter, t) at every step from a meter's first bin to its last."""
    ends = known(readings).groupBy("meter").agg(F.min(bin_start(step_s)).alias("a"), F.max(bin_start(step_s)).alias("b"))
    return steps(ends, "a", "b", step_s * US, "t").select("meter", "t")


def asof(readings: DataFrame, step_s: int, limit_s: int | None = None) -> DataFrame:
    """(meter, t, value): the last value at or before each grid instant, null if older than the limit. One sort, no range join."""
    samples = known(readings).select("meter", "t", "id", "value", F.lit(0).alias("g"))
    points = grid(readings, step_s).select("meter", "t", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("g"))
    upto = in_order("t", "g", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.unionByName(points).withColumn("last", F.last("value", True).over(upto)).withColumn("at", F.last(F.when(F.col("g") == 0, F.col("t")), True).over(upto))
    fresh = F.lit(True) if limit_s is None else (F.col("t") - F.col("at")) <= limit_s * US
    return rows.where("g = 1").select("meter", "t", F.when(fresh, F.col("last")).alias("value"))


def mean(readings: DataFrame, step_s: int) -> DataFrame:
    return known(readings).groupBy("meter", bin_start(step_s).alias("t")).agg(F.avg("value").alias("value"))


def linear(readings: DataFrame, step_s: int) -> DataFrame:
    """(meter, t, value): linear in time between the samples around each grid instant, the nearest one at the borders."""
    samples = known(readings).select("meter", "t", "value", F.lit(0).alias("g")).groupBy("meter", "t", "g").agg(F.avg("value").alias("value"))
    points = grid(readings, step_s).select("meter", "t", F.lit(1).alias("g"), F.lit(None).cast("double").alias("value"))
    w = Window.partitionBy("meter").orderBy("t", "g")
    # the next sample is the last one of the order turned round: both frames grow row by row
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    turned = Window.partitionBy("meter").orderBy(F.desc("t"), F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("g") == 0, F.struct("t", "value"))
    rows = samples.unionByName(points).withColumn("p", F.last(at, True).over(back)).withColumn("n", F.last(at, True).over(turned)).where("g = 1")
    share = (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))
    value = F.when(F.col("p").isNull(), F.col("n.value")).when(F.col("n").isNull() | (F.col("p.t") == F.col("t")), F.col("p.value")).otherwise(F.col("p.value") + share * (F.col("n.value") - F.col("p.value")))
    return rows.select("meter", "t", value.alias("value"))


def time_weighted(readings: DataFrame, step_s: int) -> DataFrame:
    """(meter, t, value): the mean of the step function over each bin that it covers, weighted by time."""
    step = step_s * US
    rows = known(readings).withColumn("next", F.lead("t").over(in_order())).where("next > t")
    rows = rows.withColumns({"_from": F.expr(f"t - pmod(t, {step})"), "_to": F.expr(f"next - 1 - pmod(next - 1, {step})")})
    rows = steps(rows, "_from", "_to", step, "b")
    span = F.least("next", F.col("b") + step) - F.greatest("t", "b")
    return rows.withColumn("s", span).groupBy("meter", F.col("b").alias("t")).agg((F.sum(F.col("value") * F.col("s")) / F.sum("s")).alias("value"))


def group_load(grids: DataFrame, averaged: bool = False) -> DataFrame:
    """(t, value): null-aware sum over meters (voltages and the like are averaged)."""
    return grids.groupBy("t").agg((F.avg("value") if averaged else F.sum("value")).alias("value"), F.count("value").alias("meters"))


def meters_pivot(grids: DataFrame, meters: list) -> DataFrame:
    return grids.where(F.col("meter").isin(meters)).groupBy("t").pivot("meter", meters).agg(F.sum("value"))


def align(master: DataFrame, slave: DataFrame) -> DataFrame:
    """(meter, t, master, slave) on shared grid instants where both are known."""
    a = master.select("meter", "t", F.col("value").alias("master"))
    b = slave.select("meter", "t", F.col("value").alias("slave"))
    return a.join(b, ["meter", "t"]).where("master is not null and slave is not null")


def downsample(readings: DataFrame, width: int) -> DataFrame:
    """(meter, t, value, low, high): at most `width` + 1 bins over each meter's own span, the bin's mean and extremes; a bin is a whole number of seconds, one at least."""
    span = known(readings).groupBy("meter").agg(F.min("t").alias("_from"), F.greatest(F.lit(1.0), F.rint((F.max("t") - F.min("t")) / US / width)).alias("_step"))
    step = (F.col("_step") * US).cast("long")
    rows = known(readings).join(span, "meter").withColumn("_bin", (F.col("_from") + F.floor((F.col("t") - F.col("_from")) / step) * step).cast("long"))
    return rows.groupBy("meter", F.col("_bin").alias("t")).agg(F.avg("value").alias("value"), F.min("value").alias("low"), F.max("value").alias("high"))


def spectrum(grid: DataFrame, samples: int) -> DataFrame:
    """(meter, part, k, magnitude) of a gap-free grid: the Fourier magnitudes 0..samples/2 of each `samples` consecutive values; a last part of fewer is left out, nulls count as 0.

    Parts are cut by row number, so a task holds one part at a time however long a series is.
    """
    order = Window.partitionBy("meter").orderBy("t")
    rows = grid.withColumn("_n", F.row_number().over(order) - 1).select("meter", F.expr(f"_n div {samples}").alias("part"), (F.col("_n") % samples).alias("_k"), F.coalesce("value", F.lit(0.0)).alias("value"))
    packed = rows.groupBy("meter", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda x: x["value"]).alias("v")).where(F.size("v") == samples)

    def run(batches):
        for b in batches:
            found = np.abs(np.fft.rfft(np.stack(b["v"].to_numpy()), axis=1)) if len(b) else np.zeros((0, 1))
            yield pd.DataFrame({"meter": b["meter"], "part": b["part"], "m": list(found)})

    found = packed.mapInPandas(run, f"meter {dict(grid.dtypes)['meter']}, part long, m array<double>")
    return found.select("meter", "part", F.posexplode("m").alias("k", "magnitude"))


def sliding(readings: DataFrame, length_s: int, step_s: int) -> DataFrame:
    """(meter, t, value, n): mean and number of the known readings in each window of length_s that begins at a multiple of step_s."""
    step, count = step_s * US, -(-length_s // step_s)
    start = F.expr(f"t - pmod(t, {step})")
    rows = known(readings).withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: start - k * step))).where(F.col("t") < F.col("_at") + length_s * US)
    return rows.groupBy("meter", F.col("_at").alias("t")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def session_totals(readings: DataFrame, gap_s: int) -> DataFrame:
    """(meter, start, end, n, total) of sessions that a gap of more than gap_s ends; the end is the last reading's time."""
    order = Window.partitionBy("meter").orderBy("t", "id")
    new = F.when(F.col("t") - F.lag("t").over(order) <= gap_s * US, 0).otherwise(1)
    rows = known(readings).withColumn("_new", new).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("meter", "_s").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.sum("value").alias("total")).drop("_s")


def align_in_good(master: DataFrame, slave: DataFrame, step_s: int, good: DataFrame) -> DataFrame:
    """(meter, t, master, slave) on a grid, both as means of their bins, within the master's good sections (gaps up to one step closed); either may be null, not both."""
    a = mean(master, step_s).withColumnRenamed("value", "master")
    b = mean(slave, step_s).withColumnRenamed("value", "slave")
    both = a.join(b, ["meter", "t"], "full")
    return within(both, merge_gaps(good, step_s))


def nearest(values: Column, x: Column) -> Column:
    """The element of an array nearest to x; of two the larger."""
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - x).alias("d"), (-v).alias("o"), v.alias("v"))))["v"]
