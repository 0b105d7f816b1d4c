"""Loads of Gaussian state machines. Draws follow from a hash of (seed, appliance, activation, event), so a seed gives the same load under any partitioning."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Per appliance its events ((watt, spike, seconds), (their deviations)) and its breaks (activations a batch, minutes, deviation).
MACHINES = {
    "Heater1": [((2000, 20, 15), (20, 6, 10)), ((-2000, 10, 15), (10, 3, 10))],
    "Heater2": [((1500, 40, 15), (10, 6, 10)), ((-1500, 10, 15), (10, 2, 10))],
    "Fridge": [((130, 10, 90), (10, 5, 30)), ((-130, 10, 300), (10, 6, 50))],
    "Lamp": [((80, 0, 14400), (10, 0.01, 7200)), ((-80, 0, 10), (10, 0.01, 10))],
    "Complex 1": [((40, 0, 50), (6, 2, 10)), ((120, 0, 40), (15, 2, 10)), ((-160, 10, 200), (10, 1, 30))],
    "Complex 2": [((100, 0, 600), (10, 0.1, 80)), ((-26, 0, 180), (5, 0.1, 50)), ((-74, 5, 480), (15, 1, 50))],
    "Complex 3": [((320, 0, 120), (10, 3, 10)), ((-40, 0, 180), (5, 0.1, 50)), ((-100, 5, 480), (15, 1, 50)), ((-180, 5, 480), (15, 1, 50))],
}
BREAKS = {"Heater1": (5, 300, 10), "Heater2": (4, 600, 10), "Fridge": (7, 120, 10), "Lamp": (1, 720, 180), "Complex 1": (4, 60, 10), "Complex 2": (2, 60, 10), "Complex 3": (2, 360, 3600)}
LEAST_WATT, LEAST_SECONDS = 5.0, 5.0


def gauss(mean: float, deviation: float, *keys) -> Column:
    """A normal draw (Box and Muller) of the keys."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    u, v = ((F.shiftrightunsigned(F.xxhash64(*keys, F.lit(i)), 11) + 1) / float(1 << 53) for i in (1, 2))
    return mean + deviation * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def _machine(spark: SparkSession, meter: int, name: str, duration_s: float, seed: int) -> DataFrame:
    events, (each, pause, spread) = MACHINES[name], BREAKS[name]
    batches = int(duration_s // (sum(e[0][2] for e in events) * each + pause * 60))
    draw = [[gauss(m, s, seed, meter, F.col("id"), k, part) for part, (m, s) in enumerate(zip(*e, strict=True))] for k, e in enumerate(events)]
    watts, level, total = [], F.lit(0.0), F.lit(0.0)
    for w, _, _ in draw[:-1]:  # the machine stays on until its last event, which takes it back to nothing
        level = level + w
        watts.append(w + F.greatest(LEAST_WATT - level, F.lit(0.0)))
        total = total + watts[-1]
    watts.append(-total)
    rest = F.when(F.col("id") % each == each - 1, gauss(pause, spread, seed, meter, F.col("id"), "pause") * 60).otherwise(0.0)
    waits = [d[2] + (rest if k + 1 == len(draw) else 0.0) for k, d in enumerate(draw)]
    rows = F.array(*(F.struct(w.alias("transition"), d[1].alias("spike"), F.greatest(wait, F.lit(LEAST_SECONDS)).alias("wait")) for w, d, wait in zip(watts, draw, waits, strict=True)))
    return spark.range(batches * each).select(F.lit(meter).alias("meter"), F.lit(name).alias("appliance"), "id", F.posexplode(rows).alias("event", "e")).select("meter", "appliance", "id", "event", "e.*")


def transients(spark: SparkSession, duration_s: float = 8_640_000, seed: int = 0) -> DataFrame:
    """(meter, appliance, t, transition, spike, signature); t in microseconds. Meters are numbered from 2, as 1 is the mains."""
    rows = reduce(DataFrame.unionByName, (_machine(spark, k + 2, name, duration_s, seed) for k, name in enumerate(MACHINES)))
    before = Window.partitionBy("meter").orderBy("id", "event").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("meter") - 2 + F.coalesce(F.sum("wait").over(before), F.lit(0.0))
    sign = F.when(F.col("transition") < 0, -1).otherwise(1)
    return rows.select("meter", "appliance", F.rint(at * 1_000_000).cast("long").alias("t"), "transition", "spike", (F.col("transition") + sign * F.col("spike")).alias("signature"))


def steps(found: DataFrame) -> DataFrame:
    """(meter, t, value): the load of each meter after each transition."""
    order = Window.partitionBy("meter").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("meter", "t", F.sum("transition").over(order).alias("value"))


def predefined(states: DataFrame, start_us: int, step_s: int = 3600) -> DataFrame:
    """(meter, appliance, t, value) of a table with a column `step` (0, 1, ...) and one an appliance: each step lasts step_s; meters are numbered from 2 in the columns' order."""
    names = [c for c in states.columns if c != "step"]
    number = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k + 2))))
    long = states.select("step", *(F.col(f"`{n}`").cast("double").alias(n) for n in names)).unpivot(["step"], [F.col(f"`{n}`") for n in names], "appliance", "value")
    return long.select(number[F.col("appliance")].alias("meter"), "appliance", (F.lit(start_us) + F.col("step") * step_s * 1_000_000).cast("long").alias("t"), "value")
