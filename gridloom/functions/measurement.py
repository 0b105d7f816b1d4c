"""Measurements: physical quantities and AC types, which of them a meter has, and series of the wanted ones.

`measurements` are rows (building, meter, physical_quantity, ac_type); readings have the same columns and t and value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that are known, AC types by preference.
AC_TYPES = ["active", "apparent", "reactive"]
QUANTITIES = ["power", "energy", "cumulative energy", "voltage", "current", "frequency", "power factor", "state", "phase angle", "total harmonic distortion", "temperature"]
KEYS = ["building", "meter"]


class MeasurementError(ValueError):
    """What was asked for isn't measured."""


def check_ac_type(*names: str) -> None:
    for n in names:
        if n not in AC_TYPES:
            raise ValueError(f"unknown AC type {n!r}; one of {AC_TYPES}")


def check_quantity(*names: str) -> None:
    for n in names:
        if n not in QUANTITIES:
            raise ValueError(f"unknown physical quantity {n!r}; one of {QUANTITIES}")


def _listed(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def available(measurements: DataFrame, column: str, **where: str) -> DataFrame:
    """(building, meter, column) of what each meter has, `where` another column has a value."""
    rows = measurements
    for c, v in where.items():
        rows = rows.where(F.col(c) == v)
    return rows.where(F.coalesce(F.col(column), F.lit("")) != "").select(*KEYS, column).distinct()


def shared(measurements: DataFrame, column: str, **where: str) -> DataFrame:
    """(column) that every meter has."""
    every = measurements.select(*KEYS).distinct().agg(F.count("*").alias("_all"))
    each = available(measurements, column, **where).groupBy(column).agg(F.count("*").alias("_n"))
    return each.join(F.broadcast(every), F.col("_n") == F.col("_all")).select(column)  # one row


def preference(ac_type: Column | str = "ac_type") -> Column:
    """The rank of an AC type, from 0; null for another."""
    return F.try_element_at(F.create_map(*(x for i, n in enumerate(AC_TYPES) for x in (F.lit(n), F.lit(i)))), F.col(ac_type) if isinstance(ac_type, str) else ac_type)


def best_ac_type(measurements: DataFrame, quantity: str = "power", mains: Sequence[str] | None = None) -> DataFrame:
    """(building, meter, ac_type): the first of active, apparent and reactive that a meter has; of the mains' types, if it has any of them."""
    rows = available(measurements, "ac_type", physical_quantity=quantity).withColumn("_rank", preference()).where("_rank is not null")
    own = F.col("ac_type").isin(list(mains)) if mains is not None else F.lit(True)
    return rows.groupBy(*KEYS).agg(F.min_by("ac_type", F.struct((~own).alias("other"), "_rank")).alias("ac_type"))


def resolved(measurements: DataFrame, physical_quantity=None, ac_type=None, columns: Sequence[tuple[str, str]] | None = None, mains: Sequence[str] | None = None) -> DataFrame:
    """The rows of `measurements` that are asked for.

    Given are columns (quantity, type) alone, or quantities and types (one, several, or `best`); no answer at all, or an asked
    quantity, type or column that no meter has, raises MeasurementError.
    """
    if columns is not None:
        if physical_quantity or ac_type:
            raise ValueError("give columns, or a quantity and an AC type")
        wanted = measurements.sparkSession.createDataFrame(list(columns), "physical_quantity string, ac_type string")
        rows = measurements.join(F.broadcast(wanted), ["physical_quantity", "ac_type"], "left_semi")
        have = {tuple(r) for r in rows.select("physical_quantity", "ac_type").distinct().collect()}  # as many as were asked for
        missing = [c for c in columns if tuple(c) not in have]
    else:
        quantities, types = _listed(physical_quantity), [t for t in _listed(ac_type) if t != "best"]
        check_quantity(*quantities)
        check_ac_type(*types)
        rows = measurements.where(F.col("physical_quantity").isin(quantities)) if quantities else measurements
        rows = rows.where(F.col("ac_type").isin(types)) if types else rows
        if ac_type == "best":
            rank = F.struct((~F.col("ac_type").isin(list(mains)) if mains is not None else F.lit(False)).alias("other"), preference().alias("rank"))
            best = rows.where(preference().isNotNull()).groupBy(*KEYS, "physical_quantity").agg(F.min_by("ac_type", rank).alias("ac_type"))
            rows = rows.join(best, [*KEYS, "physical_quantity", "ac_type"], "left_semi")
        have = {x for r in rows.select("physical_quantity", "ac_type").distinct().collect() for x in r}  # a few names
        missing = [x for x in quantities + types if x not in have]
    if missing or not have:
        raise MeasurementError(f"not measured: {missing or 'nothing fits'}")
    return rows.select(*measurements.columns)


def load(readings: DataFrame, measurements: DataFrame, **wanted) -> DataFrame:
    """The readings of what `resolved` gives for the same arguments."""
    return readings.join(F.broadcast(resolved(measurements, **wanted).select(*KEYS, "physical_quantity", "ac_type").distinct()), [*KEYS, "physical_quantity", "ac_type"], "left_semi")  # a row a column of a meter


def series(readings: DataFrame, measurements: DataFrame, physical_quantity: str = "power", **wanted) -> DataFrame:
    """(building, meter, t, value): the sum over the AC types of one quantity at each instant."""
    rows = load(readings, measurements, physical_quantity=physical_quantity, **wanted)
    return rows.groupBy(*KEYS, "t").agg(F.sum("value").alias("value"))


def power_series(readings: DataFrame, measurements: DataFrame, ac_type="best", **wanted) -> DataFrame:
    return series(readings, measurements, "power", ac_type=ac_type, **wanted)


def prepared(readings: DataFrame, measurements: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]] = (), **wanted) -> DataFrame:
    """The readings of what `resolved` gives, through a chain of steps, each a function from readings to readings (as clipping, resampling, repair)."""
    rows = load(readings, measurements, **wanted)
    for step in steps:
        rows = rows.transform(step)
    return rows
