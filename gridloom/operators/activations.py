"""Switches and activations: islands on the on-flag, then a second pass that bridges short gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.sections import US, in_order, known, running


def switch_times(readings: DataFrame, threshold: float = 40) -> DataFrame:
    rows = known(readings).withColumn("delta", F.col("value") - F.lag("value").over(in_order()))
    return rows.where(F.abs("delta") > threshold).select("meter", "t", "delta")


def simultaneous_switches(readings: DataFrame, threshold: float = 40, bin_us: int = 1, least: int = 2) -> DataFrame:
    """(t, meters): bins in which at least so many meters switch."""
    rows = switch_times(readings, threshold).select("meter", F.expr(f"t - pmod(t, {bin_us})").alias("t")).distinct()
    return rows.groupBy("t").agg(F.count("*").alias("meters")).where(F.col("meters") >= least)


def activations(readings: DataFrame, threshold: float, min_off_s: float = 0, min_on_s: float = 0) -> DataFrame:
    """(meter, start, end): a leading off and a trailing unfinished on are left out; end is the first off row."""
    on = F.coalesce(F.col("value") >= threshold, F.lit(False))
    rows = readings.withColumn("on", on).withColumn("was", F.lag("on").over(in_order()))
    edges = rows.where(F.col("was").isNotNull() & (F.col("on") != F.col("was"))).withColumn("end", F.lead("t").over(in_order()))
    runs = edges.where(F.col("on") & F.col("end").isNotNull()).select("meter", F.col("t").alias("start"), "end")
    new = F.when(F.col("start") - F.lag("end").over(in_order("start")) < int(min_off_s * US), 0).otherwise(1)
    runs = runs.withColumn("new", new).withColumn("run", F.sum("new").over(running("start")))
    found = runs.groupBy("meter", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.where(F.col("end") - F.col("start") >= int(min_on_s * US)).select("meter", "start", "end")


def bordered(readings: DataFrame, found: DataFrame, border: int = 1) -> DataFrame:
    """(meter, start, t, value): the rows of each activation with its border, without those that hold a null."""
    rows = readings.withColumn("n", F.row_number().over(in_order()) - 1)
    marks = rows.select("meter", F.col("t").alias("at"), "n").groupBy("meter", "at").agg(F.min("n").alias("n"))
    spans = found.join(marks.withColumnsRenamed({"at": "start", "n": "a"}), ["meter", "start"]).join(marks.withColumnsRenamed({"at": "end", "n": "b"}), ["meter", "end"])
    # each activation lists its row numbers, which makes the range join an equi join
    wanted = spans.select("meter", "start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - 1 - border), F.col("b") + border - 1)).alias("n"))
    out = wanted.join(rows, ["meter", "n"])
    nulls = F.max(F.col("value").isNull().cast("int")).over(Window.partitionBy("meter", "start"))
    return out.withColumn("_null", nulls).where("_null = 0").select("meter", "start", "t", "value")


def activity_script(found: DataFrame) -> DataFrame:
    rows = F.array(F.struct(F.col("start").alias("t"), F.lit(True).alias("is_start")), F.struct(F.col("end").alias("t"), F.lit(False).alias("is_start")))
    return found.select("meter", F.explode(rows).alias("e")).select("meter", "e.*")
