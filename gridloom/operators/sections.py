"""Sections of a series by gaps and islands.

Readings are rows (meter, t, value, id): t in microseconds, id breaks ties. Sections are rows (meter, start, end), half
open. One shuffle and one sort by (meter, t) serve the lag, the running sum and the aggregate that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def in_order(*keys: str) -> Window:
    return Window.partitionBy("meter").orderBy(*(keys or ("t", "id")))


def running(*keys: str) -> Window:
    return in_order(*keys).rowsBetween(Window.unboundedPreceding, 0)


def known(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("value").isNotNull() & ~F.isnan("value"))


def good_sections(readings: DataFrame, max_gap_s: float) -> DataFrame:
    """Maximal runs of known samples with gaps of at most max_gap_s (0: no limit); single samples vanish."""
    gap = F.col("t") - F.lag("t").over(in_order())
    fine = gap.isNotNull() & ((gap <= int(max_gap_s * US)) | F.lit(max_gap_s == 0))
    rows = known(readings).withColumn("new", F.when(fine, 0).otherwise(1)).withColumn("run", F.sum("new").over(running()))
    return rows.groupBy("meter", "run").agg(F.min("t").alias("start"), F.max("t").alias("end")).where("end > start").select("meter", "start", "end")


def frequency_sections(readings: DataFrame, hertz: float) -> DataFrame:
    """Sections sampled at least so often."""
    return good_sections(readings, 1 / hertz)


def on_sections(readings: DataFrame, on: Column) -> DataFrame:
    """Runs where `on` holds, up to the first sample where it doesn't (or the last sample)."""
    rows = known(readings).withColumn("on", F.coalesce(on, F.lit(False))).withColumn("next", F.lead("t").over(in_order()))
    rows = rows.withColumn("new", F.when(F.col("on") == F.lag("on").over(in_order()), 0).otherwise(1)).withColumn("run", F.sum("new").over(running()))
    found = rows.where("on").groupBy("meter", "run").agg(F.min("t").alias("start"), F.max(F.coalesce("next", "t")).alias("end"))
    return found.where("end > start").select("meter", "start", "end")


def merge_gaps(sections: DataFrame, gap_s: float) -> DataFrame:
    """Sections whose gap is at most gap_s become one."""
    reach = F.max("end").over(in_order("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = sections.withColumn("new", F.when(F.col("start") - reach <= round(gap_s * US), 0).otherwise(1)).withColumn("run", F.sum("new").over(running("start", "end")))
    return rows.groupBy("meter", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("meter", "start", "end")


def nonzero_sections(readings: DataFrame, gap_s: float = 2.3) -> DataFrame:
    """Sections of power above 0; gaps of at most gap_s, as lost samples leave them, are closed."""
    return merge_gaps(on_sections(readings, F.col("value") > 0), gap_s)


def simplify(sections: DataFrame) -> DataFrame:
    return merge_gaps(sections, 0)


def drop_short(sections: DataFrame, least_s: float) -> DataFrame:
    return sections.where(F.col("end") - F.col("start") > int(least_s * US))


def uptime(sections: DataFrame) -> DataFrame:
    return sections.groupBy("meter").agg(F.count("*").alias("sections"), F.sum(F.col("end") - F.col("start")).alias("uptime_us"))


def gap_histogram(sections: DataFrame, edges_s: list[int]) -> DataFrame:
    """Gaps between sections of a meter by right-closed bins of seconds: (bin, gaps)."""
    gap = (F.col("start") - F.lag("end").over(in_order("start", "end"))) / US
    rows = sections.withColumn("gap", gap).where("gap is not null")
    label = F.lit(None).cast("int")
    for i in reversed(range(len(edges_s) - 1)):
        label = F.when((F.col("gap") > edges_s[i]) & (F.col("gap") <= edges_s[i + 1]), i).otherwise(label)
    return rows.withColumn("bin", label).where("bin is not null").groupBy("bin").agg(F.count("*").alias("gaps"))


def missing_phases(sections: DataFrame, phase: Column, phases: list[int]) -> DataFrame:
    """For each meter and phase whether there is any section."""
    return sections.withColumn("phase", phase).groupBy("meter").pivot("phase", phases).agg(F.count("start") > 0).na.fill(False)
