"""A data set opened once: a store of readings, its metadata and a window, which all reads share."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import intervals, sections
from gridloom.sources import metadata, store


@dataclass(frozen=True)
class DataSet:
    """Nothing is read before it is asked for. `window` and `of` give narrower handles of the same store and leave this one as it is.

    The window is a filter on ts (the end exclusive, either bound open), buildings and data sets are filters on partitions,
    so both reach the scan. Without readings in reach all results are empty.
    """

    spark: SparkSession
    path: str
    fmt: str = "parquet"
    about: str | None = None  # a folder of metadata tables, as metadata.save writes them
    start: str | None = None
    end: str | None = None
    dataset: str | None = None
    building: int | None = None
    meters_in: tuple[int, ...] | None = None

    def window(self, start: str | None = None, end: str | None = None) -> DataSet:
        """The same with this window instead; ValueError where it ends before it starts."""
        if start is not None and end is not None:
            order = self.spark.range(1).select((F.lit(start).cast("timestamp") < F.lit(end).cast("timestamp")).alias("fine")).first()
            if not order.fine:
                raise ValueError(f"the window ends at {end}, not after {start}")
        return replace(self, start=start, end=end)

    def of(self, building: int | None = None, meters: list[int] | None = None, dataset: str | None = None) -> DataSet:
        """The same for one building, some meters or one of several data sets of the store alone."""
        return replace(self, building=self.building if building is None else building, meters_in=self.meters_in if meters is None else tuple(meters), dataset=dataset or self.dataset)

    def _own(self, rows: DataFrame) -> DataFrame:
        for column, value in (("dataset", self.dataset), ("building", self.building)):
            rows = rows.where(F.col(column) == value) if value is not None and column in rows.columns else rows
        return rows.where(F.col("meter").isin(*self.meters_in)) if self.meters_in is not None and "meter" in rows.columns else rows

    def readings(self, columns: list[str] | None = None) -> DataFrame:
        found = self._own(store.load(self.spark, self.path, self.fmt, self.start, self.end))
        return found.select(*columns) if columns else found

    def series(self, quantity: str | None = None, ac_type: str | None = None) -> DataFrame:
        """Readings as (meter, t, value, id) of the operators; a meter is the struct (dataset, building, meter), id is 0."""
        rows = self.readings()
        rows = rows.where(F.col("physical_quantity") == quantity) if quantity else rows
        rows = rows.where(F.col("ac_type") == ac_type) if ac_type else rows
        return rows.select(F.struct(*store.KEY).alias("meter"), F.unix_micros("ts").alias("t"), "value", F.lit(0).alias("id"))

    def view(self, name: str) -> DataFrame:
        """Registers the readings in reach as a temporary view for SQL; a handle with another window takes another name."""
        self.readings().createOrReplaceTempView(name)
        return self.spark.table(name)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        """`meters`, `appliances` and `devices` of the metadata, those of this building alone; ValueError without metadata."""
        if self.about is None:
            raise ValueError("the data set was opened without metadata")
        return {name: self._own(found) for name, found in metadata.load(self.spark, self.about).items()}

    def buildings(self) -> DataFrame:
        return store.children(self.readings())

    def meters(self) -> DataFrame:
        return self.readings().select(*store.KEY).distinct()

    def timeframe(self) -> DataFrame:
        """(dataset, building, meter, start, end) of the readings in reach, so cut to the window."""
        return store.timeframe(self.readings())

    def groups(self) -> DataFrame:
        """(group, meter): the meters of each building as one group, for the operators that take groups."""
        return self.meters().select(F.struct("dataset", "building").alias("group"), F.struct(*store.KEY).alias("meter"))

    def good_sections(self, max_gap_s: float) -> DataFrame:
        """(dataset, building, meter, start, end) of every meter."""
        return sections.good_sections(self.series(), max_gap_s).select("meter.*", "start", "end")

    def common_sections(self, max_gap_s: float) -> DataFrame:
        """(dataset, building, start, end) where every meter of the building has good sections."""
        return intervals.common(sections.good_sections(self.series(), max_gap_s), self.groups()).select("group.*", "start", "end")

    def describe(self) -> DataFrame:
        """(dataset, building, meters, readings, known, start, end, mean) of each building and, with a null building, of each data set.

        Readings are added up a meter first; the levels are a rollup of these few rows. NaN is not known.
        """
        value = F.nanvl("value", F.lit(None).cast("double"))
        each = self.readings().groupBy(*store.KEY).agg(F.count("*").alias("n"), F.count(value).alias("k"), F.sum(value).alias("total"), F.min("ts").alias("start"), F.max("ts").alias("end"))
        found = each.rollup("dataset", "building").agg(F.grouping_id().alias("_level"), F.count("*").alias("meters"), F.sum("n").alias("readings"), F.sum("k").alias("known"), F.min("start").alias("start"), F.max("end").alias("end"), F.try_divide(F.sum("total"), F.sum("k")).alias("mean"))
        return found.where("_level < 3").drop("_level")
