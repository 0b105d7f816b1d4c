"""Readings in Parquet or CSV folders, partitioned by dataset and building; a window is a filter on the raw ts column."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READINGS = "dataset string, building int, meter int, ts timestamp, physical_quantity string, ac_type string, value double"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied events as readings (meter, t, value, id, kind); t in microseconds, NaN as null."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("meter"), t.alias("t"), F.nanvl("value", F.lit(None).cast("double")).alias("value"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))


def load(spark: SparkSession, path: str, fmt: str = "parquet", start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    reader = spark.read.schema(READINGS) if fmt == "csv" else spark.read
    rows = reader.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)
    rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start else rows
    rows = rows.where(F.col("ts") < F.lit(end).cast("timestamp")) if end else rows
    return rows.select(*columns) if columns else rows


def save(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    rows.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).mode(mode).partitionBy("dataset", "building").save(path)


def timeframe(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset", "building", "meter").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


def row_count(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(dataset, building, meter, n) of the rows in a window, the end exclusive."""
    rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp")) if start else rows
    rows = rows.where(F.col("ts") < F.lit(end).cast("timestamp")) if end else rows
    return rows.groupBy("dataset", "building", "meter").agg(F.count("*").alias("n"))


def has_columns(rows: DataFrame, columns: list[str]) -> bool:
    return set(columns) <= set(rows.columns)


def memory_bytes(n: int, columns: int) -> int:
    """What so many rows take in memory: four bytes a value and eight a timestamp."""
    return n * (4 * columns + 8)


def check_memory(n: int, columns: int, most: int) -> None:
    """For rows that are to be collected; MemoryError beyond the limit."""
    if memory_bytes(n, columns) > most:
        raise MemoryError(f"{memory_bytes(n, columns)} bytes; at most {most} are allowed")


def first_of_each(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row a (meter, t): the first in the given order."""
    n = F.row_number().over(Window.partitionBy("meter", "t").orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def convert(spark: SparkSession, source: str, target: str, source_fmt: str, target_fmt: str) -> None:
    save(load(spark, source, source_fmt), target, target_fmt, "overwrite")


def key(building: int, meter: int) -> str:
    return f"/building{building}/elec/meter{meter}"


def parse_key(column: str) -> tuple:
    return F.regexp_extract(column, r"/building(\d+)", 1).cast("int").alias("building"), F.regexp_extract(column, r"/meter(\d+)", 1).cast("int").alias("meter")


def schema() -> StructType:
    return StructType.fromDDL(READINGS)


def load_sections(rows: DataFrame, sections: DataFrame, look_ahead: int = 0) -> DataFrame:
    """Rows of (meter, t) inside any of the sections (meter, start, end), the end exclusive; overlapping sections don't repeat rows.

    With look_ahead, each row also carries `ahead_1` ... the next values of its meter, whether or not they lie in a section.
    Sections and rows meet in one ordered pass a meter, so a meter of many sections doesn't multiply its rows.
    """
    order = Window.partitionBy("meter").orderBy("t", "_kind")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    if look_ahead:
        ahead = Window.partitionBy("meter").orderBy("t")
        rows = rows.withColumns({f"ahead_{k}": F.lead("value", k).over(ahead) for k in range(1, look_ahead + 1)})
    marks = sections.where("start < end").select("meter", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("_step")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("_step")))).alias("m")).select("meter", "m.t", "m._step")
    both = rows.withColumns({"_step": F.lit(0), "_kind": F.lit(1)}).unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("_open", F.sum("_step").over(seen)).where("_kind = 1 and _open > 0").select(*rows.columns)


KEY = ["dataset", "building", "meter"]
SPANS = "_spans"  # beside the readings; readers skip names with an underscore


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _write_keys(rows: DataFrame, path: str, fmt: str, mode: str) -> None:
    options = {"partitionOverwriteMode": "dynamic"} | ({"header": "true"} if fmt == "csv" else {})
    rows.write.format(fmt).options(**options).mode(mode).partitionBy(*KEY).save(path)


def spans(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, building, meter, start, end) of everything that was put or appended to a keyed store, a row a write."""
    return spark.read.schema("start timestamp, end timestamp, dataset string, building int, meter int").parquet(f"{path}/{SPANS}").select(*KEY, "start", "end")


def put(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Readings that replace those of their meters in a keyed store (a folder a meter); the files of all other meters stay as they are.

    Rows without a time raise ValueError, no rows do nothing. The readings are written first, then their spans: after a failure between the two, put again.
    """
    found = timeframe(rows)
    if found.where("start is null").limit(1).count() or rows.where("ts is null").limit(1).count():
        raise ValueError("a reading without a time")
    if not found.limit(1).count():
        return
    _write_keys(rows, path, fmt, "overwrite")
    _write_keys(found, f"{path}/{SPANS}", "parquet", "overwrite")


def append(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Readings added to a keyed store. If their span overlaps one of their meter that is there, or touches its end, nothing is written: ValueError."""
    spark, found = rows.sparkSession, timeframe(rows)
    if rows.where("ts is null").limit(1).count():
        raise ValueError("a reading without a time")
    if not found.limit(1).count():
        return
    if _there(spark, f"{path}/{SPANS}"):
        old = spans(spark, path).withColumnsRenamed({"start": "_from", "end": "_to"})
        clash = found.join(old, KEY).where("start <= _to and end >= _from").select(*KEY, "start").first()
        if clash:
            raise ValueError(f"meter {clash.meter} of building {clash.building} has readings at {clash.start} already")
    _write_keys(rows, path, fmt, "append")
    _write_keys(found, f"{path}/{SPANS}", "parquet", "append")


def remove(spark: SparkSession, path: str, dataset: str, building: int) -> bool:
    """Delete one building's partition of a store; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dataset={dataset}/building={int(building)}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def children(rows: DataFrame, building: int | None = None) -> DataFrame:
    """The buildings of a store, or the meters of one building."""
    return rows.select("dataset", "building").distinct() if building is None else rows.where(F.col("building") == building).select("dataset", "building", "meter").distinct()


def with_external(rows: DataFrame, external: DataFrame, on: str, columns: list[str], bucket_us: int = 86_400_000_000) -> DataFrame:
    """External columns (as weather by zip code) at each row's instant t: the last known value of the place, before the first one the next.

    Of several known values at one instant the largest counts; a row without an instant takes the first. A place without
    external rows gives nulls; null is a place like others. The external table is filled by itself; rows meet it by place and
    bucket, where a row carries in what was known before, so the rows of a place are not ordered in one task.
    """
    start = (F.col("t") - F.pmod("t", F.lit(bucket_us))).alias("_from")
    kinds = dict(external.dtypes)
    once = external.where("t is not null").groupBy(on, "t").agg(*(F.max(c).alias(c) for c in columns))
    place = Window.partitionBy(on).orderBy("t")
    back, forth = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(0, Window.unboundedFollowing)
    filled = once.select(on, "t", start, F.struct(*(F.coalesce(F.last(c, True).over(back), F.first(c, True).over(forth)).alias(c) for c in columns)).alias("_was"))
    ends = filled.groupBy(on, "_from").agg(F.min_by("_was", "t").alias("_head"), F.max_by("_was", "t").alias("_tail"))
    asked = rows.select(on, start).distinct().unionByName(ends, allowMissingColumns=True).groupBy(on, "_from").agg(F.first("_head", True).alias("_head"), F.first("_tail", True).alias("_tail"))
    buckets = Window.partitionBy(on).orderBy("_from")
    whole = buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = F.coalesce(F.last("_tail", True).over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.first("_head", True).over(whole))
    known = asked.select(on, (F.col("_from") - 1).alias("t"), "_from", carried.alias("_was")).unionByName(filled).withColumn("_own", F.lit(False))
    own = rows.drop(*columns)
    both = own.withColumns({"_from": start, "_own": F.lit(True)}).unionByName(known, allowMissingColumns=True)
    upto = Window.partitionBy(on, "_from").orderBy("t", "_own").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_was", F.last("_was", True).over(upto)).where("_own")
    return found.select(*own.columns, *(F.col("_was")[c].cast(kinds[c]).alias(c) for c in columns))


def predictions(wide: DataFrame, dataset: str, building: int, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Readings and meter rows of a disaggregation (meter, t, a column a device): device k of `names` is meter k + 2, below meter 1, which stands for the mains."""
    number = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k + 2))))
    long = wide.select("t", *(F.col(f"`{n}`").cast("double").alias(n) for n in names)).unpivot(["t"], [F.col(f"`{n}`") for n in names], "_device", "value")
    rows = long.select(F.lit(dataset).alias("dataset"), F.lit(building).alias("building"), number[F.col("_device")].alias("meter"), F.timestamp_micros("t").alias("ts"), F.lit("power").alias("physical_quantity"), F.lit("active").alias("ac_type"), "value")
    meters = [(building, 1, None, True, None, key(building, 1), False)] + [(building, k + 2, n, False, 1, key(building, k + 2), False) for k, n in enumerate(names)]
    return rows, wide.sparkSession.createDataFrame(meters, "building int, meter int, device_model string, site_meter boolean, submeter_of int, data_location string, disabled boolean")


def _listed(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(by, folder, mark) of each of a store's files; the mark is a hash of its name, length and time. No file is opened."""
    kinds = {f.name: f.dataType for f in schema().fields}
    files = spark.read.format("binaryFile").option("basePath", path).load(path)
    return files.select(*(F.col(c).cast(kinds[c]).alias(c) for c in by), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.xxhash64("path", "length", "modificationTime").alias("mark"))


def marks(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """(by, _mark): one fingerprint for all files of a part of a store."""
    each = _listed(spark, path, by).groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor("mark").alias("x"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("s"))
    return each.select(*by, F.xxhash64(*by, "n", "x", "s").alias("_mark"))


def cached(spark: SparkSession, path: str, name: str, make: Callable[[DataFrame], DataFrame], fmt: str = "parquet", by: Sequence[str] = ("dataset", "building")) -> DataFrame:
    """The statistic `name` of the parts of a store: `make` of the readings, whose rows carry the columns `by`; each of its rows may depend on its own part alone.

    Results are kept beside the readings under the fingerprint of their part. Only parts whose files are new or changed
    since are read and made anew, parts that are gone give no rows. A failure between rows and fingerprints has these parts made again in place.
    """
    by = list(by)
    at = f"{path.rstrip('/')}/_cache/{name}"  # readers of the store pass over names with an underscore
    now, known = marks(spark, path, by), _there(spark, f"{at}/marks/_SUCCESS")
    changed = now.join(spark.read.schema("_mark long").parquet(f"{at}/marks"), "_mark", "left_anti") if known else now
    folders = [r.folder for r in _listed(spark, path, by).join(changed, by, "left_semi").select("folder").distinct().collect()]  # fewer than the files that the driver lists for any read
    if folders or not known:
        reader = spark.read.schema(READINGS) if fmt == "csv" else spark.read
        rows = reader.format(fmt).options(basePath=path, **({"header": "true"} if fmt == "csv" else {})).load(folders or path)
        made = make(rows).join(changed, by)
        spark.createDataFrame([(made.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{at}/schema")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_mark").parquet(f"{at}/rows")
        changed.select("_mark").write.mode("append").parquet(f"{at}/marks")
    shape = StructType.fromJson(json.loads(spark.read.text(f"{at}/schema").first()[0]))
    return spark.read.schema(shape).parquet(f"{at}/rows").join(marks(spark, path, by).select("_mark"), "_mark", "left_semi").drop("_mark")


def clear_cache(spark: SparkSession, path: str, name: str | None = None) -> bool:
    """Drop one cached statistic, or all; whether there was any."""
    files, target = _files(spark, f"{path.rstrip('/')}/_cache" + (f"/{name}" if name else ""))
    return files.delete(target, True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
