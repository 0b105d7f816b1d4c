"""Readers of public load data sets: each a Spark reader, a rename map and the readings schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.resample import steps
from gridloom.operators.sections import US

_OUT = ["dataset", "building", "meter", "ts", "physical_quantity", "ac_type", "value"]


def _shaped(df: DataFrame, dataset: str, quantity: str = "power", ac: str | None = "active") -> DataFrame:
    extra = {"dataset": F.lit(dataset)} | ({} if "physical_quantity" in df.columns else {"physical_quantity": F.lit(quantity)}) | ({} if "ac_type" in df.columns else {"ac_type": F.lit(ac)})
    return df.withColumns(extra).select(*_OUT)


def redd(spark: SparkSession, path: str) -> DataFrame:
    """house_<n>/channel_<k>.dat: epoch seconds and watts; the first two channels are apparent, the others active."""
    rows = spark.read.schema("s double, value double").csv(f"{path}/house_*/channel_*.dat", sep=" ").withColumn("f", F.input_file_name())
    rows = rows.select(F.regexp_extract("f", r"house_(\d+)", 1).cast("int").alias("building"), F.regexp_extract("f", r"channel_(\d+)", 1).cast("int").alias("meter"), F.timestamp_seconds("s").alias("ts"), "value")
    return _shaped(rows.withColumn("ac_type", F.when(F.col("meter") <= 2, "apparent").otherwise("active")), "REDD")


def ukdale(spark: SparkSession, path: str, types: dict[tuple[int, int], str], mains_meter: int = 54) -> DataFrame:
    """house_<n>/channel_<k>.dat: epoch seconds and watts, of the AC type that the metadata name (`types` by house and channel, else active), and house_<n>/mains.dat: a second's active and apparent power and voltage, which become one meter more."""
    rows = spark.read.schema("s double, value double").csv(f"{path}/house_*/channel_*.dat", sep=" ").withColumn("f", F.input_file_name())
    rows = rows.select(F.regexp_extract("f", r"house_(\d+)", 1).cast("int").alias("building"), F.regexp_extract("f", r"channel_(\d+)", 1).cast("int").alias("meter"), F.timestamp_seconds("s").alias("ts"), "value")
    kind = F.lit("active")
    for (b, m), ac in types.items():
        kind = F.when((F.col("building") == b) & (F.col("meter") == m), ac).otherwise(kind)
    mains = spark.read.schema("s double, active double, apparent double, voltage double").csv(f"{path}/house_*/mains.dat", sep=" ").withColumn("f", F.input_file_name())
    long = mains.select(F.regexp_extract("f", r"house_(\d+)", 1).cast("int").alias("building"), F.lit(mains_meter).alias("meter"), F.timestamp_seconds("s").alias("ts"), "active", "apparent", "voltage").unpivot(["building", "meter", "ts"], ["active", "apparent", "voltage"], "_c", "value")
    power = F.col("_c") != "voltage"
    long = long.select("building", "meter", "ts", F.when(power, "power").otherwise("voltage").alias("physical_quantity"), F.when(power, F.col("_c")).alias("ac_type"), "value")
    return _shaped(rows.withColumn("ac_type", kind), "UK-DALE").unionByName(_shaped(long, "UK-DALE"))


def wide_csv(spark: SparkSession, path: str, dataset: str, time_col: str, columns: dict[str, int], building_pattern: str = r"(\d+)\.csv", epoch: bool = True) -> DataFrame:
    """One column a meter, one file a building (as REFIT has them)."""
    rows = spark.read.csv(path, header=True, inferSchema=False).withColumn("_f", F.input_file_name())
    t = F.timestamp_seconds(F.col(time_col).cast("double")) if epoch else F.to_timestamp(time_col)
    rows = rows.select(F.regexp_extract("_f", building_pattern, 1).cast("int").alias("building"), t.alias("ts"), *(F.col(c).cast("double").alias(str(m)) for c, m in columns.items()))
    long = rows.unpivot(["building", "ts"], [str(m) for m in columns.values()], "meter", "value").withColumn("meter", F.col("meter").cast("int"))
    return _shaped(long, dataset)


def per_meter_csv(spark: SparkSession, path: str, dataset: str, columns: dict[str, tuple[str, str | None]], time_col: str, null: str = "", millis: bool = False) -> DataFrame:
    """One file a meter, one column a measurement; `<building>/<meter>.csv`; repeated instants keep the first row by value."""
    rows = spark.read.csv(path, header=True, nullValue=null).withColumn("_f", F.input_file_name())
    t = F.timestamp_millis(F.col(time_col).cast("long")) if millis else F.timestamp_seconds(F.col(time_col).cast("double"))
    base = rows.select(F.regexp_extract("_f", r"(\d+)/\d+\.csv", 1).cast("int").alias("building"), F.regexp_extract("_f", r"(\d+)\.csv", 1).cast("int").alias("meter"), t.alias("ts"), *(F.col(c).cast("double") for c in columns))
    long = base.unpivot(["building", "meter", "ts"], list(columns), "_c", "value")
    names = F.create_map(*(x for c, (q, _) in columns.items() for x in (F.lit(c), F.lit(q))))
    types = F.create_map(*(x for c, (_, a) in columns.items() for x in (F.lit(c), F.lit(a))))
    long = long.withColumn("physical_quantity", names[F.col("_c")]).withColumn("ac_type", types[F.col("_c")]).groupBy("building", "meter", "ts", "physical_quantity", "ac_type").agg(F.min("value").alias("value"))
    return _shaped(long, dataset)


def per_attribute_csv(spark: SparkSession, path: str, dataset: str, columns: dict[str, tuple[str, str | None]], buildings: dict[str, int] | None = None) -> DataFrame:
    """One file an attribute, `<building>/<meter>/<attribute>.csv` of lines `milliseconds,value` (as COMBED has them).

    As rows the attributes of a meter need no joining: an instant that one file lacks has no row of it. Files of attributes that aren't in
    `columns` are not read on, nor are lines without an instant or a value. `buildings` gives the numbers of buildings with names (others are left out); a
    line that stands twice counts once, and of different values at one instant the least.
    """
    rows = spark.read.schema("_ms string, _v string").csv(f"{path}/*/*/*.csv").withColumn("_f", F.input_file_name())
    pick = lambda part: F.regexp_extract("_f", r"([^/]+)/(\d+)/([^/]+)\.csv", part)
    number = F.create_map(*(F.lit(x) for pair in buildings.items() for x in pair))[pick(1)] if buildings else pick(1).try_cast("int")
    named = rows.select(number.cast("int").alias("building"), pick(2).cast("int").alias("meter"), pick(3).alias("_c"), F.timestamp_millis(F.col("_ms").try_cast("double").cast("long")).alias("ts"), F.col("_v").try_cast("double").alias("value"))
    of = lambda k: F.create_map(*(x for c, pair in columns.items() for x in (F.lit(c), F.lit(pair[k]).cast("string"))))[F.col("_c")]
    some = named.where(F.col("_c").isin(list(columns))).where("building is not null and ts is not null and value is not null and not isnan(value)")
    once = some.withColumns({"physical_quantity": of(0), "ac_type": of(1)}).groupBy("building", "meter", "ts", "physical_quantity", "ac_type").agg(F.min("value").alias("value"))
    return _shaped(once, dataset)


def reactive(active: str, phase: str):
    """Reactive power from active power and the phase angle in degrees."""
    return F.col(active) * F.tan(F.radians(phase))


def positional_days(spark: SparkSession, path: str, dataset: str, columns: dict[int, tuple[str, str | None]], missing: float = -1.0) -> DataFrame:
    """Day files `<building>/<meter>/<yyyy-mm-dd>.csv` of one line a second without a time column (as ECO has them).

    A line's second is its number in the file, so a file is read whole by one task: 86400 lines at most. `columns` maps a
    column's place to (physical quantity, AC type). Power that reads `missing` is dropped.
    """
    files = spark.read.text(f"{path}/*/*/*.csv", wholetext=True).withColumn("_f", F.input_file_name())
    pick = lambda part: F.regexp_extract("_f", r"(\d+)/(\d+)/(\d{4}-\d{2}-\d{2})\.csv", part)
    lines = files.select(pick(1).cast("int").alias("building"), pick(2).cast("int").alias("meter"), pick(3).cast("timestamp").alias("_day"), F.posexplode(F.split("value", r"\r?\n")).alias("_s", "_line")).where("_line <> ''")
    values = F.array(*(F.struct(F.lit(q).alias("physical_quantity"), F.lit(ac).cast("string").alias("ac_type"), F.get(F.split("_line", ","), F.lit(k)).try_cast("double").alias("value")) for k, (q, ac) in columns.items()))
    rows = lines.select("building", "meter", F.timestamp_seconds(F.unix_seconds("_day") + F.col("_s")).alias("ts"), F.explode(values).alias("v")).select("building", "meter", "ts", "v.*")
    return _shaped(rows.where(F.col("value").isNotNull() & ((F.col("physical_quantity") != "power") | (F.col("value") != missing))), dataset)


def coded_long(spark: SparkSession, path: str, dataset: str, lookup: DataFrame, scale: float = 10.0) -> DataFrame:
    """Long CSV of (household, appliance code, date, time, data) and a lookup (building, code, meter), as HES has them: tenths of Wh, grouped by house."""
    rows = spark.read.schema("building int, code int, day string, time string, data double").csv(path).join(lookup, ["building", "code"])
    return _shaped(rows.select("building", "meter", F.to_timestamp(F.concat_ws(" ", "day", "time")).alias("ts"), (F.col("data") * scale).alias("value")), dataset, "energy")


def filled_minutes(rows: DataFrame) -> DataFrame:
    """One-minute means of readings on each series' gap-free grid (as iAWE is cleaned): of equal instants the smallest value counts; missing power is 0, any other quantity its median."""
    keys = ["dataset", "building", "meter", "physical_quantity", "ac_type"]
    rows = rows.withColumn("ac_type", F.coalesce("ac_type", F.lit(""))).where(F.col("value").isNotNull() & ~F.isnan("value"))
    once = rows.groupBy(*keys, "ts").agg(F.min("value").alias("value"))
    minutes = once.groupBy(*keys, F.date_trunc("minute", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    ends = minutes.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.median("value").alias("_m"))
    micros = ends.select(*keys, "_m", F.unix_micros("_a").alias("_a"), F.unix_micros("_b").alias("_b"))
    grid = steps(micros, "_a", "_b", 60 * US, "_t").select(*keys, "_m", F.timestamp_micros("_t").alias("ts"))
    value = F.coalesce("value", F.when(F.col("physical_quantity") == "power", 0.0).otherwise(F.col("_m")))
    return grid.join(minutes, [*keys, "ts"], "left").select("dataset", "building", "meter", "ts", "physical_quantity", F.nullif("ac_type", F.lit("")).alias("ac_type"), value.alias("value"))


def from_database(spark: SparkSession, url: str, table: str, dataset: str, columns: dict[str, int], low: int, high: int, parts: int, options: dict[str, str] | None = None) -> DataFrame:
    """A database table of (dataid, localminute, one column a meter in kW), read in ranges of dataid; watts."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="dataid", lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **(options or {})).load()
    wide = rows.select(F.col("dataid").cast("int").alias("building"), F.col("localminute").cast("timestamp").alias("ts"), *((F.col(c).cast("double") * 1000).alias(str(m)) for c, m in columns.items()))
    return _shaped(wide.unpivot(["building", "ts"], [str(m) for m in columns.values()], "meter", "value").where("value is not null").withColumn("meter", F.col("meter").cast("int")), dataset)


def block_csv(spark: SparkSession, path: str, dataset: str, meters: dict[str, int]) -> DataFrame:
    """`building<n>/<file>.csv` whose blocks each begin with a header of their own, `timestamp` and device names (as GREEND has them).

    A header may follow the rest of a broken line, which is lost. NUL characters go; a line with a broken time, or with more
    fields than its header, counts as far as it can be read; lines before the first header and unknown devices don't count.
    Of readings of a device at one instant the smallest counts. A file, a day of one building, is read whole by one task.
    """
    files = spark.read.text(f"{path}/building*/*.csv", wholetext=True).withColumn("_f", F.input_file_name())
    lines = files.select(F.regexp_extract("_f", r"building(\d+)", 1).cast("int").alias("building"), "_f", F.posexplode(F.split(F.translate("value", "\0", ""), r"\r?\n")).alias("_n", "_line"))
    head = F.when(F.instr("_line", "timestamp") > 0, F.expr("substring(_line, instr(_line, 'timestamp'))"))
    headed = lines.withColumn("_head", F.last(head, True).over(Window.partitionBy("_f").orderBy("_n"))).where(head.isNull() & F.col("_head").isNotNull() & (F.col("_line") != ""))
    names, values = F.split(F.trim("_head"), ","), F.split(F.trim("_line"), ",")
    pairs = F.filter(F.arrays_zip(names.alias("name"), values.alias("text")), lambda p: p["name"].isNotNull() & p["text"].isNotNull())
    known = F.create_map(*(F.lit(x) for item in meters.items() for x in item))
    long = headed.select("building", F.get(values, F.lit(0)).try_cast("double").alias("_s"), F.explode(F.slice(pairs, F.lit(2), F.greatest(F.size(pairs) - 1, F.lit(0)))).alias("p"))
    rows = long.select("building", known[F.trim("p.name")].alias("meter"), F.timestamp_seconds("_s").alias("ts"), F.trim("p.text").try_cast("double").alias("value")).where("meter is not null and ts is not null and value is not null and not isnan(value)")
    return _shaped(rows.groupBy("building", "meter", "ts").agg(F.min("value").alias("value")), dataset)
