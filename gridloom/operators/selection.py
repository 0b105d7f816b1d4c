"""Selection of meters and groups of meters by their metadata.

`meters` are rows (dataset, building, meter, ...), `appliances` rows (building, type, instance, meters array, ...). A group is
a table of meters, so every selection gives a group again. A key is met by an equal value, in an array by one of its elements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ["building", "meter"]


def meets(rows: DataFrame, column: str, value) -> Column:
    """Whether a column equals a value, or holds it if it is an array; a list of values means any of them."""
    if column not in rows.columns:
        raise KeyError(column)
    some = value if isinstance(value, (list, tuple, set)) else [value]
    if dict(rows.dtypes)[column].startswith("array"):
        return F.arrays_overlap(F.col(column), F.array(*(F.lit(v) for v in some)))
    return F.col(column).isin(*some)


def matching(rows: DataFrame, **keys) -> DataFrame:
    """Rows that meet all keys; a list of values is allowed for a single key only."""
    if len(keys) > 1 and any(isinstance(v, (list, tuple, set)) for v in keys.values()):
        raise ValueError("several values are for a single key")
    for c, v in keys.items():
        rows = rows.where(meets(rows, c, v))
    return rows


def _some(rows: DataFrame, keys: dict) -> DataFrame:
    if rows.isEmpty():
        raise KeyError(f"no meter with {keys}")
    return rows


def of_appliances(meters: DataFrame, appliances: DataFrame) -> DataFrame:
    """The meters that any of the appliances is on."""
    on = appliances.select("building", F.explode("meters").alias("meter"))
    return meters.join(on, ID, "left_semi")


def select(meters: DataFrame, appliances: DataFrame | None = None, **keys) -> DataFrame:
    """Meters that meet all keys, each a column of the meters or else of the appliances on them; none raises KeyError."""
    own = {k: v for k, v in keys.items() if k in meters.columns}
    other = {k: v for k, v in keys.items() if k not in meters.columns}
    if len(keys) > 1 and any(isinstance(v, (list, tuple, set)) for v in keys.values()):
        raise ValueError("several values are for a single key")
    found = matching(meters, **own)
    if other:
        if appliances is None:
            raise KeyError(next(iter(other)))
        found = of_appliances(found, matching(appliances, **other))
    return _some(found, keys)


def select_using_appliances(meters: DataFrame, appliances: DataFrame, **keys) -> DataFrame:
    """Meters with an appliance that meets all keys; none raises KeyError."""
    return _some(of_appliances(meters, matching(appliances, **keys)), keys)


def one(meters: DataFrame, appliances: DataFrame, key) -> DataFrame:
    """The one meter of a key: a number (0: the mains), an appliance's type (its first instance), (type, instance), or a dict of meter columns. None or several raise KeyError."""
    if isinstance(key, bool):
        raise TypeError("a key is a number, a name, a pair or a dict")
    if isinstance(key, int):
        found = meters.where(F.col("meter") == key) if key else mains(meters)
    elif isinstance(key, str):
        found = of_appliances(meters, appliances.where((F.col("type") == key) & (F.col("instance") == 1)))
    elif isinstance(key, tuple):
        found = of_appliances(meters, appliances.where((F.col("type") == key[0]) & (F.col("instance") == key[1])))
    elif isinstance(key, dict):
        found = matching(meters, **key)
    else:
        raise TypeError("a key is a number, a name, a pair or a dict")
    n = found.limit(2).count()
    if n != 1:
        raise KeyError(f"{'no' if not n else 'more than one'} meter for {key!r}")
    return found


def groups_with(groups: DataFrame, meters: DataFrame, **keys) -> DataFrame:
    """Groups (rows with `meters`, an array of building and meter) of which any member meets all keys."""
    found = matching(meters, **keys).select(F.struct(*ID).alias("_m"))
    each = groups.withColumn("_g", F.monotonically_increasing_id() if "group" not in groups.columns else F.col("group"))
    hit = each.select("_g", F.explode("meters").alias("_m")).select("_g", F.struct("_m.building", "_m.meter").alias("_m")).join(found, "_m", "left_semi").select("_g").distinct()
    return each.join(hit, "_g", "left_semi").drop("_g")


def active(meters: DataFrame) -> DataFrame:
    """Meters that aren't disabled."""
    return meters.where(~F.coalesce("disabled", F.lit(False)))


def mains(meters: DataFrame) -> DataFrame:
    """The site meters in use."""
    return active(meters).where("site_meter")


def submeters(meters: DataFrame) -> DataFrame:
    return active(meters).where(~F.coalesce("site_meter", F.lit(False)))


def _flagged(meters: DataFrame, building: int, meter: int, value: bool) -> DataFrame:
    at = (F.col("building") == building) & (F.col("meter") == meter)
    return meters.withColumn("disabled", F.when(at, F.lit(value)).otherwise(F.coalesce("disabled", F.lit(False))))


def disabled(meters: DataFrame, building: int, meter: int) -> DataFrame:
    return _flagged(meters, building, meter, True)


def enabled(meters: DataFrame, building: int, meter: int) -> DataFrame:
    return _flagged(meters, building, meter, False)


def with_alternative_mains(meters: DataFrame) -> DataFrame:
    """Site meters change places: those in use are disabled and the disabled ones come into use, in buildings that have any of the latter."""
    off = F.coalesce("disabled", F.lit(False))
    has = F.bool_or(off & F.col("site_meter")).over(Window.partitionBy("building"))
    return meters.withColumn("disabled", F.when(F.col("site_meter") & has, ~off).otherwise(off))


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """The meters of both groups, each once."""
    return a.unionByName(b.join(a.select(*keys), list(keys), "left_anti")).dropDuplicates(list(keys))


def from_ids(meters: DataFrame, ids: Sequence[tuple[int, int]]) -> DataFrame:
    """The group of some (building, meter); an id without a meter raises KeyError."""
    wanted = meters.sparkSession.createDataFrame(list(ids), "building int, meter int").distinct()
    missing = wanted.join(meters, ID, "left_anti").first()
    if missing:
        raise KeyError(tuple(missing))
    return meters.join(F.broadcast(wanted), ID, "left_semi")  # the given list


def mirrored(meters: DataFrame, other: DataFrame, dataset: str) -> DataFrame:
    """The meters of a data set that have the ids of another group."""
    return meters.where(F.col("dataset") == dataset).join(other.select(*ID), ID, "left_semi")


def paired(master: DataFrame, slave: DataFrame) -> DataFrame:
    """(building, meter, master, slave): the data sets of submeters that both groups have."""
    side = lambda g, name: submeters(g).select(*ID, F.col("dataset").alias(name))
    return side(master, "master").join(side(slave, "slave"), ID)


def values(rows: DataFrame, column: str) -> DataFrame:
    """The different values of a column, of an array its elements'; nulls left out."""
    if column not in rows.columns:
        raise KeyError(column)
    x = F.explode(column) if dict(rows.dtypes)[column].startswith("array") else F.col(column)
    return rows.select(x.alias(column)).where(f"`{column}` is not null").distinct()


def _placed(appliances: DataFrame, sets: DataFrame | None) -> DataFrame:
    """appliances with `set`, where they name a set of meters, else with the `meter` of each of their meters."""
    return appliances.withColumn("meter", F.explode("meters")).drop("meters") if sets is None else appliances


def _meters_of(rows: DataFrame, sets: DataFrame | None) -> DataFrame:
    """Rows of sets as rows of their meters."""
    return rows if sets is None else rows.join(sets.select("building", "set", "meter"), ["building", "set"]).drop("set")


def dominant(appliances: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(building, meter, type, instance): the appliance of each meter that is marked as dominant, or its only one; null where several stand there without a mark.

    Appliances have their `meters`; or else a `set`, with `sets` (building, set, meter) for the meters that many of them
    share, and are then counted and compared a set, so that no row a meter and appliance is made.
    """
    at = ["building", "meter" if sets is None else "set"]
    each = _placed(appliances, sets).select(*at, F.struct(F.coalesce("dominant", F.lit(False)).alias("dominant"), "type", (-F.col("instance")).alias("_i"), "instance").alias("_top"))
    own = _meters_of(each.groupBy(*at).agg(F.count("*").alias("n"), F.max("_top").alias("_top")), sets)
    one = own if sets is None else own.groupBy(*ID).agg(F.sum("n").alias("n"), F.max("_top").alias("_top"))
    kept = F.col("_top.dominant") | (F.col("n") == 1)
    return one.select(*ID, F.when(kept, F.col("_top.type")).alias("type"), F.when(kept, F.col("_top.instance")).alias("instance"))


def groups(meters: DataFrame, appliances: DataFrame, column: str, sets: DataFrame | None = None) -> DataFrame:
    """(column, meters): the sorted ids of the meters of each value, of the meters' column or else of their dominant appliance's; `sets` as in `dominant`."""
    if column in meters.columns:
        rows = meters.select(*ID, column)
    else:
        rows = meters.select(*ID).join(dominant(appliances, sets), ID)
        if column not in ("type", "instance"):
            rows = rows.join(appliances.select("building", "type", "instance", column).distinct(), ["building", "type", "instance"])
        else:
            rows = rows.where("type is not null and instance is not null")
    return rows.where(f"`{column}` is not null").groupBy(column).agg(F.array_sort(F.collect_set(F.struct(*ID))).alias("meters"))


def labels(meters: DataFrame, appliances: DataFrame, pretty: bool = True, sets: DataFrame | None = None) -> DataFrame:
    """(building, meter, label): the appliances' names with their instance (in pretty labels from the second on), `Site meter`, or the meter's number; `sets` as in `dominant`.

    A meter's names are counted, and written out as often as they stand there when its label is made.
    """
    at = ["building", "meter" if sets is None else "set"]
    number = F.when(F.col("instance") > 1, F.concat(F.lit(" "), F.col("instance").cast("string"))).otherwise("") if pretty else F.concat(F.lit(" "), F.col("instance").cast("string"))
    named = _placed(appliances, sets).select(*at, F.concat(F.concat(F.upper(F.substring("type", 1, 1)), F.expr("substring(type, 2)")) if pretty else F.col("type"), number).alias("name"))
    counted = _meters_of(named.groupBy(*at, "name").agg(F.count("*").alias("n")), sets)
    counted = counted if sets is None else counted.groupBy(*ID, "name").agg(F.sum("n").alias("n"))
    found = counted.groupBy(*ID).agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "n")))).alias("_names"))
    label = F.array_join(F.flatten(F.transform("_names", lambda x: F.array_repeat(x["name"], x["n"].cast("int")))), ", ")
    return meters.join(found, ID, "left").select(*ID, F.coalesce(label, F.when(F.col("site_meter"), "Site meter"), F.concat(F.lit("Meter "), F.col("meter").cast("string"))).alias("label"))


def lacking(meters: DataFrame, devices: DataFrame, quantity: str, ac_types: Sequence[str]) -> DataFrame:
    """(building, meter) whose device doesn't measure a quantity in any of the AC types: what an algorithm checks before it starts."""
    able = devices.where(F.exists("measurements", lambda m: (m["physical_quantity"] == quantity) & m["ac_type"].isin(list(ac_types)))).select(F.col("model").alias("device_model"))
    return meters.join(able, "device_model", "left_anti").select(*ID)


def sample_period(meters: DataFrame, devices: DataFrame) -> DataFrame:
    """(building, sample_period) of all meters of a building together: the longest of its meters'."""
    return meters.join(devices.select(F.col("model").alias("device_model"), "sample_period"), "device_model", "left").groupBy("building").agg(F.max("sample_period").alias("sample_period"))
