"""Handles of data sets, statistics bound to the files they come from, sections that a group shares."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import intervals
from gridloom.sources import dataset, metadata, store

DAY = 86400 * 10**6


def readings(spark, building, meter, first, n, value=1.0):
    rows = spark.range(n).select(F.lit("x").alias("dataset"), F.lit(building).alias("building"), F.lit(meter).alias("meter"), F.timestamp_seconds(F.col("id") * 3600 + first).alias("ts"))
    return rows.withColumns({"physical_quantity": F.lit("power"), "ac_type": F.lit("active"), "value": F.lit(value)}).coalesce(1)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_cache_follows_the_files(spark, tmp_path, fmt):
    at, seen = str(tmp_path / "s"), []

    def count(rows):
        seen.append(sorted(r.building for r in rows.select("building").distinct().collect()))
        return rows.groupBy("dataset", "building").agg(F.count("*").alias("n")).where("n > 2")

    now = lambda: {r.building: r.n for r in store.cached(spark, at, "n", count, fmt).collect()}
    store.save(readings(spark, 1, 1, 0, 5).unionByName(readings(spark, 2, 1, 0, 2)), at, fmt)
    assert now() == now() == {1: 5} and seen == [[1, 2]]
    store.save(readings(spark, 2, 1, 9 * 3600, 4), at, fmt)  # a part that had no rows
    assert now() == {1: 5, 2: 6} and seen[1:] == [[2]]
    store.save(readings(spark, 3, 1, 0, 3), at, fmt)
    assert store.remove(spark, at, "x", 1)
    assert now() == now() == {2: 6, 3: 3} and seen[2:] == [[3]]
    store.remove(spark, at, "x", 2)
    store.save(readings(spark, 2, 1, 0, 1), at, fmt)  # fewer than before: no row now
    assert now() == {3: 3}
    assert store.clear_cache(spark, at, "n") and now() == {3: 3} and seen[4:] == [[2, 3]]


def test_cache_of_a_keyed_store(spark, tmp_path):
    at = str(tmp_path / "s")
    store.put(readings(spark, 1, 1, 0, 5).unionByName(readings(spark, 1, 2, 0, 2)), at)
    made = lambda rows: rows.groupBy(*store.KEY).agg(F.sum("value").alias("total"))
    now = lambda: {r.meter: r.total for r in store.cached(spark, at, "sum", made, by=store.KEY).collect()}
    assert now() == {1: 5.0, 2: 2.0}
    store.put(readings(spark, 1, 2, 0, 2, 4.0), at)
    assert now() == {1: 5.0, 2: 8.0}


def test_handle(spark, tmp_path):
    at = str(tmp_path / "s")
    store.save(readings(spark, 1, 1, 0, 48).unionByName(readings(spark, 1, 2, 0, 24, 3.0)).unionByName(readings(spark, 2, 1, 0, 12, float("nan"))), at)
    whole = dataset.DataSet(spark, at)
    day = whole.window("1970-01-02", None)
    assert (whole.readings().count(), day.readings().count(), day.of(2).readings().count()) == (84, 24, 0)
    assert whole.of(1, [2]).window(end="1970-01-01 06:00").readings().count() == 6
    assert whole.start is None and day.of(1).start == "1970-01-02"
    with pytest.raises(ValueError):
        whole.window("1970-01-02", "1970-01-02")
    got = {r.building: (r.meters, r.readings, r.known, r.mean) for r in whole.describe().collect()}
    assert got == {1: (2, 72, 72, pytest.approx(120 / 72)), 2: (1, 12, 0, None), None: (3, 84, 72, pytest.approx(120 / 72))}
    assert day.of(2).describe().count() == 0 and {r.building for r in day.buildings().collect()} == {1}
    assert sorted(map(tuple, whole.of(1).timeframe().select("meter", F.hour("end")).collect())) == [(1, 23), (2, 23)]
    assert [(r.building, r.start, r.end) for r in whole.common_sections(7200).collect()] == [(1, 0, 23 * 3600 * 10**6)]
    assert whole.good_sections(7200).count() == 2


def test_the_window_reaches_the_scan(spark, tmp_path):
    at = str(tmp_path / "s")
    store.save(readings(spark, 1, 1, 0, 48).unionByName(readings(spark, 2, 1, 0, 48)), at)
    rows = dataset.DataSet(spark, at).window("1970-01-01 12:00", "1970-01-02").of(2).view("in_reach")
    plan = rows.select("meter", "value")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "(building" in scan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan
    assert "physical_quantity" not in scan.split("ReadSchema")[1]
    assert spark.sql("SELECT count(*) AS n FROM in_reach").first().n == 12


def test_handle_with_metadata(spark, tmp_path):
    at, about = str(tmp_path / "s"), str(tmp_path / "m")
    store.save(readings(spark, 1, 1, 0, 3), at)
    meters = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "building int, meter int")
    metadata.save({"meters": meters, "appliances": meters.select("building"), "devices": spark.createDataFrame([("a",)], "model string")}, about)
    found = dataset.DataSet(spark, at, about=about)
    assert found.tables["meters"].count() == 3 and found.of(1).tables["meters"].count() == 2 and found.of(1).tables["devices"].count() == 1
    with pytest.raises(ValueError):
        dataset.DataSet(spark, at).tables


def test_common_sections(spark):
    some = spark.createDataFrame([("a", 0, 10), ("a", 20, 30), ("b", 5, 25), ("c", 0, 30)], "meter string, start long, end long")
    group = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "b"), ("h", "c"), ("h", "a"), ("none", "a"), ("none", "z"), (None, "a")], "group string, meter string")
    got = sorted(map(tuple, intervals.common(some, group).collect()))
    assert got == [("g", 5, 10), ("g", 20, 25), ("h", 0, 10), ("h", 20, 30)]
    assert intervals.common(some.where("false"), group).count() == 0
