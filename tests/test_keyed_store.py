"""Put of one meter and append with an overlap check."""

import pytest
from pyspark.sql import functions as F

from gridloom.sources import store


def readings(spark, meter, first, n, value=1.0, building=1):
    rows = spark.range(n).select(F.lit("x").alias("dataset"), F.lit(building).alias("building"), F.lit(meter).alias("meter"), F.timestamp_seconds(F.col("id") + first).alias("ts"))
    return rows.withColumns({"physical_quantity": F.lit("power"), "ac_type": F.lit("active"), "value": F.lit(value)}).coalesce(1)


def files(path, meter):
    return {p.name: p.stat().st_mtime_ns for p in path.glob(f"dataset=x/building=1/meter={meter}/part-*")}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_put_and_append(spark, tmp_path, fmt):
    at = tmp_path / "s"
    store.put(readings(spark, 1, 0, 10).unionByName(readings(spark, 2, 0, 10)), str(at), fmt)
    before = files(at, 2)
    store.put(readings(spark, 1, 50, 5, 3.0), str(at), fmt)
    assert before and files(at, 2) == before
    total = lambda: {r.meter: (r.n, r.s) for r in store.load(spark, str(at), fmt).groupBy("meter").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert total() == {1: (5, 15.0), 2: (10, 10.0)}
    store.append(readings(spark, 1, 0, 50).unionByName(readings(spark, 2, 10, 1)), str(at), fmt)  # a put has freed what was there
    assert total() == {1: (55, 65.0), 2: (11, 11.0)}
    for first, n in ((54, 1), (0, 1), (40, 30), (30, 1)):
        with pytest.raises(ValueError):
            store.append(readings(spark, 1, first, n), str(at), fmt)
    store.append(readings(spark, 1, 54, 1, building=2), str(at), fmt)  # another building's meter
    store.append(readings(spark, 1, 0, 0), str(at), fmt)
    assert total() == {1: (56, 66.0), 2: (11, 11.0)}
    assert store.spans(spark, str(at)).where("building = 1 and meter = 1").count() == 2
    with pytest.raises(ValueError):
        store.put(readings(spark, 1, 0, 1).withColumn("ts", F.lit(None).cast("timestamp")), str(at), fmt)
