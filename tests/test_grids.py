"""Grids a day at a time."""

from pyspark.sql import functions as F

from gridloom.operators import resample

US = 1_000_000


def test_steps_against_plain_ranges(spark):
    rows = []
    for step in (7 * US, 3600 * US, 86400 * US, 7 * 86400 * US):
        for a in (-200_000 * US, 0, 1_704_000_000 * US):
            first = a - a % step
            rows += [(step, first, first + k * step) for k in (0, 1, 3, 30)]
    for step in {r[0] for r in rows}:
        some = [(i, a, b) for i, (s, a, b) in enumerate(rows) if s == step]
        got: dict = {}
        for r in resample.steps(spark.createDataFrame(some, "i long, a long, b long"), "a", "b", step, "t").collect():
            got.setdefault(r.i, []).append(r.t)
        assert {k: sorted(v) for k, v in got.items()} == {i: list(range(a, b + 1, step)) for i, a, b in some}


def test_ten_years_of_seconds_are_no_array(spark):
    ends = [(1, 0, 1.0, 0), (1, 3650 * 86400 * US, 2.0, 1)]
    readings = spark.createDataFrame(ends, "meter long, t long, value double, id long")
    found = resample.grid(readings, 1).agg(F.count("*").alias("n"), F.max("t").alias("t")).first()
    assert found.n == 3650 * 86400 + 1 and found.t == 3650 * 86400 * US
    gap = resample.time_weighted(readings, 60).agg(F.count("*").alias("n"), F.min("value").alias("v")).first()
    assert gap.n == 3650 * 1440 and gap.v == 1.0
