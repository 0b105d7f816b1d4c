"""Operators by name in SQL: hostile rows, and equality with the operators themselves."""

from gridloom.functions import table_functions
from gridloom.operators import disaggregate, sections


def test_pairs_by_name(spark):
    rows = [(1, 0, 100.0), (1, 1, None), (1, 2, float("nan")), (1, 3, -100.0), (2, 0, 50.0), (2, None, -50.0), (None, 5, 80.0), (None, 6, -80.0)]
    df = spark.createDataFrame(rows, "meter long, t long, transition double")
    table_functions.register(spark)
    hart = spark.sql("SELECT * FROM hart_pairs(TABLE({df}) PARTITION BY meter ORDER BY (t, transition))", df=df)
    falls = spark.sql("SELECT * FROM fall_pairs(TABLE({df}) PARTITION BY meter ORDER BY (t DESC, transition DESC))", df=df)
    want = {(1, 0, 100.0, 3, -100.0), (None, 5, 80.0, 6, -80.0)}
    assert set(map(tuple, hart.collect())) == set(map(tuple, falls.collect())) == want
    none = spark.sql("SELECT * FROM hart_pairs(TABLE({df}) PARTITION BY meter ORDER BY t)", df=df.limit(0))
    assert none.collect() == [] and none.columns == disaggregate.pair_transitions(df).columns


def test_sections_and_rate_by_name(spark):
    rows = [(m, t * 1_000_000, None if t % 7 == 3 else 1.0, t) for m in (1, 2) for t in (0, 1, 2, 3, 4, 10, 11, 30)]
    df = spark.createDataFrame(rows, "meter long, t long, value double, id long")
    table_functions.register(spark, df)
    for gap in (0, 1, 2.5):
        assert sorted(map(tuple, spark.sql(f"SELECT * FROM good_sections({gap})").collect())) == sorted(map(tuple, sections.good_sections(df, gap).collect()))
    got = spark.sql("SELECT meter, dropout_rate(count(value), min(t), max(t), 1) AS r FROM readings WHERE value IS NOT NULL GROUP BY meter").collect()
    assert {r.meter: round(r.r, 9) for r in got} == {1: round(1 - 6 / 31, 9), 2: round(1 - 6 / 31, 9)}
    assert spark.sql("SELECT dropout_rate(4, 0, 10, 1) AS r").first().r is None


def test_tau_by_name(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 3.0, 1.0), (1, None, 5.0), (2, 1.0, 1.0), (2, 1.0, 2.0)], "meter long, x double, y double")
    table_functions.register(spark)
    got = {r.meter: r.tau for r in spark.sql("SELECT meter, kendall(x, y) AS tau FROM {df} GROUP BY meter", df=df).collect()}
    assert got[2] is None and abs(got[1] + 1 / 3) < 1e-12
