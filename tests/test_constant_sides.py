"""Correlations where a side is constant, alone or missing, and the pairs of meters by blocks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import energy, forecast, metrics

ROWS = [(m, t, v, t) for m, values in {1: [5.0] * 6, 2: [1.0, 2.0, 4.0, 8.0, 3.0, 1.0], 3: [7.0]}.items() for t, v in enumerate(values)]


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame([*ROWS, (4, 0, None, 0), (4, 1, float("nan"), 1)], "meter long, t long, value double, id long")


def test_a_constant_side_has_no_correlation(readings):
    got = {r.meter: r.r1 for r in energy.autocorrelation(readings, [1]).collect()}
    assert got[1] is None and got[3] is None and np.isclose(got[2], np.corrcoef([2, 4, 8, 3, 1], [1, 2, 4, 8, 3])[0, 1])
    grid = readings.select(F.col("meter").alias("kind"), F.col("t").alias("g"), "value")
    pairs = {(r.a, r.b): (r.r, r.n) for r in energy.correlation_pairs(grid).collect()}
    assert pairs[1, 1] == (None, 6) and pairs[1, 2] == (None, 6) and np.isclose(pairs[2, 2][0], 1)
    vectors = {r.meter: (r.t, r.same) for r in forecast.correlation_vectors(readings, {"t": F.col("t"), "same": F.lit(3)}).collect()}
    assert vectors[1] == (0, 0) and vectors[4] == (0, 0) and vectors[2][0] != 0 and vectors[2][1] == 0
    ranks = {r.meter: r.rho for r in forecast.rank_correlation(readings.where("not isnan(value)"), "value", "t").collect()}
    assert ranks[1] is None and ranks[3] is None and ranks[2] is not None


def test_shares_of_a_whole_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (2, 0.0, 1.0)], "meter long, pred double, truth double")
    assert metrics.fraction_assigned(rows).first()[0] is None
    assert metrics.fraction_assigned(rows.withColumn("pred", F.col("truth"))).first()[0] == 1.0


@pytest.mark.parametrize(("block", "stretch"), [(2, 3), (256, 1024)])
def test_pairs_by_blocks_against_numpy(spark, block, stretch):
    rng = np.random.default_rng(4)
    series = {m: {int(g): float(rng.normal() * 10 + 1e4) for g in rng.choice(40, rng.integers(1, 30), replace=False)} for m in range(9)}
    series[9] = {g: 3.3 for g in range(40)}  # constant
    series[10] = {100: 1.0}  # shares nothing
    rows = [(m, g, v) for m, s in series.items() for g, v in s.items()] + [(1, 7, None)]
    got = {(r.a, r.b): (r.r, r.n) for r in energy.gram_pairs(spark.createDataFrame(rows, "meter long, g long, value double"), block, stretch).collect()}
    want = {}
    for a in series:
        for b in series:
            shared = sorted(set(series[a]) & set(series[b]))
            if a <= b and shared:
                x, y = np.array([series[a][g] for g in shared]), np.array([series[b][g] for g in shared])
                want[a, b] = (None if len(shared) < 2 or 9 in (a, b) else float(np.corrcoef(x, y)[0, 1]), len(shared))
    assert got.keys() == want.keys()
    for k, (r, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if r is None else abs(got[k][0] - r) < 1e-6), k
    assert energy.gram_pairs(spark.createDataFrame([], "meter long, g long, value double")).count() == 0


def test_pairs_of_few_instants_are_not_shuffled(spark):
    """One stretch holds all instants, so no exchange stands above the tasks that make pairs; with several one does."""
    grid = spark.range(400).select((F.col("id") % 10).alias("meter"), (F.col("id") / 10).cast("long").alias("g"), (F.col("id") * 7 % 31).cast("double").alias("value"))
    above = lambda df: df._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInPandas")[0]
    one, many = energy.gram_pairs(grid, 4), energy.gram_pairs(grid, 4, 8)
    assert "Exchange" not in above(one) and "Exchange" in above(many)
    rows = lambda df: {(r.a, r.b): (round(r.r, 9), r.n) for r in df.collect()}
    assert rows(one) == rows(many) and len(rows(one)) == 55
