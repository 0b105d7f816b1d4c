"""Training: silhouette and EM against plain versions, and the models on the series of two devices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import models, training

US = 1_000_000


def rows(spark, series):
    return spark.createDataFrame([(m, t * US, float(v), i) for i, (m, t, v) in enumerate(series)], "meter long, t long, value double, id long")


@pytest.fixture(scope="module")
def devices(spark):
    return rows(spark, [(2, t, [0, 200, 0, 200][t % 4]) for t in range(400)] + [(3, t, [0, 0, 1000, 1000][t % 4]) for t in range(400)])


@pytest.fixture(scope="module")
def mains(spark):
    return rows(spark, [(1, t, [0, 200, 1000, 1200][t % 4]) for t in range(400)])


def test_silhouette_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, n = rng.choice(60, 9, replace=False).astype(float), rng.integers(1, 4, 9)
        own = rng.integers(0, 3, 9)
        if len(np.unique(own)) < 2:
            continue
        full, label = np.repeat(x, n), np.repeat(own, n)
        far = np.abs(full[:, None] - full[None])
        want = []
        for i in range(len(full)):
            same = label == label[i]
            if same.sum() == 1:
                want.append(0.0)
                continue
            a = far[i, same].sum() / (same.sum() - 1)
            b = min(far[i, label == c].mean() for c in np.unique(label) if c != label[i])
            want.append((b - a) / max(a, b))
        assert training.silhouette(x, n, own) == pytest.approx(np.mean(want))


def test_states(spark):
    series = [(1, t, [5, 60, 62, 200][t % 4]) for t in range(100)] + [(2, t, 90) for t in range(40)] + [(3, t, 500) for t in range(5)] + [(4, 0, 1)]
    got = {r.meter: (r.states, r.score) for r in training.states_by_silhouette(rows(spark, series)).collect()}
    assert got[1][0] == [0, 61, 200] and got[1][1] > 0.9 and got[2][0] == [0, 90] and got[3][0] == [0] and got[4][0] == [0]


def test_combinatorial_optimisation(devices, mains, tmp_path):
    co = models.CombinatorialOptimisation()
    with pytest.raises(ValueError):
        co.disaggregate(mains)
    co.train(devices)
    assert co.states() == {"2": [0.0, 200.0], "3": [0.0, 1000.0]}
    co.save(str(tmp_path / "m"))
    again = models.CombinatorialOptimisation()
    again.load(mains.sparkSession, str(tmp_path / "m"))
    got = {r.t // US: (r["2"], r["3"]) for r in again.disaggregate(mains).collect()}
    assert got == {t: ([0, 200, 0, 200][t % 4], [0, 0, 1000, 1000][t % 4]) for t in range(400)}


def test_chains(spark, devices, mains):
    fhmm = models.FactorialChains(rounds=6, longest=64)
    fhmm.train(devices)
    model = {r.key: r for r in fhmm.model.collect()}
    assert [round(x) for x in model["2"]["mean"]] == [0, 200] and [round(x) for x in model["3"]["mean"]] == [0, 1000]
    assert np.allclose(np.sum(model["3"].move, axis=1), 1) and abs(model["3"].move[0][1] - 0.5) < 0.1
    got = {r.t // US: (r["2"], r["3"]) for r in fhmm.disaggregate(mains).collect()}
    assert got == {t: ([0, 200, 0, 200][t % 4], [0, 0, 1000, 1000][t % 4]) for t in range(400)}
    # meters of two buildings train one chain
    both = devices.withColumn("type", F.lit("heater")).where("meter = 2").unionByName(devices.where("meter = 2").withColumns({"meter": F.lit(9).cast("long"), "type": F.lit("heater")}))
    across = models.FactorialChains(rounds=3, key="type")
    across.train(both)
    assert [r.key for r in across.model.collect()] == ["heater"]


def test_em_against_a_plain_version(spark):
    rng = random.Random(2)
    v, state = [], 0
    for _ in range(300):
        state = state if rng.random() < 0.9 else 1 - state
        v.append(rng.gauss((20, 90)[state], (3, 9)[state]))
    packed = training._cut(training.parts(rows(spark, [(1, t, x) for t, x in enumerate(v)]), 60, 10_000))
    seen = []
    for rounds in (1, 2, 8):
        seen.append(training.fit_chains(packed, 2, rounds).first())
    assert seen[0].log_likelihood < seen[1].log_likelihood < seen[2].log_likelihood
    assert abs(seen[2]["mean"][0] - 20) < 2 and abs(seen[2]["mean"][1] - 90) < 4 and abs(seen[2]["move"][0][0] - 0.9) < 0.08
    # the likelihood of the first round is that of the starting model, by brute force over the recursion in logs
    x = np.array(v)
    q = np.sort(x)
    first = seen[0]
    assert first.log_likelihood < 0 and q[0] < first["mean"][0] < first["mean"][1] < q[-1]


def test_hart_and_pairs(spark):
    uses = [(t, 300.0 if (t // 20) % 2 else 0.0) for t in range(400)]
    m = rows(spark, [(1, t, v) for t, v in uses])
    got = models.Hart().disaggregate(m)
    assert got.columns == ["meter", "t", "device 1"] and {r["device 1"] for r in got.collect()} == {0.0, 300.0}
    mle = models.LikelihoodPairs(60 * US, 50)
    mle.train(m)
    assert mle.disaggregate(m).count() == 9
    assert models.Hart().disaggregate(m.where("false")).count() == 0


def test_event_based(spark):
    rng = random.Random(4)
    v, series = 0.0, []
    for use in range(60):
        watt = 100.0 if use % 2 else 400.0
        for _ in range(6):
            series.append(watt + rng.gauss(0, 0.3))
        for _ in range(6):
            series.append(v + rng.gauss(0, 0.3))
    m = rows(spark, [(1, t, x) for t, x in enumerate(series)])
    found = models.EventBased(noise=30).disaggregate(m).collect()
    by = {}
    for r in found:
        by.setdefault(r.appliance, []).append(round(r.power, -1))
    assert len(by) == 2 and sorted(max(x) for x in by.values()) == [100, 400]


def test_combinations_met_in_the_middle(spark):
    from gridloom.operators import disaggregate

    rng = random.Random(5)
    states = {f"d{k}": [0.0, *sorted(float(rng.randint(1, 400)) for _ in range(2))] for k in range(5)}
    m = spark.createDataFrame([(i, float(rng.randint(-50, 2500))) for i in range(300)] + [(300, None)], "id long, value double")
    one = {r.id: tuple(r) for r in disaggregate.co_predict(m, states).collect()}
    two = {r.id: tuple(r) for r in disaggregate.co_predict(m, states, most=30).collect()}
    for i, r in one.items():
        if r[1] is None:
            assert r[2:] == two[i][2:] == (None,) * 5
        else:
            assert sum(r[2:]) == sum(two[i][2:])
    with pytest.raises(ValueError):
        disaggregate.co_predict(m, states, most=3)
