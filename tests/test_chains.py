"""Viterbi over blocks of any length, and chains by building."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import chains, disaggregate, models


def plain(v, product):
    """The path of one series in one piece."""
    return product.path(np.asarray(v, float)).tolist()


def test_any_block_length_gives_one_answer(spark):
    rng = np.random.default_rng(2)
    levels, moves = [[0.0, 60.0], [0.0, 60.0, 150.0]], [chains.staying(2, 0.9), chains.staying(3, 0.6)]  # 60 and 60 tie
    product = chains.Product(levels, moves, 50.0)
    rows, want = [], {}
    for m, size in enumerate((1, 2, 3, 7, 40, 64, 65, 200)):
        v = [float(x) for x in rng.choice([0, 30, 60, 90, 120, 150, 210, 9e5], size) + rng.normal(size=size)]
        want[m] = plain(v, product)
        rows += [(m, 10 * i, i, x) for i, x in enumerate(v)] + [(m, 5, 1000, None)]
    mains = spark.createDataFrame(rows, "meter long, t long, id long, value double")
    for longest in (1, 2, 3, 64, 1000):
        got: dict = {}
        for r in chains.decode(mains, lambda _: product, [], (), longest).orderBy("meter", "t", "id").collect():
            got.setdefault(r.meter, []).append(list(r.levels))
        assert got == want, longest
    assert chains.decode(mains.where("false"), lambda _: product, []).count() == 0


def test_the_path_is_the_best_of_all(spark):
    """Against every path of short series."""
    import itertools

    rng = np.random.default_rng(5)
    product = chains.Product([[0.0, 40.0, 90.0]], [chains.staying(3, 0.8)], 200.0)
    for _ in range(30):
        v = rng.normal(size=6) * 60 + 40
        fit = product.fit(v)
        score = lambda p: sum(fit[i, s] for i, s in enumerate(p)) + sum(product.move[a, b] for a, b in zip(p, p[1:]))
        top = max(score(p) for p in itertools.product(range(3), repeat=6))
        found = [int(np.flatnonzero(product.combos[:, 0] == x)[0]) for x in product.path(v)[:, 0]]
        assert score(found) == top


def test_seventy_devices_in_twenty_buildings_decode_as_each_alone(spark):
    rng = np.random.default_rng(7)
    watts = {b: [float(w) for w in 50 * 2 ** rng.permutation(6)[: 3 + b % 2]] for b in range(20)}
    assert sum(map(len, watts.values())) == 70
    devices, mains, truth = [], [], {}
    for b, sizes in watts.items():
        on = np.repeat(rng.integers(0, 2, (30, len(sizes))), 5, axis=0)
        for k, w in enumerate(sizes):
            truth[b, str(k)] = (on[:, k] * w).tolist()
            devices += [(b, k, i, i, float(on[i, k] * w)) for i in range(len(on))]
        mains += [(b, 99, i, i, float((on[i] * sizes).sum())) for i in range(len(on))]
    columns = "building long, meter long, t long, id long, value double"
    trained = models.FactorialChains(rounds=4, building="building")
    trained.train(spark.createDataFrame(devices, columns).withColumn("t", F.col("t") * 1_000_000))
    assert trained.model.count() == 70
    found = trained.disaggregate(spark.createDataFrame(mains, columns).withColumn("t", F.col("t") * 1_000_000))
    got: dict = {}
    for r in found.orderBy("t").collect():
        got.setdefault((r.building, r.device), []).append(r.power)
    alone = models.FactorialChains(rounds=4)
    alone.train(spark.createDataFrame(devices, columns).where("building = 3").withColumn("t", F.col("t") * 1_000_000))
    one = alone.disaggregate(spark.createDataFrame(mains, columns).where("building = 3").withColumn("t", F.col("t") * 1_000_000)).orderBy("t").collect()
    for k in range(len(watts[3])):
        assert got[3, str(k)] == [r[str(k)] for r in one]
    right = np.mean([np.mean(np.isclose(got[key], v, atol=3)) for key, v in truth.items()])
    assert got.keys() == truth.keys() and right > 0.9


def test_no_silent_caps(spark):
    many = spark.createDataFrame([(m, t, t, float(m * (t % 2))) for m in range(1, 71) for t in range(40)], "meter long, t long, id long, value double").withColumn("t", F.col("t") * 1_000_000)
    co = models.CombinatorialOptimisation()
    co.train(many)
    with pytest.raises(ValueError):
        co.states()
    with pytest.raises(ValueError):
        chains.Product([[0.0, 1.0]] * 11, [chains.staying(2, 0.9)] * 11, 5.0)


def test_every_trained_device_has_pairs(spark):
    second = 1_000_000
    pulse = lambda m, w, starts, length: [(m, t * second, t, w if any(a <= t < a + length for a in starts) else 0.0) for t in range(400)]
    columns = "meter long, t long, id long, value double"
    mle = models.LikelihoodPairs(60 * second, 50)
    mle.train(spark.createDataFrame(pulse(1, 300.0, [20, 120, 220], 15) + pulse(2, 900.0, [60, 160, 260], 30), columns))
    assert mle.model.count() == 2
    a, b = pulse(9, 300.0, [30, 200], 15), pulse(9, 900.0, [100, 300], 30)
    mains = spark.createDataFrame([(9, x[1], x[2], x[3] + y[3]) for x, y in zip(a, b, strict=True)], columns)
    got: dict = {}
    for r in mle.disaggregate(mains).collect():
        got.setdefault(r.device, set()).add((r.on_t // second, r.off_t // second, r.likelihood > 1e-12))
    assert {x[:2] for x in got[1] if x[2]} == {(30, 45), (200, 215)} and {x[:2] for x in got[2] if x[2]} == {(100, 130), (300, 330)}
