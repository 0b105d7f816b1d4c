"""Event-based disaggregation and rank correlation against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import disaggregate, energy, eventbased, forecast
from gridloom.sources import metadata, store

S = 1_000_000
TRANSIENTS = "meter string, t long, transition double, level double"


def labels_by_hand(levels, threshold):
    """Labels as growing strings, range by range."""
    label, stack = [""] * len(levels), [[-1e18, [0]]]

    def close(now):
        visits = stack.pop()[1]
        if len(visits) >= 3:
            for j, (a, b) in enumerate(itertools.pairwise(visits)):
                for r in range(a, b):
                    label[r] = f"{j}_{label[r]}"
        for r in range(stack[-1][1][-1], now):
            label[r] = label[r] and "|" + label[r]

    for i, x in enumerate(levels):
        while x < stack[-1][0] - threshold:
            close(i)
        if abs(x - stack[-1][0]) <= threshold:
            stack[-1][0] = x
            stack[-1][1].append(i)
        else:
            stack.append([x, [i]])
    while len(stack) > 1:
        close(len(levels) - 1)
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    return [first[x] for x in label]


def test_segments_by_hand():
    rng = np.random.default_rng(0)
    for k in range(600):
        n = int(rng.integers(0, 40))
        levels = np.cumsum(rng.normal(0, 100, n)) if k % 3 == 0 else rng.choice([0, 100, 200, 300, 400], n) + rng.normal(0, 20, n)
        assert eventbased.segment_ids(levels, 70).tolist() == labels_by_hand(levels, 70)


def test_segments_and_features(spark):
    steps = [(0, 0.0, 0.0), (10, 100.0, 100.0), (20, -100.0, 0.0), (30, 200.0, 200.0), (40, 300.0, 500.0), (50, -302.0, 198.0), (60, -198.0, 0.0), (70, 100.0, 100.0), (80, -100.0, 0.0)]
    df = spark.createDataFrame([("a", t * S, x, y) for t, x, y in steps], TRANSIENTS)
    got = eventbased.segments(df, 50).orderBy("t").collect()
    # the first transient goes with the first state's segment
    assert [r.segment for r in got] == [0, 0, 0, 2, 2, 2, 2, 6, 6] and [r.place for r in got[3:7]] == [0, 1, 2, 3]
    two = eventbased.segment_features(eventbased.segments(df, 50), 2).collect()
    assert [(r.transition_avg, r.transition_delta, r.duration) for r in two] == [(100.0, 0.0, 10.0)]
    four = eventbased.segment_features(eventbased.segments(df, 50), 4).collect()
    assert [(r.fst, r.fth, r.sec_duration) for r in four] == [(200.0, -198.0, 10.0)]
    assert [r.grp for r in eventbased.split_fours(eventbased.segments(df, 50)).orderBy("place").collect()] == [0, 1, 1, 0]
    assert eventbased.segments(df.limit(0)).count() == 0


def test_decode_against_all_ways():
    rng = np.random.default_rng(3)
    rings = [[(np.array([w]), np.array([[0.01]])) for w in ring] for ring in ([50.0, -50.0], [60.0, 20.0, -80.0])]
    for _ in range(60):
        x = (rng.choice([50, -50, 60, 20, -80], 6) + rng.normal(0, 6, 6))[:, None]
        best = (0, 0.0)
        for way in itertools.product([-1, 0, 1], repeat=6):
            state, rounds, cost, fits = [0, 0], 0, 0.0, True
            for i, a in enumerate(way):
                if a >= 0:
                    d = abs(float(x[i, 0] - rings[a][state[a]][0][0])) * 0.1
                    fits &= d * d <= 9
                    cost += d
                    state[a] = (state[a] + 1) % len(rings[a])
                    rounds += state[a] == 0
            if fits and state == [0, 0]:
                best = min(best, (-rounds, cost))
        got = eventbased.decode(x, rings, 9.0)
        state, rounds, cost = [0, 0], 0, 0.0
        for i, (a, s) in enumerate(got):
            if a >= 0:
                assert s == state[a]
                cost += abs(float(x[i, 0] - rings[a][s][0][0])) * 0.1
                state[a] = (s + 1) % len(rings[a])
                rounds += state[a] == 0
        assert state == [0, 0] and (-rounds, pytest.approx(cost)) == best


def test_decode_segments(spark):
    rows = [("a", 0, k * S, k, v) for k, v in enumerate([60.0, 200.0, 7.0, -200.0, -61.0])] + [("a", 9, 0, 0, 60.0)]
    df = spark.createDataFrame(rows, "meter string, segment long, t long, place int, transition double").withColumn("size", F.when(F.col("segment") == 0, 5).otherwise(1))
    ring = lambda w: [([w], [[100.0]]), ([-w], [[100.0]])]
    got = eventbased.decode_segments(df, ["transition"], {"fridge": ring(60.0), "heater": ring(200.0)}).orderBy("t").collect()
    assert [(r.appliance, r.step) for r in got] == [("fridge", 0), ("heater", 0), (None, None), ("heater", 1), ("fridge", 1)]


def groups_by_hand(t, eps, least):
    core = [sum(abs(a - b) <= eps for b in t) >= least for a in t]
    starts = sorted({a for a, c in zip(t, core) if c})
    number, n = {}, -1
    for k, a in enumerate(starts):
        n += k == 0 or a - starts[k - 1] > eps
        number[a] = n
    return [min((number[a] for a in starts if abs(a - b) <= eps), default=None) if not c else number[b] for b, c in zip(t, core)]


def test_dense_groups(spark):
    rng = np.random.default_rng(4)
    sets = {k: sorted(int(x) for x in rng.integers(0, 120, 30)) for k in range(30)}
    df = spark.createDataFrame([(k, i, x) for k, v in sets.items() for i, x in enumerate(v)], "k int, i int, t long")
    got = {}
    for r in eventbased.dense_groups(df, ["k"], 4, 5).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.group)
    assert got == {k: groups_by_hand(v, 4, 5) for k, v in sets.items()}


def test_phase_events(spark):
    rows = [(1, p, k * 10 * S, 100.0 if k % 2 else -100.0) for p in (1, 2) for k in range(12)] + [(1, 3, k * 10 * S, 50.0) for k in range(12)] + [(1, p, 10**10, 5.0) for p in (1, 2)]
    got = eventbased.phase_events(spark.createDataFrame(rows, "building int, phase int, t long, transition double")).collect()
    assert {(r.phase_a, r.phase_b) for r in got} == {(1, 2)} and len(got) == 12 and {r.group for r in got} == {0}  # the third phase shares six rises, the late instant is noise


def test_mixture(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(rng.normal(60, 2)), 0) for k in range(60)] + [(k + 60, float(rng.normal(200, 2)), 1) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, w double, own int")
    got = eventbased.mixture_by_bic(df, ["w"], 3, ["w"]).collect()
    assert len({(r.own, r.component) for r in got}) == 2 and all(r.confident for r in got)
    one = eventbased.mixture_by_bic(df.where("own = 0"), ["w"], 3, ["w"])
    assert {r.component for r in one.collect()} == {0} and one.where("confident").count() > 0
    assert eventbased.mixture_by_bic(df.limit(0), ["w"]).count() == 0
    assert {(r.component, r.confident) for r in eventbased.mixture_by_bic(df.withColumn("w", F.lit(1.0)), ["w"]).collect()} == {(0, False)}


def test_power_remainder_and_centroids(spark):
    ev = spark.createDataFrame([("a", "x", 0, 0, 100.0), ("a", "x", 0, 10, -90.0), ("a", "x", 1, 20, 100.0), ("a", "x", 1, 30, -100.0)], "meter string, appliance string, run int, t long, transition double")
    assert [r.power for r in eventbased.appliance_power(ev).orderBy("t").collect()] == [90.0, 0.0, 100.0, 0.0]
    grid = spark.createDataFrame([("a", 0, 150.0), ("a", 10, 20.0), ("a", 50, 5.0)], "meter string, t long, value double")
    power = eventbased.appliance_power(ev).withColumnRenamed("power", "value")
    assert [r.value for r in eventbased.remainder(grid, power).orderBy("t").collect()] == [60.0, 20.0, 5.0]
    assert eventbased.mean_shift(np.array([1.0, 2, 3, 100, 101, 102]), 10).tolist() == [2.0, 101.0]
    assert eventbased.opposite_centroids([60, 200, 5], [-190, -70]) == [(60, -70), (200, -190)]
    pairs = spark.createDataFrame([("a", 0, 60.0, 10 * S, -62.0), ("a", 20 * S, 64.0, 50 * S, -60.0), ("a", 60 * S, 200.0, 61 * S, -200.0)], "meter string, on_t long, on double, off_t long, off double")
    assert sorted(r.centroid for r in eventbased.pair_centroids(pairs).collect()) == [61.5, 200.0]
    r = eventbased.switch_parameters(pairs.where("on < 100"), F.col("on_t"), F.col("off_t")).first()
    assert (r.on_mean, r.on_deviation, r.off_mean, r.span_mean, r.span_deviation) == (62.0, 2.0, -61.0, 20.0, 10.0)


def test_kendall(spark):
    rng = np.random.default_rng(6)
    for n in (2, 5, 40, 100):
        x, y = rng.integers(0, 9, n), rng.integers(-4, 9, n)
        s = sum(np.sign(a - c) * np.sign(b - d) for (a, b), (c, d) in itertools.combinations(zip(x, y), 2))
        nx, ny = (sum(a != b for a, b in itertools.combinations(v, 2)) for v in (x, y))
        want = s / math.sqrt(nx * ny) if nx * ny else None
        assert forecast.kendall_tau(x, y) == (pytest.approx(want) if want is not None else None)
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (1, None, 9.0), (1, float("nan"), 1.0), (2, 1.0, 1.0)], "meter int, x double, y double")
    assert {r.meter: r.tau for r in forecast.kendall_correlation(df, "x", "y").collect()} == {1: 1.0, 2: None}


def test_signature_peak(spark):
    df = spark.createDataFrame([(1, [150.0, -50.0], 100.0), (2, [-120.0, 20.0], -100.0), (3, [100.0], 100.0), (4, None, 5.0)], "k int, sig array<double>, tr double")
    assert [r.p for r in df.select("k", eventbased.signature_peak(F.col("sig"), F.col("tr")).alias("p")).orderBy("k").collect()] == [50.0, -20.0, 0.0, None]


def test_trained_chain_decodes(spark):
    values = [0, 200, 1000, 1200] * 25
    rows = lambda vs: spark.createDataFrame([("m", k, float(v), k) for k, v in enumerate(vs)], "meter string, t long, value double, id long")
    parts = {"a": [0, 200, 0, 200] * 25, "b": [0, 0, 1000, 1000] * 25}
    moves = {}
    for n, levels in (("a", [0, 200]), ("b", [0, 1000])):
        got = disaggregate.fhmm_train(rows(parts[n]), levels).orderBy("state").collect()
        assert [r["mean"] for r in got] == levels and [r.start for r in got] == [0.5, 0.5] and all(sum(r.move) == pytest.approx(1) for r in got)
        moves[n] = [list(r.move) for r in got]
    assert moves["a"][0] == [1 / 52, 51 / 52]
    found = disaggregate.fhmm_decode(rows(values), {"a": [0.0, 200.0], "b": [0.0, 1000.0]}, moves=moves).orderBy("t").collect()
    assert [r.a for r in found] == parts["a"] and [r.b for r in found] == parts["b"]
    only = disaggregate.fhmm_train(rows([5.0]), [0, 200]).orderBy("state").collect()
    assert [(r["mean"], r.n, list(r.move)) for r in only] == [(5.0, 1, [0.5, 0.5]), (200.0, 0, [0.5, 0.5])]


def test_partial_results(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), "meter int, ac_type string, start long, end long, kwh double")
    got = energy.combine_partial(part((1, "apparent", 0, 5, 40.0), (1, "apparent", 5, 9, 40.0), (1, "reactive", 0, 9, 50.0))).collect()
    assert sorted((r.ac_type, r.kwh) for r in got) == [("apparent", 80.0), ("reactive", 50.0)]
    with pytest.raises(ValueError):
        energy.combine_partial(part((1, "active", 0, 9, 1.0), (1, "active", 1, 2, 1.0), (1, "active", 4, 20, 1.0)))
    with pytest.raises(KeyError):
        energy.combine_partial(part((1, "other", 0, 9, 1.0)))


def test_predictions_and_cache(spark, tmp_path):
    wide = spark.createDataFrame([("m", 0, 60.0, 0.0), ("m", S, 0.0, 200.0)], "meter string, t long, fridge double, heater double")
    rows, meters = store.predictions(wide, "D", 4, ["fridge", "heater"])
    at = str(tmp_path / "s")
    store.save(rows, at)
    assert sorted((r.meter, r.value) for r in store.load(spark, at).collect()) == [(2, 0.0), (2, 60.0), (3, 0.0), (3, 200.0)]
    assert {(r.meter, r.parent) for r in metadata.edges(meters).collect()} >= {("4/2", "4/1"), ("4/3", "4/1")}
    assert store.cached(spark, at, "span", store.timeframe).count() == store.cached(spark, at, "span", store.timeframe).count() == 2
    assert store.load(spark, at).count() == 4 and store.clear_cache(spark, at, "span") and not store.clear_cache(spark, at, "span")


def test_centres_weigh_every_value_as_often_as_it_is_there(spark):
    rng = np.random.default_rng(5)
    x, n = rng.permutation(3000).astype(float), rng.integers(1, 9, 3000)
    whole = np.repeat(x, n)
    assert np.allclose(disaggregate.kmeans_1d(x, 3, weight=n), disaggregate.kmeans_1d(whole, 3))
    assert np.allclose(eventbased.mean_shift(x, 100, weight=n), eventbased.mean_shift(whole, 100))
    # 3,000 values of one reading each beside two of a million each
    rows = spark.range(3000).selectExpr("id", "double(1000 + id) as value", "1 as n").unionByName(spark.createDataFrame([(3000, 100.0, 1000000), (3001, 900.0, 1000000)], "id long, value double, n int"))
    readings = rows.selectExpr("1 as meter", "id as t", "id", "value", "explode(sequence(1, n)) as _k")
    assert disaggregate.cluster_states(readings).first().states == [0, 100, 905]
    pairs = spark.createDataFrame([(100.0, 0), (140.0, 1)], "w double, many int").selectExpr("1 as meter", "w as on", "-w as off", "explode(sequence(1, if(many = 1, 2000, 2000000))) as _k")
    assert abs(eventbased.pair_centroids(pairs).first().centroid - 100.04) < 0.001
