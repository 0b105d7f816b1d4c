"""Running totals across ranges; neighbours in the plane and mutual information against brute force, for any size of cells."""

import math

import numpy as np
import pytest

from gridloom.operators import information, ranks

KINDS = "meter string, id long, x double, y double"


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def plain(points, k):
    """Every point against every other."""
    x, y = (np.array([p[c] + 1e-10 * ((p[0] * 7919) % 1000003 / 1000003) for p in points]) for c in (1, 2))
    far = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    np.fill_diagonal(far, np.inf)
    r = np.sort(far, axis=1)[:, k - 1]
    count = lambda v: [max(1, ((v >= a - (b - 1e-15)) & (v <= a + (b - 1e-15))).sum()) for a, b in zip(v, r)]
    mean = lambda v: sum(map(digamma, count(v))) / len(v)
    return r, (digamma(k) + digamma(len(x)) - mean(x) - mean(y)) / math.log(2)


def clouds():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 900))
    flat = np.round(rng.exponential(5, 500))
    return {
        "near": list(zip(a, 0.9 * a + math.sqrt(0.19) * b)),
        "none": list(zip(a[:400], b[:400])),
        "cross": [(v, 0.0) for v in a[:200]] + [(0.0, v) for v in b[:200]],  # half of the points on each axis
        "flat": [(v, 7.0) for v in a[:300]],
        "ties": list(zip(flat, np.round(flat / 3))),
        "far": [(v, w) for v, w in zip(a[:200] * 1e-3, b[:200] * 1e-3)] + [(1e6 * u, -1e6) for u in range(1, 5)],
        "one": [(2.0, 2.0)] * 50,
        "few": [(1.0, 2.0)] * 3,
    }


def test_before(spark):
    rows = [(m, v, k) for k, (m, v) in enumerate((m, v) for m, n in (("a", 300), ("b", 1), ("c", 40)) for v in [i * 7 % 50 for i in range(n)])]
    df = spark.createDataFrame([*rows, (None, 1, 999)], "meter string, v long, id long")
    got = {r.id: (r._before, r._all) for r in ranks.before(df.repartition(7), ["meter"], ["v", "id"], "v").collect()}
    assert len(got) == len(rows)
    for m, v, k in rows:
        own = [(w, j) for n, w, j in rows if n == m]
        assert got[k] == (sum(w for w, j in own if (w, j) < (v, k)), sum(w for w, _ in own))


def test_before_of_nothing(spark):
    assert ranks.before(spark.createDataFrame([], "meter string, v long"), ["meter"], ["v"]).count() == 0


@pytest.mark.parametrize("cell", [16, 60, 5000])
def test_any_cells_give_the_plain_result(spark, cell):
    given = {m: [(k, float(a), float(b)) for k, (a, b) in enumerate(p)] for m, p in clouds().items()}
    rows = [(m, *p) for m, points in given.items() for p in points]
    odd = [("near", 1, None, 1.0), ("near", 2, float("nan"), 1.0), ("near", 3, 1.0, float("inf")), (None, 4, 1.0, 1.0), ("gone", 5, None, None)]
    found = {r.meter: (r.mi, r.n) for r in information.mutual_information(spark.createDataFrame([*rows, *odd], KINDS), cell=cell).collect()}
    assert set(found) == set(given)
    for m, points in given.items():
        assert found[m][1] == len(points)
        assert found[m][0] == (None if m == "few" else pytest.approx(plain(points, 3)[1], abs=1e-6)), m


def test_radii(spark):
    given = [(k, float(a), float(b)) for k, (a, b) in enumerate(clouds()["far"])]
    rows = spark.createDataFrame([("m", k, a + 1e-10 * ((k * 7919) % 1000003 / 1000003), b + 1e-10 * ((k * 7919) % 1000003 / 1000003)) for k, a, b in given], KINDS)
    for asked in (20_000, 7):  # copies of the cells that many ask
        got = sorted(r.radius for r in information.radii(rows, ["meter"], 4, 20, asked).collect())
        assert got == pytest.approx(sorted(plain(given, 4)[0]))


def test_pairs_of_meters(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(120)
    series = {"a": base, "b": base * 2 + rng.standard_normal(120) / 5, "c": rng.standard_normal(120)}
    rows = [(m, t, float(v)) for m, vs in series.items() for t, v in enumerate(vs) if m != "c" or t % 2] + [("a", 0, float(base[0])), ("d", 5, 1.0), ("e", 999, 1.0), ("b", 7000, None)]
    got = {(r.meter_a, r.meter_b): (r.mi, r.n) for r in information.pairwise_mutual_information(spark.createDataFrame(rows, "meter string, t long, value double"), cell=16).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    assert got["a", "d"] == (None, 1) and got["a", "c"][1] == 60
    want = plain([(t, float(x), float(y)) for t, (x, y) in enumerate(zip(series["a"], series["b"]))], 3)[1]
    assert got["a", "b"] == (pytest.approx(want, abs=1e-6), 120)
    assert got["a", "b"][0] > 1 > got["a", "c"][0]
