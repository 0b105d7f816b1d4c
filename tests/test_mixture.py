"""Mixtures by EM against a plain version, with and without emphasis."""

import numpy as np
import pytest

from gridloom.operators import eventbased, mixture


def plain_em(x, weight, mean, cov, wide, tolerance, rounds=100):
    """One loop over all rows at once, straight from the definition."""
    weight, mean, cov = weight.copy(), mean.copy(), cov.copy()
    before = -np.inf
    for _ in range(rounds):
        density = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(weight, mean, cov)], axis=1)
        ll = np.log(density.sum(axis=1)).sum()
        if abs(ll - before) <= tolerance * len(x):
            break
        before = ll
        r = density / density.sum(axis=1, keepdims=True)
        weight = r.mean(axis=0)
        mean = r.T @ x / r.sum(axis=0)[:, None]
        cov = np.stack([((r[:, k, None] * (x - m)).T @ (x - m) / r[:, k].sum() + 1e-6 * np.eye(x.shape[1])) * np.outer(wide, wide) for k, m in enumerate(mean)])
    return weight, mean, cov, ll


@pytest.fixture(scope="module")
def crossed(spark):
    """Two groups by x, other two by y, which is told apart better."""
    rng = np.random.default_rng(3)
    x = np.stack([np.where(np.arange(600) % 2 == 0, 0.0, 9.0) + rng.normal(size=600) * 2, np.where(np.arange(600) % 3 == 0, 0.0, 14.0) + rng.normal(size=600) * 2], axis=1)
    return x, spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double").repartition(5)


@pytest.mark.parametrize("emphasis", [None, {"x": 100.0}, {"y": 30.0}, {"x": 2.0, "y": 0.5}])
def test_em_as_a_plain_version_and_emphasis_changes_labels(crossed, emphasis):
    x, rows = crossed
    start = mixture.Mixture(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [9.0, 14.0]]), np.stack([np.eye(2) * 9] * 2))
    wide = mixture.widening(["x", "y"], emphasis)
    weight, mean, cov, ll = plain_em(x, *start, wide, 1e-6)
    model, got, n = mixture.fit(rows, ["x", "y"], [2], emphasis, tolerance=1e-6, starts={2: start})[2]
    assert n == 600 and abs(got - ll) < 1e-5 * abs(ll)
    assert np.allclose(model.weight, weight, atol=1e-6) and np.allclose(model.mean, mean, atol=1e-5) and np.allclose(model.cov, cov, rtol=1e-5, atol=1e-5)
    density = mixture.joint(x, mixture.Mixture(weight, mean, cov))
    labels = {r.id: (r.component, r._sure, r._far) for r in mixture.placed(rows, ["x", "y"], model).collect()}
    p = mixture.posterior(x, mixture.Mixture(weight, mean, cov))[0]
    assert [labels[i][0] for i in range(600)] == density.argmax(axis=1).tolist()
    assert np.allclose([labels[i][1] for i in range(600)], p.max(axis=1), atol=1e-5)


def test_emphasis_decides_which_groups_are_found(crossed):
    x, rows = crossed
    share = {}
    for name, emphasis in (("x", {"x": 400.0}), ("y", {"y": 400.0})):
        found = {r.id: r.component for r in eventbased.mixture_by_bic(rows, ["x", "y"], 2, emphasis=emphasis).collect()}
        own = np.array([found[i] for i in range(600)])
        by = lambda truth: max((own == truth).mean(), (own != truth).mean())
        share[name] = by(np.arange(600) % 2 == 0), by(np.arange(600) % 3 == 0)
    assert share["x"][0] > 0.9 > share["x"][1] and share["y"][1] > 0.9 > share["y"][0]


def test_hostile_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, 5.0)] + [(k, 100.0) for k in range(4, 60)], "id long, w double")
    found = eventbased.mixture_by_bic(rows, ["w"], 3).collect()
    assert len(found) == 59 and len({r.component for r in found if r.id > 3}) == 1
    assert mixture.fit(rows.where("false"), ["w"], [1, 2]) == {}
    with pytest.raises(ValueError):
        mixture.widening(["w"], {"v": 2.0})
    with pytest.raises(ValueError):
        mixture.widening(["w"], {"w": 0.0})
