"""External columns by place and bucket against a row-by-row version."""

import random

import pytest

from gridloom.sources import store


def plain(rows, external, column):
    """The last known value at or before t, else the first known one."""
    found = []
    for place, t, name in rows:
        known = sorted((u, e[column]) for p, u, *e in external if p == place and u is not None and e[column] is not None)
        past = [x for x in known if t is not None and x[0] <= t]
        found.append((place, t, name, max(x for x in past if x[0] == past[-1][0])[1] if past else max(x for x in known if x[0] == known[0][0])[1] if known else None))
    return found


@pytest.mark.parametrize("bucket", [1, 10, 1000])
def test_external_columns(spark, bucket):
    rng = random.Random(6)
    maybe = lambda x: None if rng.random() < 0.3 else x
    external = [(p, rng.randrange(-60, 100), maybe(rng.randrange(9) / 2), maybe(str(rng.randrange(5)))) for p in ("a", "b", None) for _ in range(25)] + [("c", 5, None, "x"), ("a", None, 99.0, "z")]
    rows = [(p, rng.randrange(-150, 200), f"{p}{k}") for p in ("a", "b", "c", "d", None) for k in range(40)] + [("a", None, "no time"), ("d", None, "neither")]
    rows += rows[:3]
    given = spark.createDataFrame([(*r, 1.0) for r in rows], "zip string, t long, name string, heat double")  # heat is there already and gives way
    got = store.with_external(given, spark.createDataFrame(external, "zip string, t long, heat double, sky string"), "zip", ["heat", "sky"], bucket)
    assert got.columns == ["zip", "t", "name", "heat", "sky"]
    want = [(*h, s[3]) for h, s in zip(plain(rows, external, 0), plain(rows, external, 1))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_nothing(spark):
    rows, external = spark.createDataFrame([("a", 1)], "zip string, t long"), spark.createDataFrame([], "zip string, t long, heat double")
    assert store.with_external(rows.where("false"), external, "zip", ["heat"]).count() == 0
    assert store.with_external(rows, external, "zip", ["heat"]).first().heat is None
