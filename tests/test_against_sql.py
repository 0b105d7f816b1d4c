"""Queries against their SQL on made-up readings with what the given tables lack: several at one instant, sums that end on a half."""

import datetime
import random

import pytest

import __spark_entry__
from gridloom.operators import disaggregate

duckdb = pytest.importorskip("duckdb")
MONDAY = datetime.datetime(2024, 1, 1)


def written(spark, path, rows) -> str:
    """A folder with `events` of rows (minute, user, value), numbered in their order."""
    kinds = ["click", "view", "purchase", "signup", "error"]
    events = [(i, MONDAY + datetime.timedelta(minutes=m), u, kinds[i % 5], float(v)) for i, (m, u, v) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def both(spark, d: str, name: str) -> tuple[list, list]:
    """The sorted rows of a query and of its SQL."""
    found = __spark_entry__.queries()[name](spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    asked = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return order(found.collect()), order(asked)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory) -> str:
    """Two or three readings of a meter at every instant, rises and falls mixed by their number."""
    rows = [(30 * (k // 7), 1 + k % 3, (k * 7919 % 211) + (k % 4) * 0.25) for k in range(600)]
    return written(spark, tmp_path_factory.mktemp("tied") / "d", rows)


def test_falls_of_one_instant_go_by_number(spark):
    shape = "meter long, t long, id long, transition double"
    paired = lambda rows: [tuple(r) for r in disaggregate.pair_from_falls(spark.createDataFrame(rows, shape)).collect()]
    assert paired([(1, 5, 1, 100.0), (1, 5, 2, -100.0)]) == [(1, 5, 100.0, 5, -100.0)]
    assert paired([(1, 5, 2, 100.0), (1, 5, 1, -100.0)]) == []


def test_falls_at_one_instant_as_in_sql(spark, tied):
    got, want = both(spark, tied, "pairs_from_falls")
    assert got == want and len(got) > 50


def test_falls_by_name_at_one_instant_as_in_sql(spark, tied):
    got, want = both(spark, tied, "sql_fall_pairs")
    assert got == want and len(got) > 50


def test_parameters_of_ties_as_in_sql(spark, tied):
    got, want = both(spark, tied, "switch_parameters")
    assert len(got) == len(want) == 3
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_forecasts_of_nothing_as_in_sql(spark, tmp_path):
    """A day without load forecasts 0: the error over it is infinite, or NaN where there is none."""
    rows = [(1440 * day + k, 1 + k // 2, value) for day in range(3) for k, value in enumerate((0 if day == 1 else 4, 8, 0, 0 if day == 1 else 2, 5, 3))]
    got, want = both(spark, written(spark, tmp_path / "d", rows), "forecast_errors")
    assert [repr(x) for x in got] == [repr(x) for x in want]
    assert {r[0]: repr(r[2]) for r in got} == {1: "inf", 2: "nan", 3: repr(got[2][2])}


@pytest.fixture(scope="module")
def even(spark, tmp_path_factory) -> str:
    """Short series of readings at and halfway between sums of the devices' levels, so that many paths have one score; the means of each building are 24 and 94."""
    rng = random.Random(1)
    devices = [0.0, 12.5, 17.5, 25.5, 30.0, 35.0, 47.5, 60.0, 62.5, 75.0, 77.5, 90.0, 92.5, 95.0, 105.0, 130.0, 155.0, 200.0]
    two = [0.0, 12.0, 24.0, 36.0, 48.0, 47.0, 59.0, 71.0, 94.0, 106.0, 118.0]  # halves of 24 and 94
    rows = []
    for m in range(200):
        some = [rng.choice(devices if m % 10 < 5 else two) for _ in range(12)]
        rows += [(10 * k, m, v) for k, v in enumerate(some)]
    for m in range(5, 10):  # readings that bring the means of buildings of `two` to 24 and 94
        own = [v for _, u, v in rows if u % 10 == m]
        for low, mean in ((True, 24), (False, 94)):
            side = [v for v in own if (v < 50) == low]
            off, k = mean * len(side) - sum(side), 0
            while abs(off) > 0.3 * (len(side) + k):  # the rounded mean may be off by less than a half
                step = max(-24.0, min(24.0, off))
                rows.append((200 + k, 1000 + m, mean + step))
                off, k = off - step, k + 1
    return written(spark, tmp_path_factory.mktemp("even") / "d", rows)


def test_paths_of_one_score_as_in_sql(spark, even):
    got, want = both(spark, even, "fhmm_decode")
    assert got == want and len(got) >= 2400


def test_paths_of_buildings_as_in_sql(spark, even):
    got, want = both(spark, even, "chains_by_building")
    assert got == want and len(got) >= 4800
