"""Sequential rules over many groups a task, against plain versions a series at a time."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import disaggregate, ordered


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_cross_batches(spark, small_batches):
    class Running:
        """The running sum, and the number of rows at the end."""

        def __init__(self):
            self.n, self.total = 0, 0.0

        def row(self, v):
            self.n, self.total = self.n + 1, self.total + (v or 0.0)
            yield "sum", self.total

        def end(self):
            yield "rows", float(self.n)

    rows = [(None if m == 3 else m, k, float(m + k) if k % 4 else None) for m in range(30) for k in range(1 + m % 13)]
    df = spark.createDataFrame(rows, "meter int, t int, v double").repartition(5)
    got = ordered.scan(df, ["meter"], ["t"], ["v"], Running, "kind string, x double").collect()
    for m in {r[0] for r in rows}:
        own = [v or 0.0 for a, _, v in sorted((r for r in rows if r[0] == m), key=lambda r: r[1])]
        assert [r.x for r in got if r.meter == m and r.kind == "sum"] == [sum(own[: k + 1]) for k in range(len(own))]
        assert [r.x for r in got if r.meter == m and r.kind == "rows"] == [len(own)]
    assert ordered.scan(df.limit(0), ["meter"], ["t"], ["v"], Running, "kind string, x double").count() == 0


def plain_from_falls(rows, tolerance=100, share=0.035, large=1000):
    used, out = set(), []
    for j in range(len(rows) - 1, -1, -1):
        fall, undone = rows[j][1], 0.0
        if fall >= 0:
            continue
        for i in range(j - 1, -1, -1):
            v = rows[i][1]
            near = tolerance if abs(v - fall) < large else share * max(abs(v), abs(fall))
            if v > 0 and i not in used and abs(v + fall) < near:
                used.add(i)
                out.append((*rows[i], *rows[j]))
                break
            undone -= v
            if undone < fall - near:
                break
    return sorted(out)


def plain_accepted(rows):
    taken = []
    for a, b, p in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, p))
    return sorted(taken)


def test_pairs_of_random_series(spark, small_batches):
    rnd = random.Random(3)
    series = {m: [(t, float(rnd.choice([-1, 1]) * rnd.choice([60, 100, 150, 400, 1500, 3000]) + rnd.randint(-40, 40))) for t in range(rnd.randint(1, 40))] for m in range(200)}
    df = spark.createDataFrame([(m, t, v) for m, x in series.items() for t, v in x] + [(0, 99, None), (1, 99, float("nan"))], "meter long, t long, transition double")
    got = {}
    for r in disaggregate.pair_from_falls(df).collect():
        got.setdefault(r.meter, []).append(tuple(r)[1:])
    ring = {}
    for r in disaggregate.pair_transitions(df).collect():
        ring.setdefault(r.meter, []).append(tuple(r)[1:])
    for m, x in series.items():
        assert sorted(got.get(m, [])) == plain_from_falls(x)
        assert sorted(ring.get(m, [])) == sorted(disaggregate.pair_in_buffer([], x, 20, 100, 0.035, 1000)[0])


def test_accepted_of_random_spans(spark, small_batches):
    rnd = random.Random(4)
    rows = [(m, a, a + rnd.randint(1, 30), float(rnd.randint(1, 9))) for m in range(40) for a in (rnd.randint(0, 200) for _ in range(rnd.randint(1, 40)))]
    rows = sorted(set(rows))
    got = disaggregate.accept_pairs(spark.createDataFrame(rows, "meter long, on_t long, off_t long, likelihood double")).collect()
    for m in range(40):
        assert sorted(tuple(r)[1:] for r in got if r.meter == m) == plain_accepted([r[1:] for r in rows if r[0] == m])


def test_no_second_shuffle(spark):
    """Readings that a window by meter has sorted are paired where they lie."""
    df = spark.range(1000).select((F.col("id") % 7).alias("meter"), F.col("id").alias("t"), "id", F.when(F.expr("id div 7 div 3 % 2 = 0"), 300.0).otherwise(0.0).alias("value"))
    found = disaggregate.steady_states(df, emit_only=True)
    assert disaggregate.pair_transitions(found)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
