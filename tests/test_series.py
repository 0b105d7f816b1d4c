"""Golden numbers, interval algebra against a bitmap, partition invariance, and every registered query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.operators import activations, disaggregate, energy, intervals, metrics, resample, sections
from gridloom.plans import registry
from gridloom.sources import converters, store
from gridloom.streaming import stateful

US = 1_000_000
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ACTIVE = [0, 0, 0, 100, 100, 100, 150, 150, 200, 0, 0, 100, 5000, 0]


def readings(spark, rows):
    return spark.createDataFrame([(m, int(t * US), None if v is None else float(v), i) for i, (m, t, v) in enumerate(rows)], "meter long, t long, value double, id long")


def spans(df):
    return sorted((r.meter, r.start / US, r.end / US) for r in df.collect())


def test_energy_of_the_reference_series(spark):
    r = readings(spark, [(1, 10 * i, v) for i, v in enumerate(ACTIVE)])
    assert energy.total_energy(r, 15).first().kwh == pytest.approx(0.0163888888889)


def test_dropout_of_the_irregular_series(spark):
    at = [0, 10, 20, 30, 200, 210, 220, 230, 240, 249, 260, 270, 290, 1000]
    assert energy.dropout_rate(readings(spark, [(1, t, 1) for t in at]), 10).first().rate == pytest.approx(0.861386138614)


def test_good_sections_and_nulls(spark):
    rows = [(1, t, None if t == 25 else 1.0) for t in (0, 10, 20, 25, 30, 60, 100, 110, 200)] + [(2, 5, float("nan"))]
    assert spans(sections.good_sections(readings(spark, rows), 10)) == [(1, 0, 30), (1, 100, 110)]


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_partition_invariance(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, registry.queries()["uptime_per_meter"](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(map(tuple, registry.queries()["uptime_per_meter"](spark, SF).collect()))


def test_interval_algebra_against_a_bitmap(spark):
    rng = random.Random(3)

    def some():
        cuts = sorted(rng.sample(range(60), 10))
        return list(zip(cuts[::2], cuts[1::2]))

    sets = {m: (some(), some()) for m in range(12)}
    frame = lambda k: spark.createDataFrame([(m, a * US, b * US) for m, s in sets.items() for a, b in s[k]], "meter long, start long, end long")
    a, b = frame(0), frame(1)

    def seconds(df):
        return {(m, t) for m, s, e in spans(df) for t in range(int(s), int(e))}

    on = [{(m, t) for m, s in sets.items() for x, y in s[k] for t in range(x, y)} for k in (0, 1)]
    assert seconds(intervals.union(a, b)) == on[0] | on[1]
    assert seconds(intervals.intersect(a, b)) == on[0] & on[1]
    assert seconds(intervals.difference(a, b)) == on[0] - on[1]
    assert seconds(intervals.invert(a, 0, 60 * US)) == {(m, t) for m in sets for t in range(60)} - on[0]
    assert seconds(intervals.split(a, 2)) == on[0] and all(e - s <= 2 for _, s, e in spans(intervals.split(a, 2)))
    inner = {(m, t) for m, s in sets.items() for t in range(min(s[0][0][0], s[1][0][0]), max(s[0][-1][1], s[1][-1][1]))}
    assert seconds(intervals.matching(a, b)) == {x for x in inner if (x in on[0]) == (x in on[1])}


def test_activations_bridge_and_borders(spark):
    v = [9, 0, 9, 9, 0, 9, 0, 0, 0, 9, 0, 9]
    r = readings(spark, [(1, i, x) for i, x in enumerate(v)])
    assert spans(activations.activations(r, 5)) == [(1, 2, 4), (1, 5, 6), (1, 9, 10)]
    found = activations.activations(r, 5, min_off_s=2)
    assert spans(found) == [(1, 2, 6), (1, 9, 10)]
    rows = sorted((x.start // US, x.t // US) for x in activations.bordered(r, found).collect())
    assert [t for s, t in rows if s == 2] == [0, 1, 2, 3, 4, 5, 6] and [t for s, t in rows if s == 9] == [7, 8, 9, 10]


def plain_states(rows, noise, state, emit_only):
    """The rule row by row: (time, change, level)."""
    est = last = prev = 0.0
    n, ongoing, cur, out = 0, False, rows[0][0], []
    for t, v in rows:
        change = abs(v - prev) > state
        if change and not ongoing:
            hit = abs(est - last) > noise
            if hit:
                out.append((cur, round(est - last, 6), round(est, 6)))
            if hit or not emit_only:
                last = est
            cur = t
        n = 0 if change else n
        est = (n * est + v) / (n + 1)
        n, ongoing, prev = n + 1, change, v
    if abs(est - last) > noise:
        out.append((cur, round(est - last, 6), round(est, 6)))
    return out[1:] if out and out[0][0] == rows[0][0] and out[0][2] > noise else out


@pytest.mark.parametrize("emit_only", [False, True])
def test_steady_states_against_the_rule_row_by_row(spark, emit_only):
    rng = random.Random(3)
    series = {m: [(i, float(rng.choice([0, 5, 40, 90, 100, 130, 300]))) for i in range(rng.randint(1, 60))] for m in range(60)}
    got = disaggregate.steady_states(readings(spark, [(m, t, v) for m, rows in series.items() for t, v in rows]), 70, 15, emit_only).collect()
    for m, rows in series.items():
        mine = sorted((r.t // US, round(r.transition, 6), round(r.level, 6)) for r in got if r.meter == m)
        assert mine == sorted(plain_states(rows, 70, 15, emit_only)), (m, rows)


def test_steady_states_and_pairs(spark):
    v = [0] * 5 + [200] * 5 + [0] * 5
    found = disaggregate.steady_states(readings(spark, [(1, i, x) for i, x in enumerate(v)]))
    assert [(r.t // US, r.transition) for r in found.orderBy("t").collect()] == [(5, 200.0), (10, -200.0)]
    assert [(r.on_t // US, r.off_t // US) for r in disaggregate.pair_transitions(found).collect()] == [(5, 10)]


def test_disaggregation_recovers_separable_devices(spark):
    states = {"a": [0.0, 100.0], "b": [0.0, 30.0, 60.0]}
    truth = [(100.0 * (i // 3 % 2), 30.0 * (i // 5 % 3)) for i in range(60)]
    mains = readings(spark, [(1, i, a + b) for i, (a, b) in enumerate(truth)])
    for found in (disaggregate.co_predict(mains, states), disaggregate.fhmm_decode(mains, states)):
        assert [(r.a, r.b) for r in found.orderBy("t").collect()] == truth
    assert disaggregate.cluster_states(readings(spark, [(1, i, [0, 50, 120][i % 3]) for i in range(90)])).first().states == [0, 50, 120]


def test_scores_of_a_perfect_prediction(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 8, 9)], "meter long, start long, end long")
    c = intervals.confusion(s, s, spark.createDataFrame([(1, 0, 10)], "meter long, start long, end long"))
    assert tuple(metrics.durations(c).first())[1:] == (1.0, 1.0, 1.0, 1.0, 1.0)
    best = metrics.prematch(spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (2, 1, -0.1)], "pred int, truth int, mcc double"))
    assert [tuple(r) for r in best.collect()] == [(1, 2, 0.9)]


def test_nearest_prefers_the_larger(spark):
    df = spark.createDataFrame([(2.0,), (2.1,)], "x double")
    assert [r[0] for r in df.select(resample.nearest(F.array(F.lit(1.0), F.lit(3.0)), F.col("x"))).collect()] == [3.0, 3.0]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_store_round_trip(spark, tmp_path, fmt):
    rows = spark.sql("select 'D' dataset, 1 building, 2 meter, timestamp_seconds(id) ts, 'power' physical_quantity, 'active' ac_type, cast(id as double) value from range(100)")
    store.save(rows, str(tmp_path / "x"), fmt)
    got = store.load(spark, str(tmp_path / "x"), fmt, "1970-01-01 00:00:10", "1970-01-01 00:00:20")
    assert got.count() == 10 and got.agg(F.sum("value")).first()[0] == 145.0


def test_channel_files(spark, tmp_path):
    (tmp_path / "house_1").mkdir()
    (tmp_path / "house_1" / "channel_1.dat").write_text("10 5.5\n11 6\n")
    (tmp_path / "house_1" / "channel_3.dat").write_text("10 7\n")
    got = sorted((r.building, r.meter, r.ac_type, r.value) for r in converters.redd(spark, str(tmp_path)).collect())
    assert got == [(1, 1, "apparent", 5.5), (1, 1, "apparent", 6.0), (1, 3, "active", 7.0)]


def test_streamed_sections_equal_batch(spark, tmp_path):
    ev = store.events(spark, SF)
    ev.select("meter", F.timestamp_micros("t").alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("meter long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(-1, 4102444800, 1.0)], "meter long, s long, value double").select("meter", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stateful.good_sections(stream, 21600).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("select meter, unix_micros(start), unix_micros(end) from streamed").collect()))
    assert got == sorted(map(tuple, sections.good_sections(ev, 21600).collect()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in r)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) for x in a + b) else a == b


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
