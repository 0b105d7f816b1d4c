"""Wiring, information, profiles, simulation, clusters, metadata, sections of stores and readers of more data sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cluster, disaggregate, forecast, information, simulate, wiring
from gridloom.sources import converters, metadata, store
from gridloom.streaming import stateful

EDGES = "meter string, parent string"


def test_wiring_chain_and_unknown_parent(spark):
    rows = [("1", None), ("2", "1"), ("3", "2"), ("9", "8")] + [(f"x{k}", f"x{k - 1}" if k else None) for k in range(40)]
    got = {r.meter: (r.root, r.depth) for r in wiring.wiring_tree(spark.createDataFrame(rows, EDGES)).collect()}
    assert got["3"] == ("1", 2) and got["2"] == ("1", 1) and got["9"] == ("8", 1) and got["8"] == ("8", 0) and got["x39"] == ("x0", 39)
    assert len(got) == len(rows) + 1


def test_wiring_ring_and_empty(spark):
    assert wiring.wiring_tree(spark.createDataFrame([], EDGES)).count() == 0
    with pytest.raises(ValueError):
        wiring.wiring_tree(spark.createDataFrame([("a", "b"), ("b", "a")], EDGES), 4)


def test_remainder(spark):
    got = dict(map(tuple, wiring.with_remainder(spark.createDataFrame([(1, 10.0), (2, 3.0), (3, 4.5)], "meter long, kwh double"), 1).collect()))
    assert got == {"2": 3.0, "3": 4.5, "remainder": 2.5}


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def test_entropy_against_brute_force(spark):
    rng = random.Random(1)
    x = [rng.choice([rng.gauss(0, 1), 2.0]) for _ in range(200)]
    rows = [(1, k, v, k) for k, v in enumerate(x)] + [(2, 0, 1.0, 0), (2, 1, None, 1)]
    got = {r.meter: r for r in information.entropy_per_meter(spark.createDataFrame(rows, "meter long, t long, value double, id long")).collect()}
    z = [v + 1e-10 * ((k * 7919) % 1000003 / 1000003) for k, v in enumerate(x)]
    near = [max(sorted(abs(a - b) for b in z)[3], 1e-15) for a in z]
    want = (digamma(200) - digamma(3) + math.log(2) + sum(map(math.log, near)) / 200) / math.log(2)
    assert got[1].entropy == pytest.approx(want, abs=1e-6) and got[1].n == 200
    assert got[2].entropy is None and got[2].n == 1


def test_load_profile(spark):
    flat = {(x, y): [{"summer": 1.0, "winter": 2.0, "inter": 4.0}[x] + q / 96 for q in range(96)] for x in forecast.SEASONS for y in forecast.DAY_TYPES}
    day = 86400 * 10**6  # 1970-01-01 is a Thursday
    grid = spark.createDataFrame([(1, 20 * day), (1, 65 * day), (1, 201 * day), (1, 3 * day)], "meter long, t long")
    got = {r.t // day: r.pred for r in forecast.load_profile(grid, flat, [1.0] * 366, F.lit(2.0)).collect()}
    assert got[20] == pytest.approx(4.0) and got[65] == pytest.approx(6.0) and got[201] == pytest.approx(2.0)
    assert got[3] == pytest.approx(2 * (4 - 2 * (4 + 366 - 294) / 93))
    with pytest.raises(ValueError):
        forecast.load_profile(grid, flat, [1.0], F.lit(1.0))


def test_simulation_repeats_and_returns_to_nothing(spark):
    once = simulate.transients(spark, 400_000, 3)
    rows = sorted(map(tuple, once.collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        assert rows == sorted(map(tuple, simulate.transients(spark, 400_000, 3).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows != sorted(map(tuple, simulate.transients(spark, 400_000, 4).collect()))
    low = simulate.steps(once).groupBy("meter").agg(F.min("value").alias("low"), F.max_by("value", "t").alias("last")).collect()
    assert low and all(r.low > -1e-6 and abs(r.last) < 1e-6 for r in low)
    assert all(abs(abs(r[3]) - 2000) < 200 for r in rows if r[0] == 2)


def test_clusters(spark):
    rows = [(k, 0.0 if k % 2 else 10.0, (k % 7) / 100) for k in range(40)]
    got = cluster.cluster_vectors(spark.createDataFrame(rows, "meter long, a double, b double"), ["a"], 5).collect()
    assert len({(r.a, r.cluster) for r in got}) == 2
    one = cluster.cluster_vectors(spark.createDataFrame([(1, None), (2, None)], "meter long, a double"), ["a"])
    assert [r.cluster for r in one.collect()] == [0, 0]
    mixed = cluster.gaussian_mixture(spark.createDataFrame([(k, (k % 2) * 50 + random.Random(k).gauss(0, 1)) for k in range(200)], "id long, v double"), ["v"], 2).collect()
    assert len({(r.v > 25, r.component) for r in mixed}) == 2 and all(r.p > 0.99 for r in mixed)


BUILDING = """{"instance": 2, "elec_meters": {"1": {"site_meter": true, "device_model": "m"}, "2": {"submeter_of": 0}, "3": {"submeter_of": 2}},
"appliances": [{"type": "fridge", "meters": [2], "on_power_threshold": 50, "min_on_duration": 30}, {"type": "lamp", "meters": [2, 3]}]}"""
DEVICE = '{"m": {"sample_period": 10, "max_sample_period": 15, "measurements": [{"physical_quantity": "power", "type": "active", "lower_limit": 0, "upper_limit": 6000}, {"physical_quantity": "voltage", "type": ""}]}}'


def test_metadata(spark, tmp_path):
    (tmp_path / "building2.json").write_text(BUILDING)
    (tmp_path / "meter_devices.json").write_text(DEVICE)
    (tmp_path / "dataset.json").write_text("{}")
    found = metadata.tables(spark, str(tmp_path))
    metadata.save(found, str(tmp_path / "saved"))
    found = metadata.load(spark, str(tmp_path / "saved"))
    assert sorted((r.meter, r.parent) for r in metadata.edges(found["meters"]).collect()) == [("2/1", None), ("2/2", "2/1"), ("2/3", "2/2")]
    assert sorted(map(tuple, metadata.on_thresholds(found["meters"], found["appliances"]).collect())) == [(2, 1, 10.0, 0.0, 0.0), (2, 2, 10.0, 30.0, 0.0), (2, 3, 10.0, 0.0, 0.0)]
    device = found["devices"].first()
    assert device.max_sample_period == 15 and [m.ac_type for m in device.measurements] == ["active", None]


def test_sections_of_a_store(spark):
    rows = spark.createDataFrame([(m, t, float(t)) for m in (1, 2) for t in range(10)], "meter long, t long, value double")
    sections = spark.createDataFrame([(1, 2, 4), (1, 3, 5), (1, 8, 8), (2, 9, 20)], "meter long, start long, end long")
    got = sorted((r.meter, r.t, r.ahead_1) for r in store.load_sections(rows, sections, 1).collect())
    assert got == [(1, 2, 3.0), (1, 3, 4.0), (1, 4, 5.0), (2, 9, None)]


def test_remove_and_children(spark, tmp_path):
    rows = spark.createDataFrame([("d", b, m, 1.0) for b in (1, 2) for m in (1, 2)], "dataset string, building int, meter int, value double").withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    store.save(rows, str(tmp_path / "s"))
    assert store.remove(spark, str(tmp_path / "s"), "d", 1) and not store.remove(spark, str(tmp_path / "s"), "d", 1)
    left = spark.read.parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in store.children(left).collect()] == [("d", 2)] and store.children(left, 2).count() == 2


def test_external_columns(spark):
    rows = spark.createDataFrame([(1, "z", 0), (1, "z", 5), (1, "z", 9), (2, "y", 3)], "meter long, zip string, t long")
    weather = spark.createDataFrame([("z", 2, 20.0), ("z", 5, 21.0)], "zip string, t long, heat double")
    got = sorted((r.meter, r.t, r.heat) for r in store.with_external(rows, weather, "zip", ["heat"]).collect())
    assert got == [(1, 0, 20.0), (1, 5, 21.0), (1, 9, 21.0), (2, 3, None)]


def test_positional_days(spark, tmp_path):
    (tmp_path / "4" / "07").mkdir(parents=True)
    (tmp_path / "4" / "07" / "2012-06-01.csv").write_text("5,230\n-1,231\n7,\n")
    got = sorted((r.building, r.meter, r.ts.second, r.physical_quantity, r.value) for r in converters.positional_days(spark, str(tmp_path), "ECO", {0: ("power", "active"), 1: ("voltage", None)}).collect())
    assert got == [(4, 7, 0, "power", 5.0), (4, 7, 0, "voltage", 230.0), (4, 7, 1, "voltage", 231.0), (4, 7, 2, "power", 7.0)]


def test_coded_rows_and_filled_minutes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,9,2010-01-01,00:00:00,2.5\n2,9,2010-01-01,00:02:00,3\n1,8,2010-01-01,00:00:00,1\n")
    lookup = spark.createDataFrame([(1, 9, 4), (2, 9, 5)], "building int, code int, meter int")
    got = sorted((r.building, r.meter, r.value) for r in converters.coded_long(spark, str(tmp_path / "a.csv"), "HES", lookup).collect())
    assert got == [(1, 4, 25.0), (2, 5, 30.0)]
    rows = spark.createDataFrame([("d", 1, 1, s, q, None, v) for s, v in ((0, 2.0), (0, 4.0), (30, 6.0), (150, 9.0)) for q in ("power", "voltage")], "dataset string, building int, meter int, s long, physical_quantity string, ac_type string, value double")
    filled = converters.filled_minutes(rows.withColumn("ts", F.timestamp_seconds("s")).drop("s"))
    assert sorted((r.physical_quantity, r.ts.minute, r.value) for r in filled.collect()) == [("power", 0, 4.0), ("power", 1, 0.0), ("power", 2, 9.0), ("voltage", 0, 4.0), ("voltage", 1, 6.5), ("voltage", 2, 9.0)]


def test_pairing_from_falls(spark):
    rows = [(1, 0, 200.0), (1, 10, 210.0), (1, 20, -205.0), (1, 30, -195.0), (2, 0, 100.0)]
    got = sorted((r.meter, r.on_t, r.off_t) for r in disaggregate.pair_from_falls(spark.createDataFrame(rows, "meter long, t long, transition double")).collect())
    assert got == [(1, 0, 20), (1, 10, 30)]


def test_accepted_pairs_do_not_overlap(spark):
    rows = [(1, 0, 10, 0.5), (1, 5, 8, 0.9), (1, 8, 12, 0.4), (1, 0, 5, 0.4), (1, 20, 30, 0.01)]
    got = sorted((r.on_t, r.off_t) for r in disaggregate.accept_pairs(spark.createDataFrame(rows, "meter long, on_t long, off_t long, likelihood double"), 0.1).collect())
    assert got == [(0, 5), (5, 8), (8, 12)]


def test_centroid_states_and_filled_power(spark):
    centroids = {"fridge": 90.0, "heater": 2000.0}
    steps = spark.createDataFrame([(1, 2, 95.0), (1, 4, 1900.0), (1, 6, -92.0)], "meter long, t long, transition double")
    states = disaggregate.centroid_states(steps, centroids)
    assert sorted((r.t, r.device, r.state) for r in states.collect()) == [(2, "fridge", 1), (4, "heater", 1), (6, "fridge", 0)]
    readings = spark.createDataFrame([(1, t, 1.0, t) for t in range(8)], "meter long, t long, value double, id long")
    got = {(r.device, r.t): r.power for r in disaggregate.filled_power(readings, states, centroids).collect()}
    assert [got["fridge", t] for t in range(8)] == [0, 0, 0, 90, 90, 90, 90, 0]
    assert [got["heater", t] for t in range(8)] == [0, 0, 0, 0, 0, 2000, 2000, 2000]


def test_streamed_pairs_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(m, 10 * k + m, rng.choice([-1, 1]) * rng.choice([60.0, 300.0, 1500.0]) + rng.gauss(0, 5)) for m in (1, 2, 3) for k in range(90)]
    kind = "meter long, t long, transition double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if part * 300 <= r[1] - r[0] < part * 300 + 300], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.pair_transitions(stream).writeStream.format("memory").queryName("pairs_streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, disaggregate.pair_transitions(spark.createDataFrame(rows, kind)).collect()))
    assert want and sorted(map(tuple, spark.sql("select * from pairs_streamed").collect())) == want


@pytest.mark.parametrize("seed", range(20))
def test_buffer_pairs_against_all_distances(seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice([-1, 1]) * rng.choice([60.0, 300.0, 1500.0, 4000.0]) + rng.gauss(0, 60)) for k in range(200)]
    want, held = [], []
    for t, p in rows:
        if len(held) == 6:
            free = [x for x in held if not x["used"]]
            held = free if len(free) < 6 else free[1:]
        held.append({"t": t, "p": p, "used": False})
        for far in range(1, 6):
            for i in range(len(held) - far):
                x, y = held[i], held[i + far]
                top = max(abs(x["p"]), abs(y["p"]))
                if x["p"] > 0 > y["p"] and not x["used"] and not y["used"] and abs(x["p"] + y["p"]) < (100 if top < 1000 else 0.035 * top):
                    x["used"] = y["used"] = True
                    want.append((x["t"], x["p"], y["t"], y["p"]))
    assert disaggregate.pair_in_buffer([], rows, 6, 100, 0.035, 1000)[0] == want
