"""Selection of meters, measurements, and the small functions: what SQL can't show, as errors and golden cases."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import measurement, scalars
from gridloom.operators import energy, forecast, intervals, metrics, resample, selection
from gridloom.sources import store

US = 1_000_000


@pytest.fixture(scope="module")
def meters(spark):
    rows = [("x", 1, 1, "a", True, False, ["main"]), ("x", 1, 2, "b", False, False, ["dry", "wet"]), ("x", 1, 3, "b", False, None, ["wet"]), ("x", 1, 4, "a", True, True, None)]
    return spark.createDataFrame(rows, "dataset string, building int, meter int, device_model string, site_meter boolean, disabled boolean, tags array<string>")


@pytest.fixture(scope="module")
def appliances(spark):
    rows = [(1, "fridge", 1, [2], False, "cold"), (1, "fridge", 2, [3], False, "cold"), (1, "washer dryer", 1, [2, 3], True, "wet")]
    return spark.createDataFrame(rows, "building int, type string, instance int, meters array<int>, dominant boolean, category string")


def ids(df):
    return sorted(r.meter for r in df.collect())


def test_select(meters, appliances):
    assert ids(selection.select(meters, device_model="b", tags="wet")) == [2, 3]
    assert ids(selection.select(meters, tags=["main", "dry"])) == [1, 2]
    assert ids(selection.select(meters, appliances, category="cold")) == [2, 3]
    assert ids(selection.select_using_appliances(meters, appliances, type="fridge", instance=2)) == [3]
    with pytest.raises(KeyError):
        selection.select(meters, device_model="z")
    with pytest.raises(KeyError):
        selection.select(meters, colour="red")
    with pytest.raises(ValueError):
        selection.select(meters, device_model=["a", "b"], meter=1)


def test_one(meters, appliances):
    assert ids(selection.one(meters, appliances, 0)) == [1] and ids(selection.one(meters, appliances, 3)) == [3]
    assert ids(selection.one(meters, appliances, "fridge")) == [2] and ids(selection.one(meters, appliances, ("fridge", 2))) == [3]
    assert ids(selection.one(meters, appliances, {"meter": 4})) == [4]
    for key in ("washer dryer", "toaster", 9):
        with pytest.raises(KeyError):
            selection.one(meters, appliances, key)
    with pytest.raises(TypeError):
        selection.one(meters, appliances, 1.5)


def test_groups(meters, appliances):
    assert ids(selection.mains(meters)) == [1] and ids(selection.submeters(meters)) == [2, 3]
    assert ids(selection.mains(selection.with_alternative_mains(meters))) == [4]
    assert ids(selection.mains(selection.enabled(meters, 1, 4))) == [1, 4] and ids(selection.submeters(selection.disabled(meters, 1, 2))) == [3]
    assert ids(selection.union(meters.where("meter < 3"), meters.where("meter > 1"))) == [1, 2, 3, 4]
    assert ids(selection.from_ids(meters, [(1, 2), (1, 4)])) == [2, 4] and ids(selection.mirrored(meters, meters.where("meter = 3"), "x")) == [3]
    with pytest.raises(KeyError):
        selection.from_ids(meters, [(1, 9)])
    assert {r.meter: r.type for r in selection.dominant(appliances).collect()} == {2: "washer dryer", 3: "washer dryer"}
    assert {r.meter: r.label for r in selection.labels(meters, appliances).collect()} == {1: "Site meter", 2: "Fridge, Washer dryer", 3: "Fridge 2, Washer dryer", 4: "Site meter"}
    assert {r.category: [m.meter for m in r.meters] for r in selection.groups(meters, appliances, "category").collect()} == {"wet": [2, 3]}


def test_measurements(spark):
    rows = [(1, 1, "power", "active"), (1, 1, "power", "apparent"), (1, 1, "voltage", ""), (1, 2, "power", "reactive"), (1, 2, "power", "apparent"), (1, 3, "energy", "active")]
    have = spark.createDataFrame(rows, "building int, meter int, physical_quantity string, ac_type string")
    best = lambda **k: {r.meter: r.ac_type for r in measurement.best_ac_type(have, **k).collect()}
    assert best() == {1: "active", 2: "apparent"} and best(mains=["apparent"]) == {1: "apparent", 2: "apparent"} and best(mains=["reactive"]) == {1: "active", 2: "reactive"}
    got = lambda **k: sorted((r.meter, r.physical_quantity, r.ac_type) for r in measurement.resolved(have, **k).collect())
    assert got(physical_quantity="power", ac_type="best") == [(1, "power", "active"), (2, "power", "apparent")]
    assert got(columns=[("voltage", "")]) == [(1, "voltage", "")] and len(got()) == 6
    for bad in ({"physical_quantity": "current"}, {"ac_type": "reactive", "physical_quantity": "energy"}, {"columns": [("power", "x")]}):
        with pytest.raises(measurement.MeasurementError):
            measurement.resolved(have, **bad)
    for bad in ({"physical_quantity": "weight"}, {"ac_type": "odd"}, {"columns": [("voltage", "")], "ac_type": "active"}):
        with pytest.raises(ValueError):
            measurement.resolved(have, **bad)


def test_scalars():
    assert [scalars.period_seconds(a) for a in ("D", "15T", "2H", "W", "30s")] == [86400, 900, 7200, 604800, 30]
    with pytest.raises(ValueError):
        scalars.period_seconds("fortnight")
    assert scalars.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "e": 4}) == {"a": {"b": 3, "c": 2}, "d": 1, "e": 4}
    assert scalars.unsatisfied({"a": {"b": 1}}, {"a": {"b": "ANY VALUE", "c": 1}, "d": {}}) == ["a.c is missing", "d is missing"]


def test_memory_and_frames(spark):
    assert store.memory_bytes(600, 3) == 12_000 and store.memory_bytes(10_000, 3) == 200_000
    with pytest.raises(MemoryError):
        store.check_memory(10_000, 3, 100_000)
    frame = lambda *rows: spark.createDataFrame([(1, a, b) for a, b in rows], "meter long, start long, end long")
    a, b = frame((0, 10), (100, 110)), frame((10, 20), (111 * US, 112 * US), (90, 100))
    assert sorted((r.a_start, r.b_start) for r in intervals.adjacent(a, b).collect()) == [(0, 10), (100, 90)]
    assert intervals.adjacent(frame((0, US)), frame((3 * US, 4 * US)), 1).count() == 0 and intervals.adjacent(frame((0, US)), frame((3 * US, 4 * US)), 2).count() == 1
    assert sorted((r.start, r.end) for r in intervals.contained(frame((1, 2), (5, 9), (20, 21)), frame((0, 8), (20, 30))).collect()) == [(1, 2), (20, 21)]
    with pytest.raises(ValueError):
        intervals.check_no_overlap(frame((0, 5), (4, 6)))
    assert intervals.check_no_overlap(frame((0, 5), (5, 6))).count() == 2
    open_ends = spark.createDataFrame([(1, None, 5), (1, 7, None), (1, 9, 9)], "meter long, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.bounded(open_ends, 0, 10).collect()) == [(0, 5), (7, 10)]
    assert intervals.time_span(frame((0, 5)).unionByName(frame((6, 9)).withColumn("meter", F.lit(2).cast("long")))).count() == 0


def test_features_and_errors(spark):
    grid = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "meter long, t long, value double")
    r = {(x.t, x.horizon): (x.target, x.target_3, x.last_0) for x in forecast.horizon_features(grid, [3], [0], [1, 2]).collect()}
    assert r[(4, 2)] == (6.0, 3.0, 4.0) and r[(2, 1)] == (3.0, 0.0, 2.0) and (1, 1) not in r and (7, 1) not in r
    with pytest.raises(ValueError):
        forecast.horizon_features(grid, [1], [0], [2])
    with pytest.raises(ValueError):
        energy.activity_bins(grid, 1, 100, 30)
    with pytest.raises(KeyError):
        metrics.per_appliance(["beauty"])
    sample = forecast.classification_sample(spark, 100, 4, 3, 1)
    assert sample.collect() == forecast.classification_sample(spark, 100, 4, 3, 1).repartition(7).orderBy("id").collect() and {r.label for r in sample.collect()} == {0, 1, 2}
    assert resample.spectrum(grid, 8).where("k = 0").first().magnitude == pytest.approx(28)
    long = spark.range(40_000).selectExpr("1L as meter", "id * 1000000 as t", "cast(id % 7 as double) as value", "id")
    assert resample.linear(long, 30).count() == 1334


def test_messages(spark, tmp_path):
    from gridloom.streaming import messages

    lines = ['{"type": "reading", "content": {"meter": 1, "ts": "2024-01-01T00:00:00Z", "value": 2.5}}', '{"type": "note", "content": {"text": "hello"}}', "no json", '{"type": "reading", "content": {"meter": 2, "value": "x"}}', '{"type": "odd"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    table = spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    assert {(r.meter, r.value) for r in messages.of_type(table, "reading", messages.READING).collect()} == {(1, 2.5), (2, None)}
    assert sorted(r.body for r in messages.broken(table, ["reading", "note"]).collect()) == ["no json", '{"type": "odd"}']
    seen = {}
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "body")
    handlers = {"reading": (messages.READING, lambda rows, n: seen.setdefault("reading", []).extend(r.meter for r in rows.collect())), "note": ("text string", lambda rows, n: seen.setdefault("note", []).extend(r.text for r in rows.collect()))}
    q = messages.subscribe(stream, handlers, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen["reading"]) == [1, 2] and seen["note"] == ["hello"]


def test_groups_with_a_member(meters, spark):
    groups = spark.createDataFrame([("p", [(1, 1), (1, 2)]), ("q", [(1, 4)])], "name string, meters array<struct<building:int,meter:int>>")
    assert [r.name for r in selection.groups_with(groups, meters, device_model="b").collect()] == ["p"]


def test_mixtures(spark):
    from gridloom.operators import eventbased

    rows = [(i, [100.0, 100.0, 400.0][i % 3] + i % 5 * 0.1, [5.0, 60.0, 5.0][i % 3] + i % 4 * 0.1) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, y double").coalesce(1)
    got = {r.id: r.component for r in eventbased.mixture_by_bic(df, ["x", "y"], 2, emphasis={"x": 2.0}, criterion="aic").collect()}
    assert len({got[i] for i in range(0, 120, 3)}) == 1 and got[0] != got[2]
    two = {r.id: r.component for r in eventbased.mixture_in_two(df, ["x"], ["y"], (2, 2)).collect()}
    assert len(two) == 120
    with pytest.raises(ValueError):
        eventbased.mixture_by_bic(df, ["x"], criterion="mdl")


def test_yaml_metadata(spark, tmp_path):
    pytest.importorskip("yaml")
    from gridloom.sources import metadata

    (tmp_path / "building3.yaml").write_text("instance: 3\nelec_meters:\n  1: {site_meter: true, device_model: m}\n  2: {submeter_of: 1}\nappliances:\n- {type: fridge, instance: 1, meters: [2], on_power_threshold: 30}\n")
    (tmp_path / "meter_devices.yaml").write_text("m:\n  sample_period: 6\n  measurements:\n  - {physical_quantity: power, type: active, upper_limit: 5000}\n")
    (tmp_path / "dataset.yaml").write_text("name: x\n")
    found = metadata.tables(spark, str(tmp_path))
    assert [(r.building, r.meter, r.site_meter, r.submeter_of, r.data_location) for r in found["meters"].orderBy("meter").collect()] == [(3, 1, True, None, "/building3/elec/meter1"), (3, 2, False, 1, "/building3/elec/meter2")]
    a = found["appliances"].first()
    assert (a.type, a.meters, a.on_power, a.dominant) == ("fridge", [2], 30.0, False)
    m = found["devices"].first()
    assert (m.model, m.sample_period, m.measurements[0].upper_limit, m.measurements[0].lower_limit) == ("m", 6.0, 5000.0, None)


@pytest.fixture(scope="module")
def shared(spark):
    """(meters, appliances with arrays, the same with sets, the sets): a meter in two sets, a set without appliances, names that repeat."""
    of = {"p": [1, 2], "q": [2], "r": [3, 4], "s": [5]}
    named = [(1, "fridge", 1, "p", False), (1, "fridge", 1, "p", None), (1, "lamp", 2, "q", True), (1, "oven", 1, "q", True), (1, "oven", 1, "r", False), (2, "oven", 3, "p", False)]
    meters = spark.createDataFrame([(b, m, m == 5) for b in (1, 2) for m in range(1, 7)], "building int, meter int, site_meter boolean")
    arrays = spark.createDataFrame([(b, t, i, of[k], f) for b, t, i, k, f in named], "building int, type string, instance int, meters array<int>, dominant boolean")
    sets = spark.createDataFrame([(b, k, m) for b in (1, 2) for k, own in of.items() for m in own], "building int, set string, meter int")
    return meters, arrays, spark.createDataFrame(named, "building int, type string, instance int, set string, dominant boolean"), sets


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_dominant_of_sets(shared):
    _, arrays, named, sets = shared
    found = selection.dominant(named, sets)
    assert rows_of(found) == rows_of(selection.dominant(arrays)) and len(rows_of(found)) == 6
    assert {(r.building, r.meter): r.type for r in found.collect()} == {(1, 1): None, (1, 2): "oven", (1, 3): "oven", (1, 4): "oven", (2, 1): "oven", (2, 2): "oven"}


def test_groups_of_sets(shared):
    meters, arrays, named, sets = shared
    for column in ("type", "instance"):
        assert rows_of(selection.groups(meters, named, column, sets)) == rows_of(selection.groups(meters, arrays, column))
    assert {r.type: len(r.meters) for r in selection.groups(meters, named, "type", sets).collect()} == {"oven": 5}


def test_labels_of_sets(shared):
    meters, arrays, named, sets = shared
    for pretty in (True, False):
        assert rows_of(selection.labels(meters, named, pretty, sets)) == rows_of(selection.labels(meters, arrays, pretty))
    got = {(r.building, r.meter): r.label for r in selection.labels(meters, named, sets=sets).collect()}
    assert got[1, 2] == "Fridge, Fridge, Lamp 2, Oven" and got[1, 5] == "Site meter" and got[2, 6] == "Meter 6" and got[2, 2] == "Oven 3"
