"""Switches of several phases apart from those of one, and their appliances."""

import random

from gridloom.operators import eventbased, models

SEC = 1_000_000


def plain_phases(rows, phases, eps, least, fewest):
    once = {}
    for b, p, t, x in rows:
        if t is not None and x is not None:
            once.setdefault((b, t), {}).setdefault(p, 0.0)
            once[b, t][p] += x
    out, rest, pairs = set(), {}, {}
    for (b, t), x in once.items():
        if len(x) == phases and (min(x.values()) > 0 or max(x.values()) < 0):
            out.add((b, tuple(sorted(x)), t))
            continue
        rest[b, t] = set(x)
        for p in x:
            for q in x:
                if p < q and x[p] * x[q] > 0:
                    pairs.setdefault((b, p, q), []).append(t)
    taken = {}
    for (b, p, q), ts in sorted(pairs.items(), key=lambda kv: kv[0]):
        if len(ts) < fewest:
            continue
        core = {t for t in ts if sum(abs(t - u) <= eps for u in ts) >= least}
        for t in ts:
            if any(abs(t - u) <= eps for u in core):
                taken.setdefault((b, t), []).append((p, q))
    for (b, t), ps in taken.items():
        keep = [z for z in ps if all(z == min(y for y in ps if p in y) for p in z)]
        for z in keep:
            out.add((b, z, t))
            rest[b, t] -= set(z)
    return out | {(b, (p,), t) for (b, t), ps in rest.items() for p in ps}


def test_separate_phases(spark):
    rnd = random.Random(6)
    for phases in (2, 3, 4):
        rows = [(b, p, rnd.randint(0, 120) * SEC, float(rnd.choice([-300, 300, 80]))) for b in (1, 2) for p in range(phases) for _ in range(60)]
        rows += [(1, 0, None, 5.0), (2, 1, 7 * SEC, None)]
        df = spark.createDataFrame(rows, "building int, phase int, t long, transition double")
        got = eventbased.separate_phases(df, phases, 6, 4, 8).collect()
        assert len(got) == len({(r.building, tuple(r.phases), r.t) for r in got})
        assert {(r.building, tuple(r.phases), r.t) for r in got} == plain_phases(rows, phases, 6 * SEC, 4, 8)
        assert {len(r.phases) for r in got} >= {1, 2, phases}
        assert abs(sum(sum(r.transitions) for r in got) - sum(x for *_, t, x in rows if t is not None and x is not None)) < 1e-6
    assert eventbased.separate_phases(df.limit(0)).count() == 0


def test_appliances_of_phases(spark):
    """A heater on three phases, a stove on two, a kettle on one; each is found on its phases with its power."""
    rnd = random.Random(7)
    on = {"heater": {0: 900.0, 1: 900.0, 2: 900.0}, "stove": {0: 400.0, 1: 500.0}, "kettle": {2: 250.0}}
    rows, t = [], 0
    for use in range(60):
        name = list(on)[use % 3]
        for k in range(10):
            for p in range(3):
                rows.append((7, p, t * SEC, t, (on[name].get(p, 0.0) if k >= 5 else 0.0) + rnd.gauss(0, 0.3)))
            t += 1
    df = spark.createDataFrame(rows, "building int, phase int, t long, id long, value double")
    got = models.EventBased(noise=30).disaggregate_phases(df).collect()
    power = {}
    for r in got:
        k = (tuple(r.phases), r.phase)
        power[k] = max(power.get(k, 0), round(r.power, -1))
    assert power == {((0, 1, 2), 0): 900, ((0, 1, 2), 1): 900, ((0, 1, 2), 2): 900, ((0, 1), 0): 400, ((0, 1), 1): 500, ((2,), 2): 250}
    assert {r.building for r in got} == {7}


def test_few_rows_go_to_all_tasks(spark):
    """Long segments take Python's time, not bytes, so that small tables must not end in one task."""
    rows = [(m, 0, k, k, 60.0 * (-1) ** k, 6) for m in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "meter long, segment long, t long, place int, transition double, size long")
    found = eventbased.decode_segments(df, ["transition"], {"a": [([60.0], [[400.0]]), ([-60.0], [[400.0]])]})
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.where("appliance = 'a'").count() == 240
