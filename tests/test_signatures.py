"""Steps of changes against a row-by-row version on 600 random series."""

import random

import numpy as np

from gridloom.operators import disaggregate, eventbased


def row_by_row(values, state):
    """[(place of the first row, steps)]: the last calm step, those of the change, the first calm one."""
    out, steps, calm, going, was = [], None, None, False, 0.0
    for i, v in enumerate(values):
        d = v - was
        jump = abs(d) > state
        if jump and not going:
            steps = [*([] if calm is None else [calm]), d]
            out.append((i, steps))
        elif jump or going:
            steps.append(d)
        if not jump:
            calm = d
        going, was = jump, v
    return out


def test_signatures_against_a_row_by_row_version(spark):
    rng = random.Random(9)
    series = {m: [float(rng.choice([0, 5, 60, 80, 150, 152, 400])) for _ in range(rng.randrange(1, 40))] for m in range(600)}
    rows = [(m, 10 * i, i, v) for m, s in series.items() for i, v in enumerate(s)]
    readings = spark.createDataFrame(rows, "meter long, t long, id long, value double")
    starts = {(r.meter, r.run): r.t for r in disaggregate.runs(readings, 15).collect()}
    got: dict = {}
    for r in disaggregate.signatures(readings, 15, 12).collect():
        got.setdefault(r.meter, []).append((starts[r.meter, r.run] // 10, r.signature, r.steps, r.high, r.low))
    for m, s in series.items():
        want = row_by_row(s, 15)
        mine = sorted(got.get(m, []))
        assert [x[0] for x in mine] == [i for i, _ in want]
        for (_, signature, n, high, low), (_, steps) in zip(mine, want, strict=True):
            assert n == len(steps) and (signature == steps if n <= 12 else signature is None)
            total = np.cumsum(steps)
            assert high == max(total) and low == min(total)


def test_transients_carry_their_overshoot(spark):
    values = [0.0, 0.0, 500.0, 130.0, 100.0, 100.0, 100.0, 5.0, 0.0, 0.0]
    readings = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "meter long, t long, id long, value double")
    found = disaggregate.transients(readings, 70, 15).orderBy("t")
    rows = found.collect()
    assert [r.signature for r in rows] == [[0.0, 500.0, -370.0, -30.0, 0.0], [0.0, -95.0, -5.0]] and [r.steps for r in rows] == [5, 3]
    peaks = [r.p for r in found.select(eventbased.signature_peak(found.signature, found.transition).alias("p")).collect()]
    assert np.allclose(peaks, [r.peak for r in rows])
