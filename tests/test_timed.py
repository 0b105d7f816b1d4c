"""State with timers: equal to the batch pairing across a restart, late rows apart, an idle meter's state gone."""

import random

from gridloom.operators import disaggregate
from gridloom.streaming import timed

SEC = 1_000_000


def test_restart_late_rows_and_idle_meters(spark, tmp_path):
    spark.conf.set(*timed.STORE)
    rnd = random.Random(5)
    rows = [(m, t * SEC, float(rnd.choice([-1, 1]) * rnd.choice([200, 400]) + rnd.randint(-30, 30))) for m in (1, 2, 3) for t in range(1000, 1040)]
    kind = "meter long, t long, transition double"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(part):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).parquet(folder)
        # a new query each time: it starts again from what the last one left
        q = timed.split(timed.pair_transitions(stream, 3600, "10 seconds"), str(tmp_path / "state"), out).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive

    feed([r for r in rows if r[1] < 1020 * SEC])
    feed([r for r in rows if r[1] >= 1020 * SEC] + [(1, 1019 * SEC, None), (9, 1039 * SEC, 70.0)])
    feed([(1, 1039 * SEC - 1, 333.0), (4, 1039 * SEC, 55.0)])  # older than what meter 1 has paired, by less than the watermark's delay
    feed([(5, 100_000 * SEC, 500.0)])  # time goes on
    feed([(9, 100_001 * SEC, -70.0), (5, 100_001 * SEC, -500.0)])
    got = spark.read.parquet(out)
    pairs = sorted(tuple(r) for r in got.where("kind = 'pair'").select("meter", "on_t", "on", "off_t", "off").collect())
    want = disaggregate.pair_transitions(spark.createDataFrame([*rows, (5, 100_000 * SEC, 500.0), (5, 100_001 * SEC, -500.0)], kind)).collect()
    assert pairs == sorted(map(tuple, want))  # meter 9's rise had gone before its fall came
    opened = {(r.meter, r.on_t) for r in got.where("kind = 'open'").collect()}
    assert (9, 1039 * SEC) in opened and (5, 100_000 * SEC) not in opened
    assert opened.isdisjoint({(m, on) for m, on, *_ in pairs})
    late = [(r.meter, r.on_t, r.on) for r in got.where("kind = 'late'").collect()]
    assert late == [(1, 1039 * SEC - 1, 333.0)]
