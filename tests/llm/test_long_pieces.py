"""Long pieces don't fill a worker's memory with their ids, and packing stores small tables in few files."""

import numpy as np

from gridloom.llm import common, packing, queries, textnum


def test_ids_kept_are_bounded():
    bpe = textnum.ByteBPE(queries.tokenizer_path())
    bpe.most_ids = 1 << 18
    rng = np.random.default_rng(7)
    for _ in range(20):
        raw = rng.integers(97, 123, 100_000, dtype=np.uint8)
        raw[::2500] = 32
        off = np.array([0, 40_000, 40_000, 100_000])
        ids, bounds = bpe.encode(raw, off)
        data = raw.tobytes().decode()
        texts = [data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [bpe.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(bpe.flat) <= 1 << 18 and bpe.end <= 1 << 18


def test_packing_takes_few_partitions(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    made, durable = [], common.durable

    def watched(df):
        made.append((out := durable(df)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "durable", watched)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sizes = [1 + (k * 37) % 300 for k in range(500)] + [1024, 1023, 1]
        pieces = spark.createDataFrame([(k, 0, n) for k, n in enumerate(sizes)], "doc_id long, piece int, length long")
        found = packing.pack(pieces)
        cores = spark.sparkContext.defaultParallelism
        assert made[-1] <= cores and found.rdd.getNumPartitions() <= cores
        rows = found.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024 and len(at) == -(-sum(sizes) // 1024)
