"""Rows that repeat an id, with the same or another text, and what a packing plan is made of."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import packing, queries, secret_scan


def test_pieces_of_one_id_with_other_texts_have_places_of_their_own(spark):
    texts = ["alpha beta gamma", "gamma beta alpha", "alpha beta gamma", "delta " * 3000]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, "x y"), (None, "y x")], "doc_id long, text string")
    got = queries.packed_pieces(docs).collect()
    again = queries.packed_pieces(docs.repartition(5)).collect()
    assert len(got) == 5 + len({(r.piece, r.start) for r in got if r.piece or r.length > 10})
    used: dict = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)]).tolist()[:-1]
    key = lambda rows: sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(again)


def test_configurations_carry_most_large_pieces():
    rng = np.random.default_rng(3)
    sizes, times = np.unique(np.clip(rng.lognormal(6, 0.9, 20_000).astype(int), 1, 1024), return_counts=True)
    counts = dict(zip(sizes.tolist(), times.tolist(), strict=True))
    share, ranges = 3, packing.plan_from(dict(counts), 1024, 1024 // 3 + 1, 64, 400)
    sequences: dict = {}
    for length, _, n, first, offset in ranges:
        sequences.setdefault((first, n), []).append((offset, length))
    for content in sequences.values():
        content.sort()
        assert [o for o, _ in content] == np.cumsum([0, *(x for _, x in content)]).tolist()[:-1] and sum(x for _, x in content) <= 1024
    large = lambda x: 1024 // share < x < 1024
    several = sum(n * sum(large(x) for _, x in c) for (_, n), c in sequences.items() if len({x for _, x in c if large(x)}) > 1)
    assert several > 0.5 * sum(v for k, v in counts.items() if large(k) and k <= 1024 - 1024 // share)
    bound = -(-sum(k * v for k, v in counts.items()) // 1024)
    least, found = sum(n for _, n in sequences), packing.best_plan(dict(counts))[1]
    assert max(s + n for _, _, n, s, _ in found) <= least <= 1.02 * bound


def test_a_document_without_an_id_is_not_held_out(spark, tmp_path):
    for name in ("documents", "labels"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "documents":
            rows = rows.unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = queries.op6_quality(spark, str(tmp_path)).collect()
    assert [r.held_out for r in rows if r.doc_id is None] == [False] and all(isinstance(r.held_out, bool) for r in rows)


def test_weak_spans_of_repeated_rows(spark):
    text = "user = bob, pwd = abcdefgh12345\nhttps://a.example/x\nuser = eve\n" + "filler " * 200 + "\nuser = lone"
    docs = spark.createDataFrame([(1, text)] * 50 + [(1, "user = lone"), (2, text)], "doc_id long, text string").repartition(7)
    for scope in ("text", "line"):
        alone = secret_scan.scan(docs.where("doc_id = 2"), scope=scope).first().spans
        rows = secret_scan.scan(docs, scope=scope).collect()
        assert len(rows) == 52 and alone and {str(r.spans) for r in rows if r.spans} == {str(alone)}
        assert sum(bool(r.spans) for r in rows) == 51
    clean = {r.text for r in secret_scan.redacted(docs).where("doc_id = 1").collect()}
    assert len(clean) == 2 and "user = lone" in clean
