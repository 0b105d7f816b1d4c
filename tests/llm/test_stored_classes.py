"""Classes and copies are stored before several joins read them, so that the driver doesn't hold the plans and stages of what made them once more for each."""

import corpus_pipeline
from gridloom.llm import chosen_path


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_last_job_of_near_duplicates_has_few_exchanges(spark):
    texts = [" ".join(f"w{k // 4}x{i}" for i in range(60)) + f" end{k % 4}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = chosen_path.jaccard_classes(docs)
    assert exchanges(found) <= 6
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in found.collect()} == {k: (k // 4 * 4, 3, 1) for k in range(40)}
    kept = corpus_pipeline.dedup_stage(spark, docs, "")
    assert exchanges(kept) <= 3
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 4))
    # another text of an id, near no other, stays; one that is near another's copies goes
    more = docs.unionByName(spark.createDataFrame([(0, "a text of its own"), (4, texts[0])], docs.schema))
    kept = corpus_pipeline.dedup_stage(spark, more, "")
    assert exchanges(kept) <= 12
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(k, texts[k]) for k in range(0, 40, 4)] + [(0, "a text of its own")])


def test_few_documents_stay_in_few_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame([(k, f"text {k} of its own words {k * k}") for k in range(20)] + [(None, "no id"), (None, None)], "doc_id long, text string")
        kept = corpus_pipeline.dedup_stage(spark, docs, "")
        assert kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
