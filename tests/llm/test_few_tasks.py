"""The driver holds some kilobytes for each task and the text of each plan, so neither may grow with the shuffle partitions or by what the optimizer copies."""

import corpus_pipeline
from gridloom.llm import secret_scan


def test_near_duplicates_of_few_documents_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    texts = [" ".join(f"w{k // 4}x{i}" for i in range(60)) + f" end{k % 4}" for k in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (0, "a text of its own")], "doc_id long, text string")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few tasks", "")
        kept = corpus_pipeline.dedup_stage(spark, docs, "").collect()
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = [x.numTasks for x in map(tracker.getStageInfo, stages) if x and x.numCompletedTasks]
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(k, texts[k]) for k in range(0, 80, 4)] + [(0, "a text of its own")])
        assert sum(n >= 32 for n in tasks) <= 20  # 51 before
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_filter_repeats_the_searches(spark):
    docs = spark.createDataFrame([(1, "user=alice password=abcdefgh1"), (2, "login: bob"), (3, None)], "doc_id long, text string")
    plan = secret_scan.redacted(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan
    assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_extract_all" in x]
    assert [r.text for r in secret_scan.redacted(docs).orderBy("doc_id").collect()] == ["[secret] [secret]", "login: bob", None]
