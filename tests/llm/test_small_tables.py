"""Small tables on the way of the similarity join take few tasks and files, whatever the number of shuffle partitions."""

from gridloom.llm import chosen_path, common
from gridloom.llm.graph import components


def test_small_tables_take_few_partitions(spark, monkeypatch):
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
        edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "u long, v long")
        assert {r.u: r.root for r in components(edges).collect()} == {i: i // 10 * 10 for i in range(40)}
        cores = spark.sparkContext.defaultParallelism
        assert len(made) > 2 and max(made[1:]) <= cores  # the first holds the given edges, as yet uncounted
        made.clear()
        texts = [" ".join(f"w{k // 4}x{i}" for i in range(60)) + f" end{k % 4}" for k in range(80)]
        found = chosen_path.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in found.collect()} == {k: (k // 4 * 4, 3, 1) for k in range(80)}
        assert sum(n > cores for n in made) <= 3  # links of groups before they are counted, twice, and the exact comparisons
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
