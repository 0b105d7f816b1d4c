"""A training corpus from `documents`: quality, near duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents, whatever more there are; the last returns the packed pieces. Stages judge rows by their id and text together
(64-bit hashes of both), so documents without an id are judged like others, and different texts of one id each by itself. Equal
rows share their fate; an empty table gives an empty result. A stage's docstring says what it does with the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chosen_path, common, queries, secret_scan


def _row(docs: DataFrame) -> DataFrame:
    """docs with `_row`, a number of the id and the text."""
    return docs.withColumn("_row", F.xxhash64("doc_id", common.text_of(), F.length(common.text_of())))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null texts are scored as empty ones."""
    named = _row(docs)
    rejected = queries.quality_scores(spark, named, sf_dir, carried="_row").where("predicted = 0").select("_row").distinct()
    return named.join(rejected, "_row", "left_anti").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, of several texts of that id the one with the least hash.

    Equal rows of one id are one document; different texts of one id are documents of their own; documents without an id, which nothing could be kept by, all stay.
    """
    text = common.text_of()
    named = docs.where("doc_id is not null").withColumns({"_h": F.xxhash64(text), "_n": F.length(text)})
    keys = ["doc_id", "_h", "_n"]
    # other texts than the first of an id get a number of their own beyond the ids
    least, most, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    texts = common.sized(named.select(*keys).distinct(), rows)
    first = texts.groupBy("doc_id").agg(F.min(F.struct("_h", "_n")).alias("_first"), F.count("*").alias("_texts")).where("_texts > 1")
    first = common.sized(first, rows)
    others = common.sized(texts.join(first, "doc_id").where(F.struct("_h", "_n") != F.col("_first")).select(*keys), rows)
    number = F.monotonically_increasing_id() + 1
    others = common.durable(others.withColumn("_more", F.lit(most) + number if (most or 0) < 1 << 62 else F.lit(least) - number))
    if others.isEmpty():
        named = named.withColumn("_s", F.col("doc_id").cast("long"))
        found = chosen_path.jaccard_classes(named.select("_s", "text"), id_col="_s")
        copies = common.durable(common.sized(found.where("_s <> class_id").select("_s").distinct(), rows))
    else:
        named = named.join(others, keys, "left").withColumn("_s", F.coalesce("_more", F.col("doc_id").cast("long"))).drop("_more")
        found = common.durable(chosen_path.jaccard_classes(named.select("_s", "text"), id_col="_s").select("_s", "class_id").distinct())
        found = common.sized(found, rows)
        ranked = found.join(others.withColumnRenamed("_more", "_s"), "_s", "left").withColumn("_rank", F.struct(F.coalesce("doc_id", "_s"), F.col("_h").isNotNull(), "_h", "_n", "_s"))
        stays = ranked.groupBy("class_id").agg(F.min("_rank").alias("_least"))
        copies = ranked.join(stays, "class_id").where("_rank <> _least").select("_s")
    kept = named.join(copies, "_s", "left_anti").dropDuplicates(["_s"]).select(*docs.columns)
    return common.sized(kept.unionByName(docs.where("doc_id is null")), rows, 1 << 12)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    named = _row(docs)
    leaks = queries.benchmark_hits(spark, named, sf_dir, id_col="_row").select(F.col("doc_id").alias("_row")).distinct()
    return named.join(leaks, "_row", "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets masked and n_chars counted anew; null texts stay null."""
    return secret_scan.redacted(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document (a null or empty text is one separator) with their places."""
    return queries.packed_pieces(docs)


STAGES = [("quality", quality_stage), ("near duplicates", dedup_stage), ("decontamination", decontaminate_stage), ("secrets", secret_stage), ("packing", pack_stage)]

#: Trained models, a recall-bound join and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.durable(docs)
    return docs
