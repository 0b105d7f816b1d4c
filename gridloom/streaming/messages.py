"""Typed messages from a bus: any stream of rows with a body in JSON (Kafka's, a socket's, files') becomes readings and other tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

READING = "meter long, ts timestamp, value double"


def from_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The messages of a topic as rows (body string, ts); needs Spark's Kafka package on the cluster."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return rows.select(F.col("value").cast("string").alias("body"), F.col("timestamp").alias("ts"))


def of_type(messages: DataFrame, name: str, schema: str, kind: str = "$.type", content: str = "$.content", body: Column | str = "body") -> DataFrame:
    """The messages of one type, their content parsed; what doesn't parse is left out (see `broken`)."""
    text = F.col(body) if isinstance(body, str) else body
    parsed = F.from_json(F.get_json_object(text, content), schema, {"mode": "PERMISSIVE"})
    rows = messages.where(F.get_json_object(text, kind) == name).select(parsed.alias("_m"))
    return rows.where("_m is not null").select("_m.*").where(" or ".join(f"`{f.split()[0].strip('`')}` is not null" for f in schema.split(", ")))


def broken(messages: DataFrame, names: list[str], kind: str = "$.type", body: str = "body") -> DataFrame:
    """Messages that are no JSON or of none of the types."""
    found = F.get_json_object(F.col(body), kind)
    return messages.where(found.isNull() | ~found.isin(names))


def subscribe(messages: DataFrame, handlers: dict[str, tuple[str, Callable[[DataFrame, int], None]]], checkpoint: str, **options: str) -> StreamingQuery:
    """Hand each micro-batch's messages of a type, parsed by its schema, to the type's handler(rows, batch number).

    A batch that fails is handed out again with its number, so a handler should write by that number. The offsets are kept
    under `checkpoint`, in a shared folder.
    """

    def one(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            for name, (schema, handler) in handlers.items():
                handler(of_type(rows, name, schema), number)
        finally:
            rows.unpersist()

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).options(**options).start()
