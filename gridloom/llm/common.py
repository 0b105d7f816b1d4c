"""Shared helpers: safe readers, durable checkpoints, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local_folder(spark: SparkSession) -> str:
    """A local folder, right for a local master alone; a cluster has to name a shared one."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="gridloom-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir; only where none is configured (as in tests) a local one is made."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or _local_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which takes less room than a checkpoint."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, each: int = 1 << 16) -> DataFrame:
    """df, of about so many rows, in no more partitions than `each` rows or one a core fill, so that a small table takes few tasks and files. Shuffles by a key keep their number."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """Identity of a row by its content: repeated rows share it and so share their results."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), F.length(text_of(text_col)).alias("n"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark)
    return f"{base.rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with table, which has one row a key and, as `size`, how many of the `total` rows have it; `size` is dropped.

    Keys of more than a thousandth of all rows (so fewer than a thousand of them) are broadcast, as one task would get
    all rows of such a key; the others meet in a shuffle. The table is read twice, so it should be cheap or durable.
    """
    most = max(1024, total // 1000)
    hot = F.broadcast(table.where(F.col(size) > most).drop(size))
    cold = table.where(F.col(size) <= most).drop(size)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
