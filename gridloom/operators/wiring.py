"""The wiring tree of any depth, by doubling pointers: one join a doubling, so log2(depth) joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of spark.checkpoint.dir; with a local master alone a local one serves where none is set, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="gridloom-checkpoint-"))
    return df.checkpoint()


def wiring_tree(edges: DataFrame, most_doublings: int = 32) -> DataFrame:
    """(meter, root, depth) of rows (meter, parent); a null parent makes a root, a parent without a row of its own too.

    A ring of meters has no root: it raises ValueError.
    """
    inner = edges.where("parent is not null").select("meter", "parent").distinct()
    tops = edges.select("meter").unionByName(inner.select(F.col("parent").alias("meter"))).distinct().join(inner.select("meter"), "meter", "left_anti")
    state = _cut(tops.select("meter", F.col("meter").alias("root"), F.lit(0).alias("depth"), F.lit(True).alias("done")).unionByName(inner.select("meter", F.col("parent").alias("root"), F.lit(1).alias("depth"), F.lit(False).alias("done"))))
    for _ in range(most_doublings):
        if state.where("not done").isEmpty():
            return state.select("meter", "root", "depth")
        up = state.select(F.col("meter").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("more"), F.col("done").alias("done2"))
        moved = state.where("not done").join(up, "root").select("meter", F.col("root2").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done2").alias("done"))
        state = _cut(state.where("done").unionByName(moved))
    raise ValueError("the wiring holds a ring")


def proportion_of_upstream(energies: DataFrame, edges: DataFrame) -> DataFrame:
    """(meter, parent, proportion) of (meter, kwh); null where the parent used nothing."""
    above = energies.select(F.col("meter").alias("parent"), F.col("kwh").alias("_above"))
    return edges.where("parent is not null").join(energies, "meter").join(above, "parent").select("meter", "parent", F.when(F.col("_above") != 0, F.col("kwh") / F.col("_above")).alias("proportion"))


def with_remainder(energies: DataFrame, mains) -> DataFrame:
    """(meter, kwh) of the sub-meters and a row 'remainder': what the mains measured beyond their sum."""
    at_mains = F.col("meter") == F.lit(mains)
    rest = energies.agg((F.sum(F.when(at_mains, F.col("kwh"))) - F.coalesce(F.sum(F.when(~at_mains, F.col("kwh"))), F.lit(0.0))).alias("kwh"))
    return energies.where(~at_mains).select(F.col("meter").cast("string").alias("meter"), "kwh").unionByName(rest.select(F.lit("remainder").alias("meter"), "kwh"))
