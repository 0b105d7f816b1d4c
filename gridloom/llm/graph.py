"""Connected components over links, by alternating large and small stars; nothing is gathered on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) % 1000003 as long))")).first())


def _to_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(each edge with m, the least neighbour of its u; every u with m). Nodes of very many edges, the centres of stars, meet their edges by broadcast."""
    least = common.sized(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), total)
    return common.sized(common.hot_join(edges, least, ["u"], "n", total), total), least.drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that has a link: the smallest node it can reach. `edges` has u and v, in any direction."""
    e = common.durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    while before[0]:
        e = common.sized(e, before[0])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, 2 * before[0])[0].select("u", "v", F.least("u", "m").alias("m"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.durable(common.sized(large, before[0]))
        found, least = _to_least(large, before[0])
        small = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = common.durable(common.sized(small.distinct(), before[0]))
        now = _state(e)
        if now == before:
            break
        before = now
    nodes = e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
    return common.sized(nodes, 2 * before[0])
