"""Running totals over the ordered rows of a key, dealt by ranges, so that no key is ordered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.wiring import _cut


def before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str = "1") -> DataFrame:
    """Each row with `_before`, the weight of the rows of its key that come before it, and `_all`, the weight of its whole key.

    Ranges of (keys, order) are ordered each by itself; only their sums, a row a range and key, are added up a key. The ranges
    are checkpointed, as their bounds are sampled. Rows of one place in the order stand in any order; rows with a null key don't count.
    """
    whole = rows.where(" and ".join(f"{c} is not null" for c in keys))
    dealt = _cut(whole.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    each, inside = Window.partitionBy(*keys), Window.partitionBy(*keys, "_range").orderBy(*order)
    earlier = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(F.expr(weight)).alias("_sum"))
    starts = sums.select(*keys, "_range", earlier("_sum", each.orderBy("_range")).alias("_start"), F.sum("_sum").over(each).alias("_all"))
    placed = dealt.withColumn("_before", earlier(F.expr(weight), inside)).join(starts, [*keys, "_range"])
    return placed.withColumn("_before", F.col("_before") + F.col("_start")).drop("_range", "_start")


def reach(values: DataFrame, probes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probes (keys, _u, _r, _row and more) with `_low`, the number of values (keys, _u, _row) of their key below _u - _r, and `_high`, that of those up to _u + _r."""
    carried = [c for c in probes.columns if c not in (*keys, "_u", "_r")]
    end = lambda at, kind: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"))
    ends = probes.select(*keys, *carried, F.explode(F.array(end(F.col("_u") - F.col("_r"), 0), end(F.col("_u") + F.col("_r"), 2))).alias("_end")).select(*keys, *carried, "_end.*")
    both = ends.unionByName(values.select(*keys, "_row", F.col("_u").alias("_at"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    placed = before(both, keys, ["_at", "_kind", "_row"], "case when _kind = 1 then 1 else 0 end")
    return placed.where("_kind <> 1").groupBy(*keys, *carried).agg(F.min("_before").alias("_low"), F.max("_before").alias("_high"))
