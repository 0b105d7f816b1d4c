"""Interval algebra by one event sweep: union, intersection, difference, matching and confusion differ in weights and level only.

Equal timestamps are summed before the running sum, so the order of ties does not matter. Every sweep is partitioned by
meter and never collapses to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.sections import US, in_order, merge_gaps


def sweep(weighted: list[tuple[DataFrame, int]]) -> DataFrame:
    """(meter, start, end, level): the pieces between consecutive boundaries and the sum of the weights open there."""
    events = []
    for df, w in weighted:
        events.append(df.select("meter", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(w).alias("w")), F.struct(F.col("end").alias("t"), F.lit(-w).alias("w")))).alias("e")).select("meter", "e.*"))
    each = reduce(DataFrame.unionByName, events).groupBy("meter", "t").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("meter").orderBy("t")
    rows = each.select("meter", F.col("t").alias("start"), F.lead("t").over(order).alias("end"), F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("level"))
    return rows.where("end is not null")


def union(*sides: DataFrame) -> DataFrame:
    return merge_gaps(sweep([(s, 1) for s in sides]).where("level > 0").drop("level"), 0)


def intersect(*sides: DataFrame) -> DataFrame:
    """Each side has disjoint sections."""
    return sweep([(s, 1) for s in sides]).where(F.col("level") == len(sides)).drop("level")


def common(sections: DataFrame, group: DataFrame) -> DataFrame:
    """(group, start, end) where all meters of a group (group, meter) have sections; a member without any leaves its group none.

    The sections of a meter are disjoint; a meter may be in several groups and counts once in each.
    """
    members = group.where("group is not null and meter is not null").select("group", "meter").distinct()
    sizes = members.groupBy("group").agg(F.count("*").alias("_members"))
    held = sections.join(members, "meter").select(F.col("group").alias("meter"), "start", "end")
    pieces = sweep([(held, 1)]).withColumnRenamed("meter", "group").join(sizes, "group").where("level = _members")
    return merge_gaps(pieces.select(F.col("group").alias("meter"), "start", "end"), 0).withColumnRenamed("meter", "group")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return sweep([(left, 1), (right, 2)]).where("level = 1").drop("level")


def matching(*sides: DataFrame) -> DataFrame:
    """Where all or none of the sides are on, between the first and the last boundary."""
    return merge_gaps(sweep([(s, 1) for s in sides]).where(F.col("level").isin(0, len(sides))).drop("level"), 0)


def confusion(prediction: DataFrame, truth: DataFrame, good: DataFrame) -> DataFrame:
    """Durations (meter, tp, tn, fp, fn, in microseconds) within the good sections."""
    rows = sweep([(prediction, 1), (truth, 2), (good, 4)]).where("level >= 4")
    span = F.col("end") - F.col("start")
    return rows.groupBy("meter").agg(*(F.coalesce(F.sum(F.when(F.col("level") == k, span)), F.lit(0)).alias(n) for n, k in (("tp", 7), ("tn", 4), ("fp", 5), ("fn", 6))))


def truncate(sections: DataFrame, start: int, end: int) -> DataFrame:
    return sections.select("meter", F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end")).where("start < end")


def invert(sections: DataFrame, start: int, end: int) -> DataFrame:
    """The gaps of each meter within [start, end]."""
    inner = truncate(sections, start, end)
    frame = inner.select("meter").distinct().select("meter", F.lit(start).alias("start"), F.lit(end).alias("end"))
    return difference(frame, union(inner))


def split(sections: DataFrame, longest_s: float) -> DataFrame:
    step = int(longest_s * US)
    rows = sections.withColumn("at", F.explode(F.sequence("start", F.col("end") - 1, F.lit(step))))
    return rows.select("meter", F.col("at").alias("start"), F.least(F.col("at") + step, F.col("end")).alias("end"))


def upcounts(sections: DataFrame, entity: str = "meter") -> DataFrame:
    """(t, up): how many sections are open from t on, over all meters. Counts by day are summed first, so only one row a day meets in the ordered task."""
    events = sections.select(F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("w")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("w")))).alias("e")).select("e.*")
    each = events.groupBy("t").agg(F.sum("w").alias("w")).withColumn("day", F.expr(f"t div {86400 * US}"))
    days = each.groupBy("day").agg(F.sum("w").alias("net"))
    before = days.select("day", F.coalesce(F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.sum("w").over(Window.partitionBy("day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("inner", inner).join(before, "day").select("t", (F.col("inner") + F.col("before")).alias("up"))


def hull(sections: DataFrame) -> DataFrame:
    return sections.groupBy("meter").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def ordinal(sections: DataFrame) -> DataFrame:
    """Sections with their place n, from 0, in their meter (index, pop and keep-one are filters on n)."""
    return sections.withColumn("n", F.row_number().over(in_order("start", "end")) - 1)


def train_test_split(sections: DataFrame, period_s: float, fraction: float = 0.5) -> DataFrame:
    """(meter, split): the instant at the fraction of all samples that good sections hold; an exact fit gives the next section's start."""
    n = F.floor((F.col("end") - F.col("start")) / int(period_s * US))
    rows = sections.withColumn("n", n).withColumn("upto", F.sum("n").over(in_order("start").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("target", F.lit(fraction) * F.sum("n").over(Window.partitionBy("meter"))).withColumn("k", F.count("*").over(Window.partitionBy("meter")))
    hit = rows.where("upto > target or k = 1").withColumn("first", F.row_number().over(in_order("start"))).where("first = 1")
    return hit.select("meter", (F.col("start") + F.floor((F.col("target") - (F.col("upto") - F.col("n"))) * period_s) * US).cast("long").alias("split"))


def adjacent(a: DataFrame, b: DataFrame, gap_s: float = 0) -> DataFrame:
    """(meter, a_start, a_end, b_start, b_end): sections of a and b of which either begins at the other's end or at most gap_s after it.

    Ends and starts meet in buckets of the gap, so the join is an equi join.
    """
    reach = round(gap_s * US)
    step = max(reach, 1)
    at = lambda c: F.expr(f"{c} div {step}")

    def follows(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
        left = first.select("meter", F.col("start").alias(f"{names[0]}_start"), F.col("end").alias(f"{names[0]}_end"), F.explode(F.array(at("end"), at("end") + 1)).alias("_k"))
        right = second.select("meter", F.col("start").alias(f"{names[1]}_start"), F.col("end").alias(f"{names[1]}_end"), at("start").alias("_k"))
        return left.join(right, ["meter", "_k"]).where(F.col(f"{names[1]}_start").between(F.col(f"{names[0]}_end"), F.col(f"{names[0]}_end") + reach)).drop("_k")

    columns = ["meter", "a_start", "a_end", "b_start", "b_end"]
    return follows(a, b, ("a", "b")).select(*columns).unionByName(follows(b, a, ("b", "a")).select(*columns)).distinct()


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The sections that lie wholly in one of the other table's disjoint sections."""
    order = Window.partitionBy("meter").orderBy("start", "_kind", F.desc("end"))
    both = inner.select("meter", "start", "end", F.lit(1).alias("_kind")).unionByName(outer.select("meter", "start", "end", F.lit(0).alias("_kind")))
    reach = F.max(F.when(F.col("_kind") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_reach", reach).where("_kind = 1 and end <= _reach").select("meter", "start", "end")


def overlapping(sections: DataFrame) -> DataFrame:
    """The sections that begin before an earlier one of their meter has ended."""
    before = F.max("end").over(in_order("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    return sections.select("meter", "start", "end", before.alias("_before")).where("start < _before").drop("_before")


def check_no_overlap(sections: DataFrame) -> DataFrame:
    """The same sections; ValueError if any two of a meter overlap."""
    clash = overlapping(sections).first()
    if clash:
        raise ValueError(f"sections of meter {clash.meter} overlap at {clash.start}")
    return sections


def bounded(sections: DataFrame, lowest: int, highest: int) -> DataFrame:
    """Sections with open bounds (null) closed by the given ones; empty ones are left out."""
    return sections.select("meter", F.coalesce("start", F.lit(lowest)).alias("start"), F.coalesce("end", F.lit(highest)).alias("end")).where("start < end")


def time_span(sections: DataFrame, intersection: bool = True) -> DataFrame:
    """(start, end) of a group from its meters' hulls: what they share, or what they cover; no row where that is empty."""
    each = hull(sections)
    ends = (F.max("start"), F.min("end")) if intersection else (F.min("start"), F.max("end"))
    return each.agg(ends[0].alias("start"), ends[1].alias("end")).where("start < end")


def to_json(sections: DataFrame) -> DataFrame:
    """(meter, sections): all sections of a meter as one JSON list of objects with start and end, in order."""
    rows = sections.groupBy("meter").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_s"))
    return rows.select("meter", F.to_json("_s").alias("sections"))


def from_json(texts: DataFrame) -> DataFrame:
    """The sections of rows (meter, sections) as `to_json` gives them; open bounds are null."""
    return texts.select("meter", F.explode(F.from_json("sections", "array<struct<start:long,end:long>>")).alias("_s")).select("meter", "_s.start", "_s.end")


def duration_s(sections: DataFrame) -> DataFrame:
    """sections with their length in seconds."""
    return sections.withColumn("seconds", (F.col("end") - F.col("start")) / US)
