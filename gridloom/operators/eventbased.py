"""Event-based disaggregation: transients into segments, features of short segments, mixtures with a confidence check,
a decoding of long segments, events on two phases, and the appliances' power.

Transients are rows (meter, t, transition) and maybe more; t is in microseconds.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import cluster, mixture
from gridloom.operators.sections import US

ORDINALS = ["fst", "sec", "trd", "fth"]


def segment_ids(levels: np.ndarray, threshold: float) -> np.ndarray:
    """For every level the number of its segment, which is the first row of the segment.

    Levels form hills over plateaus: a plateau is a level that the power comes back to, within `threshold`, before it
    falls below it. When the power leaves a plateau of three visits or more, the stretch from each visit to the next is
    marked by its number; whatever was marked inside a hill moves one storey down each time a plateau below it shows.
    Rows belong together if the marks around them read the same from the outermost to the innermost. Rows in no mark
    make one segment. Marks are kept as a tree, so the pass is linear but for the moving of list tails.
    """
    above: list[int] = []  # the node around a node
    mark: list[int] = []  # a node's number on its plateau, -1 for a storey
    tops, top_from = [], []  # nodes that no other is around, with their first rows
    bare: list[int] = []  # rows in no mark so far
    own = np.full(len(levels), -1)

    def wrap(lo: int, hi: float, number: int) -> None:
        a, b = bisect_left(top_from, lo), bisect_left(top_from, hi)
        rows = slice(bisect_left(bare, lo), bisect_left(bare, hi)) if number >= 0 else slice(0, 0)
        if a == b and rows.start == rows.stop:
            return
        node = len(mark)
        mark.append(number)
        above.append(-1)
        for x in tops[a:b]:
            above[x] = node
        own[bare[rows]] = node
        del bare[rows]
        tops[a:b], top_from[a:b] = [node], [lo]

    plateaus: list[list] = [[-math.inf, [0]]]  # level at the last visit, rows of the visits

    def leave(now: int) -> None:
        visits = plateaus.pop()[1]
        if len(visits) > 2:
            for j in range(len(visits) - 1):
                wrap(visits[j], visits[j + 1], j)
        wrap(plateaus[-1][1][-1], now, -1)

    for i, level in enumerate(levels):
        while level < plateaus[-1][0] - threshold:
            leave(i)
        if abs(level - plateaus[-1][0]) <= threshold:
            plateaus[-1][0] = level
            plateaus[-1][1].append(i)
        else:
            plateaus.append([level, [i]])
        bare.append(i)
    while len(plateaus) > 1:
        leave(len(levels) - 1)

    names: dict[tuple[int, int], int] = {}
    path = [0] * len(mark)
    for node in range(len(mark) - 1, -1, -1):  # a node around others is younger than they are
        path[node] = names.setdefault((path[above[node]] if above[node] >= 0 else -1, mark[node]), len(names))
    label = np.array([path[n] if n >= 0 else -1 for n in own], int)
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    return first[of] if len(label) else label


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys to as many tasks as a shuffle has; Spark would put rows of few bytes together in one, however long Python takes over them. Keys in an order that the rows are dealt by already change nothing."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def segments(states: DataFrame, threshold: float = 70) -> DataFrame:
    """(meter, t, transition, level, segment, size, place) of steady states: a transient lies in the segment of the state before it (the first in its own).

    Sequential, so a task a meter; `size` counts a segment's transients, `place` is a transient's place among them, from 0.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "transition"])
        ids = segment_ids(rows["level"].to_numpy(float), threshold)
        return rows.assign(segment=np.concatenate([ids[:1], ids[:-1]]))

    kind = dict(states.dtypes)["meter"]
    found = dealt(states.select("meter", "t", "transition", "level"), "meter").groupBy("meter").applyInPandas(one, f"meter {kind}, t long, transition double, level double, segment long")
    same = Window.partitionBy("meter", "segment")
    return found.withColumns({"size": F.count("*").over(same), "place": F.row_number().over(same.orderBy("t", "transition")) - 1})


def signature_peak(signature: Column, transition: Column) -> Column:
    """By how much the power overshoots in the steps of a transient (array<double>): the highest running sum less the transition for a rise, the lowest for a fall. Null without steps."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"))

    def grow(so_far: Column, step: Column) -> Column:
        total = so_far["sum"] + step
        return F.struct(total.alias("sum"), F.greatest(so_far["high"], total).alias("high"), F.least(so_far["low"], total).alias("low"))

    found = F.aggregate(signature, start, grow)
    return F.when(transition > 0, found["high"] - transition).otherwise(found["low"] - transition)


def segment_features(transients: DataFrame, size: int, spike: str = "transition", end: str = "t") -> DataFrame:
    """One row a segment of `size` (2, 3 or 4) transients, of rows with segment, size and place.

    Two: transition_avg, transition_delta, spike_up, spike_down, duration. More: every transition and every spike; four also
    have the seconds from each transient's end to the next one's start.
    """
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))  # noqa: E731  one row a place
    gap = lambda k: ((at("t", k) - at(end, k - 1)) / US)
    if size == 2:
        wanted = [(F.sum(F.abs("transition")) / 2).alias("transition_avg"), (at("transition", 0) + at("transition", 1)).alias("transition_delta"), at(spike, 0).alias("spike_up"), at(spike, 1).alias("spike_down"), gap(1).alias("duration")]
    else:
        names = ORDINALS[:size]
        wanted = [at("transition", k).alias(n) for k, n in enumerate(names)] + [at(spike, k).alias(f"{n}_spike") for k, n in enumerate(names)]
        wanted += [gap(k + 1).alias(f"{names[k]}_duration") for k in range(3)] if size == 4 else []
    return transients.where(F.col("size") == size).groupBy("meter", "segment").agg(*wanted)


def split_fours(transients: DataFrame, threshold: float = 15) -> DataFrame:
    """Transients of segments of four that may be two pairs, with `grp` 0 or 1: one after the other, crossing, or one inside the other.

    Two rises before two falls pair so that less is left over; where the first two cancel out, the pairs follow each other.
    """
    f = segment_features(transients, 4)
    a, b, c, d = (F.col(n) for n in ORDINALS)
    both = (a > 0) & (b > 0) & (c < 0) & (d < 0)
    crossing = F.abs(a + c) + F.abs(b + d) <= F.abs(a + d) + F.abs(b + c)
    pattern = F.when(both & crossing, "0101").when(both, "0110").when(a + b < threshold, "0011")
    known = f.select("meter", "segment", pattern.alias("_pattern")).where("_pattern is not null")
    return transients.where("size = 4").join(known, ["meter", "segment"]).withColumn("grp", F.substring(F.col("_pattern"), F.col("place") + 1, F.lit(1)).cast("int")).drop("_pattern")


def mixture_by_bic(rows: DataFrame, columns: list[str], most: int = 6, spread_of: list[str] | None = None, seed: int = 1, emphasis: dict[str, float] | None = None, criterion: str = "bic") -> DataFrame:
    """rows with `component` and `confident`: Gaussians fitted to all rows, as many as have the least BIC (or AIC, by `criterion`).

    `emphasis` makes a column count more (above 1) or less: the M-step widens all others by it.

    Confident is a row whose posterior is above 0.9 or which lies within a Mahalanobis distance of 1, unless its component is
    spread out (in one of `spread_of` above 0.3 of the mean and 10, with none below 0.01 of it) or small (fewer than 5 rows or a tenth of the average).
    No rows, or one different row, make component 0 without confidence.
    """
    if criterion not in ("bic", "aic"):
        raise ValueError(f"unknown criterion {criterion!r}")
    wide = mixture.widening(columns, emphasis)
    different = cluster._vectors(rows, columns).select(*columns).distinct().limit(most + 1).count()
    if different < 2:
        return rows.withColumns({"component": F.lit(0), "confident": F.lit(False)})
    fits = mixture.fit(rows, columns, list(range(1, min(most, different) + 1)), emphasis, seed)
    free = len(columns) * (len(columns) + 3) // 2
    each = {k: math.log(n) if criterion == "bic" else 2.0 for k, (_, _, n) in fits.items()}
    best = min(fits, key=lambda k: -2 * fits[k][1] + (k * (free + 1) - 1) * each[k])
    model, _, n = fits[best]
    found = mixture.placed(rows, columns, model)
    counts = {r["component"]: r["count"] for r in found.groupBy("component").count().collect()}  # at most `most` rows
    looked, usable = [columns.index(c) for c in spread_of or []], []
    for i, (mean, cov) in enumerate(zip(model.mean, model.cov, strict=True)):
        spread, size = (np.sqrt(np.diag(cov)) / wide)[looked], np.abs(mean[looked])
        broad = ((spread > 0.3 * size) & (spread > 10)).any() and not (spread < 0.01 * size).any()
        if not broad and counts.get(i, 0) >= max(5, 0.1 * n / max(len(counts), 1)):
            usable.append(i)
    confident = F.col("component").isin(usable) & ((F.col("_sure") > 0.9) | (F.col("_far") < 1))
    return found.select(*rows.columns, "component", confident.alias("confident"))


def mixture_in_two(rows: DataFrame, first: list[str], second: list[str], most: tuple[int, int] = (5, 5), spread_of: list[str] | None = None) -> DataFrame:
    """rows with `component` (as `a.b`) and `confident`: clusters by the first columns, then each of them by the second ones.

    A second level is tried for each cluster whose rows aren't all sure; a cluster that doesn't fall apart keeps its rows' answers.
    """
    top = mixture_by_bic(rows, first, most[0], spread_of).withColumnsRenamed({"component": "_a", "confident": "_sure"}).persist()
    try:
        out = None
        for r in top.groupBy("_a").agg(F.bool_and("_sure").alias("sure")).orderBy("_a").collect():  # at most `most` clusters
            mine = top.where(F.col("_a") == r["_a"])
            if r.sure:
                found = mine.withColumns({"component": F.concat(F.col("_a").cast("string"), F.lit(".0")), "confident": F.lit(True)})
            else:
                below = mixture_by_bic(mine, second, most[1], spread_of)
                found = below.withColumns({"component": F.concat_ws(".", F.col("_a").cast("string"), F.col("component").cast("string")), "confident": F.col("confident") | F.col("_sure")})
            part = found.select(*rows.columns, "component", "confident")
            out = part if out is None else out.unionByName(part)
        return rows.withColumns({"component": F.lit(""), "confident": F.lit(False)}).where("false") if out is None else out
    finally:
        top.unpersist()


def decode(x: np.ndarray, appliances: list[list[tuple[np.ndarray, np.ndarray]]], reach: float) -> list[tuple[int, int]]:
    """For each event (a row of x) the (appliance, step) it is given to, else (-1, -1).

    An appliance is a ring of steps (mean, inverse covariance). An event may take an appliance from its step to the next if
    it lies within `reach` (squared Mahalanobis distance). Of the ways to a state the one with more full rounds counts, then
    the cheaper one, then the one that leaves the later events out; the answer ends with every appliance idle.
    """
    idle = (0,) * len(appliances)
    best: dict[tuple[int, ...], tuple] = {idle: (0, 0.0, None)}  # rounds, cost, (event, appliance, step, before)
    for i, row in enumerate(x):
        steps = []
        for a, ring in enumerate(appliances):
            for s, (mean, inverse) in enumerate(ring):
                d2 = float((row - mean) @ inverse @ (row - mean))
                if d2 <= reach:
                    steps.append((a, s, math.sqrt(max(d2, 0))))
        grown = dict(best)
        for a, s, cost in steps:
            for state, (rounds, spent, way) in best.items():
                if state[a] == s:
                    now = (s + 1) % len(appliances[a])
                    to, value = (*state[:a], now, *state[a + 1 :]), (rounds + (now == 0), spent + cost)
                    if to not in grown or (-value[0], value[1]) < (-grown[to][0], grown[to][1]):
                        grown[to] = (*value, (i, a, s, way))
        best = grown
    out, way = [(-1, -1)] * len(x), best[idle][2]
    while way:
        i, a, s, way = way
        out[i] = (a, s)
    return out


def decode_segments(transients: DataFrame, columns: list[str], appliances: dict[str, list[tuple[list[float], list[list[float]]]]], reach: float = 9.0, least: int = 5) -> DataFrame:
    """(meter, segment, t, place, appliance, step) of the transients in segments of `least` or more; null where no appliance fits.

    `appliances` maps a name to its steps, each a mean and a covariance over `columns`. A task a segment.
    """
    names = list(appliances)
    rings = [[(np.array(m, float), np.linalg.pinv(np.array(c, float))) for m, c in steps] for steps in appliances.values()]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        found = decode(rows[columns].to_numpy(float), rings, reach)
        given = pd.array([s if a >= 0 else None for a, s in found], "Int32")
        return rows[["meter", "segment", "t", "place"]].assign(appliance=[names[a] if a >= 0 else None for a, _ in found], step=given)

    kind = dict(transients.dtypes)["meter"]
    some = transients.where(F.col("size") >= least).select("meter", "segment", "t", "place", *(c for c in columns if c not in ("t", "place")))
    return dealt(some, "segment", "meter").groupBy("meter", "segment").applyInPandas(one, f"meter {kind}, segment long, t long, place int, appliance string, step int")


def dense_groups(points: DataFrame, keys: list[str], eps_us: int, least: int) -> DataFrame:
    """points with `group`, from 0 by time within `keys`, null for noise: density clusters on a line.

    A point with `least` points (itself too) within eps is a core; cores no more than eps apart share a group; other points
    within eps of a core join it, the earlier of two.
    """
    around = Window.partitionBy(*keys).orderBy("t").rangeBetween(-eps_us, eps_us)
    order, turned = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys).orderBy(F.desc("t"))
    cored = points.withColumn("_core", F.when(F.count("*").over(around) >= least, F.col("t")))
    before = cored.withColumns({"_last": F.last("_core", True).over(order.rangeBetween(Window.unboundedPreceding, -1)), "_next": F.last("_core", True).over(turned.rangeBetween(Window.unboundedPreceding, -1))})
    new = F.when(F.col("_core").isNotNull() & F.coalesce(F.col("t") - F.col("_last") > eps_us, F.lit(True)), F.col("t"))
    counted = before.withColumn("_new", new).withColumn("_fresh", (F.col("_new").isNotNull() & (F.col("t") != F.coalesce(F.lag("t").over(order), F.col("t") - 1))).cast("long"))
    numbered = counted.withColumn("_n", F.sum("_fresh").over(order.rangeBetween(Window.unboundedPreceding, 0)) - 1)
    joins_last, joins_next = F.col("t") - F.col("_last") <= eps_us, F.col("_next") - F.col("t") <= eps_us
    group = F.when(F.col("_core").isNotNull() | joins_last, F.col("_n")).when(joins_next, F.col("_n") + 1)
    return numbered.withColumn("group", group).drop("_core", "_last", "_next", "_new", "_fresh", "_n")


def phase_events(transients: DataFrame, eps_s: float = 300, least: int = 5, fewest: int = 10) -> DataFrame:
    """(building, phase_a, phase_b, t, transition_a, transition_b, group) where two phases switch the same way at one instant.

    A pair of phases of fewer than `fewest` such instants has none; instants in no dense group are left out. An equi join on
    the instant, with one row a phase and instant.
    """
    once = transients.groupBy("building", "phase", "t").agg(F.sum("transition").alias("transition"))
    side = lambda x: once.select("building", "t", F.col("phase").alias(f"phase_{x}"), F.col("transition").alias(f"transition_{x}"))
    both = side("a").join(side("b"), ["building", "t"]).where("phase_a < phase_b and transition_a * transition_b > 0")
    pair = ["building", "phase_a", "phase_b"]
    enough = both.withColumn("_n", F.count("*").over(Window.partitionBy(*pair))).where(F.col("_n") >= fewest).drop("_n")
    return dense_groups(enough, pair, int(eps_s * US), least).where("group is not null").select(*pair, "t", "transition_a", "transition_b", "group")


def all_phase_events(transients: DataFrame, phases: int = 3) -> DataFrame:
    """(building, t, transitions array, total) where all phases switch the same way at one instant; the array is in the order of the phases."""
    once = transients.groupBy("building", "phase", "t").agg(F.sum("transition").alias("transition"))
    at = once.groupBy("building", "t").agg(F.count("*").alias("_n"), F.min("transition").alias("_lo"), F.max("transition").alias("_hi"), F.array_sort(F.collect_list(F.struct("phase", "transition"))).alias("_x"))  # a row a phase
    same = at.where((F.col("_n") == phases) & ((F.col("_lo") > 0) | (F.col("_hi") < 0)))
    return same.select("building", "t", F.transform("_x", lambda x: x["transition"]).alias("transitions")).withColumn("total", F.aggregate("transitions", F.lit(0.0), lambda a, x: a + x))


def single_phase(transients: DataFrame, together: DataFrame) -> DataFrame:
    """The transients of a building's phases at instants that aren't in `together`."""
    return transients.join(together.select("building", "t").distinct(), ["building", "t"], "left_anti")


def separate_phases(transients: DataFrame, phases: int = 3, eps_s: float = 300, least: int = 5, fewest: int = 10) -> DataFrame:
    """(building, phases array, t, transitions array) of rows (building, phase, t, transition): each switch with the phases that it happened on.

    Switches of all phases go first, then those of pairs of phases (`phase_events`), and what is left is of one phase. Where a phase of more than
    three would stand in several pairs at one instant, the first pair in order has it. Transitions of a phase at one instant are summed up.
    """
    once = transients.where("t is not null and transition is not null").groupBy("building", "phase", "t").agg(F.sum("transition").alias("transition"))
    order = F.array_sort(F.collect_list(F.struct("phase", "transition")))  # a row a phase
    at = once.groupBy("building", "t").agg(order.alias("_x"))
    same = F.forall("_x", lambda x: x["transition"] > 0) | F.forall("_x", lambda x: x["transition"] < 0)
    whole = at.withColumn("_all", (F.size("_x") == phases) & same & F.lit(phases > 1))
    all_of = whole.where("_all").select("building", F.transform("_x", lambda x: x["phase"]).alias("phases"), "t", F.transform("_x", lambda x: x["transition"]).alias("transitions"))
    rest = whole.where("not _all").select("building", "t", F.inline("_x"))
    both = phase_events(rest, eps_s, least, fewest)
    first = lambda c: F.min(F.struct("phase_a", "phase_b")).over(Window.partitionBy("building", "t", c))
    sides = both.withColumn("_p", F.explode(F.array("phase_a", "phase_b"))).withColumn("_ok", first("_p") == F.struct("phase_a", "phase_b"))
    kept = sides.groupBy("building", "phase_a", "phase_b", "t").agg(F.every("_ok").alias("_ok"), F.first("transition_a").alias("_a"), F.first("transition_b").alias("_b")).where("_ok")
    two = kept.select("building", F.array("phase_a", "phase_b").alias("phases"), "t", F.array("_a", "_b").alias("transitions"))
    taken = two.select("building", F.explode("phases").alias("phase"), "t")
    one = rest.join(taken, ["building", "phase", "t"], "left_anti").select("building", F.array("phase").alias("phases"), "t", F.array("transition").alias("transitions"))
    return all_of.unionByName(two).unionByName(one)


def appliance_power(events: DataFrame) -> DataFrame:
    """(meter, appliance, t, power) after each event of rows (meter, appliance, run, t, transition): what a run leaves over is taken from its first event, so that every run ends where it began."""
    run = Window.partitionBy("meter", "appliance", "run")
    first = F.row_number().over(run.orderBy("t", "transition")) == 1
    closed = events.withColumn("_change", F.col("transition") - F.when(first, F.sum("transition").over(run)).otherwise(0.0))
    at = closed.groupBy("meter", "appliance", "t").agg(F.sum("_change").alias("_change"))
    return at.select("meter", "appliance", "t", F.sum("_change").over(Window.partitionBy("meter", "appliance").orderBy("t")).alias("power"))


def remainder(grid: DataFrame, appliances: DataFrame) -> DataFrame:
    """(meter, t, value) of a meter's grid less its appliances' power on the same grid (meter, appliance, t, value)."""
    taken = appliances.groupBy("meter", "t").agg(F.sum("value").alias("_taken"))
    return grid.join(taken, ["meter", "t"], "left").select("meter", "t", (F.col("value") - F.coalesce("_taken", F.lit(0.0))).alias("value"))


def mean_shift(x: np.ndarray, width: float, rounds: int = 100, weight: np.ndarray | None = None) -> np.ndarray:
    """Centres on a line: every different value moves to the mean of the values within `width` of it; centres closer than that merge, the fuller first. Each value stands there `weight` times."""
    order = np.argsort(x, kind="stable")
    values, times = x[order], np.ones(len(x), np.int64) if weight is None else weight[order]
    total, upto = np.concatenate([[0.0], np.cumsum(values * times)]), np.concatenate([[0], np.cumsum(times)])
    at = np.unique(values)
    for _ in range(rounds):
        lo, hi = np.searchsorted(values, at - width, "left"), np.searchsorted(values, at + width, "right")
        moved = np.unique((total[hi] - total[lo]) / np.maximum(upto[hi] - upto[lo], 1))
        if len(moved) == len(at) and np.allclose(moved, at):
            break
        at = moved
    lo, hi = np.searchsorted(values, at - width, "left"), np.searchsorted(values, at + width, "right")
    kept: list[float] = []
    for k in np.lexsort((at, upto[lo] - upto[hi])):
        if all(abs(at[k] - c) > width for c in kept):
            kept.append(float(at[k]))
    return np.sort(kept)


def pair_centroids(pairs: DataFrame, width: float = 50, grain: float = 1.0) -> DataFrame:
    """(meter, centroid) of pairs' sizes, (on - off) / 2, by mean shift. Sizes are counted to `grain` first, so a task holds a histogram."""
    size = F.round((F.col("on") - F.col("off")) / 2 / grain) * grain
    counted = pairs.groupBy("meter", size.alias("w")).agg(F.count("*").alias("n"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        centres = mean_shift(rows["w"].to_numpy(float), width, weight=rows["n"].to_numpy())
        return pd.DataFrame({"centroid": centres}).assign(meter=rows["meter"].iloc[0])[["meter", "centroid"]]

    return counted.groupBy("meter").applyInPandas(one, f"meter {dict(pairs.dtypes)['meter']}, centroid double")


def opposite_centroids(rises: list[float], falls: list[float]) -> list[tuple[float, float]]:
    """Each rise, in order, with the free fall that is nearest to its opposite."""
    free, out = list(falls), []
    for r in rises:
        if free:
            out.append((r, free.pop(min(range(len(free)), key=lambda k: abs(r + free[k])))))
    return out


def switch_parameters(pairs: DataFrame, on_t: Column, off_t: Column) -> DataFrame:
    """Per meter the mean and deviation of rises, falls and spans in seconds: what likelihood_pairs takes."""
    span = (off_t - on_t) / US
    return pairs.groupBy("meter").agg(*(f(c).alias(f"{name}_{what}") for name, c in (("on", F.col("on")), ("off", F.col("off")), ("span", span)) for what, f in (("mean", F.avg), ("deviation", F.stddev_pop))))
