"""One series to many. Sequential rules pass over the ordered rows of many meters a task (`ordered`); all else is DataFrame work."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import chains, ordered
from gridloom.operators.resample import nearest
from gridloom.operators.sections import known


def combinations(states: dict[str, list[float]], most: int = 100_000) -> list[tuple[float, tuple[float, ...]]]:
    if math.prod(len(v) for v in states.values()) > most:
        raise ValueError("too many state combinations; give fewer states")
    return sorted((sum(c), c) for c in itertools.product(*states.values()))


def _halves(states: dict[str, list[float]]) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """The devices in two runs of about equally many combinations."""
    names = list(states)
    size = [math.prod(len(states[n]) for n in names[:k]) for k in range(len(names) + 1)]
    cut = min(range(len(names) + 1), key=lambda k: max(size[k], size[-1] // size[k]))
    return {n: states[n] for n in names[:cut]}, {n: states[n] for n in names[cut:]}


class _Table:
    """Different sums of combinations in ascending order, each with its first combination."""

    def __init__(self, states: dict[str, list[float]], most: int):
        first: dict[float, tuple[float, ...]] = {}
        for total, combo in combinations(states, most):
            first.setdefault(total, combo)
        self.sums = np.array(sorted(first))
        self.combos = np.array([first[x] for x in self.sums.tolist()], float).reshape(len(first), len(states))

    def around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the sums at or above x and below it, as far as there are any."""
        up = np.clip(np.searchsorted(self.sums, x), 0, len(self.sums) - 1)
        return up, np.maximum(up - 1, 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The combinations whose sums are nearest, of two the larger sum."""
        up, low = self.around(x)
        return self.combos[np.where(np.abs(self.sums[low] - x) < np.abs(self.sums[up] - x), low, up)]


def nearest_of_two(a: _Table, b: _Table, x: np.ndarray) -> np.ndarray:
    """The combinations of both tables' devices whose sums are nearest to x: for every sum of one the nearest of the other."""
    out = np.empty((len(x), a.combos.shape[1] + b.combos.shape[1]))
    for i, v in enumerate(x):
        up, low = b.around(v - a.sums)
        place = np.concatenate([up, low])
        total = np.concatenate([a.sums, a.sums]) + b.sums[place]
        k = np.lexsort((np.tile(np.arange(len(a.sums)), 2), -total, np.abs(total - v)))[0]
        out[i] = np.concatenate([a.combos[k % len(a.sums)], b.combos[place[k]]])
    return out


def co_predict(mains: DataFrame, states: dict[str, list[float]], most: int = 100_000) -> DataFrame:
    """Combinatorial optimisation: the combination whose sum is nearest, of two the larger sum; a column a device.

    The sorted sums go out once, and each batch of rows is placed among them by binary search. More than `most` combinations
    are met in the middle: two tables of half the devices each, so `most` squared combinations can be searched exactly; each row
    then takes as many searches as one table has sums.
    """
    if math.prod(len(v) for v in states.values()) <= most:
        shared = mains.sparkSession.sparkContext.broadcast((_Table(states, most),))
    else:
        shared = mains.sparkSession.sparkContext.broadcast(tuple(_Table(half, most) for half in _halves(states)))

    def place(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        tables = shared.value
        for rows in batches:
            x = rows["value"].to_numpy(float)
            known = ~np.isnan(x)
            chosen = np.full((len(x), len(states)), np.nan)
            chosen[known] = tables[0].nearest(x[known]) if len(tables) == 1 else nearest_of_two(*tables, x[known])
            yield rows.assign(**{n: pd.Series(chosen[:, k], index=rows.index).astype(object).where(known, None) for k, n in enumerate(states)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in mains.schema), *(f"`{n}` double" for n in states)])
    return mains.mapInPandas(place, schema)


def _in_runs(readings: DataFrame, state: float, columns: tuple[str, ...]) -> DataFrame:
    """Readings with `run`, `_jump` (a change to this row) and `_more` (one from this row on, too)."""
    order = Window.partitionBy("meter").orderBy("t", "id")
    jump = F.lit(False)
    for c in columns:
        jump = jump | (F.abs(F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0.0))) > state)
    rows = readings.where(" and ".join(f"{c} is not null and not isnan({c})" for c in columns)).withColumn("_jump", jump)
    rows = rows.withColumn("_new", (F.col("_jump") & ~F.coalesce(F.lag("_jump").over(order), F.lit(False))).cast("long")).withColumn("_more", F.col("_jump") & F.coalesce(F.lead("_jump").over(order), F.lit(False)))
    return rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def runs(readings: DataFrame, state: float = 15, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """(meter, run, t, ends, <column>...) of the runs of a series, where any column changes by more than `state` from one row to the next.

    A run begins with a change and ends before the next change that follows a calm row. Its level is the mean from the last
    row of the change on; `ends` is the first calm row's time (the change's last row's, where none follows). `first` marks the
    meter's first row's time. All by windows over one ordered pass a meter.
    """
    rows = _in_runs(readings, state, columns)
    level = lambda c: F.avg(F.when(~F.col("_more"), F.col(c))).alias(c)
    found = rows.groupBy("meter", "run").agg(F.min("t").alias("t"), F.coalesce(F.min(F.when(~F.col("_jump"), F.col("t"))), F.max("t")).alias("ends"), *(level(c) for c in columns))
    return found.withColumn("first", F.min("t").over(Window.partitionBy("meter")))


def _without_start(states: DataFrame, noise: float, columns: tuple[str, ...]) -> DataFrame:
    """The states less a meter's first one where it is only the power that the series begins with."""
    high = " or ".join(f"level_{c} > {noise}" for c in columns)
    n = F.row_number().over(Window.partitionBy("meter").orderBy("run"))
    return states.withColumn("_n", n).where(f"not (_n = 1 and t = first and ({high}))")


def steady_states(readings: DataFrame, noise: float = 70, state: float = 15, emit_only: bool = False) -> DataFrame:
    """(meter, t, transition, level) of every change of the running level by more than `noise`.

    A sample that differs from the one before by more than `state` is a change; the level is the running mean since the
    last change. With emit_only the reference level moves only when a transition is emitted.
    """
    found = steady_states_of(readings, ("value",), noise, state, emit_only)
    return found.select("meter", "t", F.col("transition_value").alias("transition"), F.col("level_value").alias("level"))


def signatures(readings: DataFrame, state: float = 15, longest: int = 256) -> DataFrame:
    """(meter, run, signature array<double>, steps, high, low) of every change: the steps of the readings from the last calm one before it to the first calm one after it, in order.

    `high` and `low` are the extremes of the steps' running sum. Both are the readings' extremes less the reading before the
    first step, so they need no array: a change of more than `longest` steps, as a series that never rests has, has a null signature but its
    steps and extremes. What comes before a meter's first change is none.
    """
    order = Window.partitionBy("meter").orderBy("t", "id")
    rows = _in_runs(readings, state, ("value",))
    step = F.col("value") - F.coalesce(F.lag("value").over(order), F.lit(0.0))
    rows = rows.select("meter", "run", "t", "id", "value", "_jump", "_new", step.alias("_step"), F.lag("_jump").over(order).alias("_was"))
    calm = F.lag(F.struct("value", "_step")).over(order)  # the row before a change
    inside = rows.withColumn("_calm", F.when(F.col("_new") == 1, calm)).where("run > 0 and (_jump or _was)")
    place = F.row_number().over(Window.partitionBy("meter", "run").orderBy("t", "id"))
    inside = inside.withColumn("_n", place)
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= longest, F.struct("_n", "_step")))), lambda x: x["_step"])
    found = inside.groupBy("meter", "run").agg(F.max("_calm").alias("_calm"), own.alias("_own"), F.count("*").alias("_rows"), F.max("value").alias("_max"), F.min("value").alias("_min"))
    before, base = F.col("_calm._step"), F.coalesce(F.col("_calm.value") - F.col("_calm._step"), F.lit(0.0))
    steps = F.col("_rows") + F.col("_calm").isNotNull().cast("long")
    whole = F.concat(F.when(before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<double>")), F.col("_own"))
    return found.select("meter", "run", F.when(steps <= longest, whole).alias("signature"), steps.alias("steps"), F.greatest(F.col("_max") - base, before).alias("high"), F.least(F.col("_min") - base, before).alias("low"))


def transients(readings: DataFrame, noise: float = 70, state: float = 15, emit_only: bool = True, longest: int = 256) -> DataFrame:
    """(meter, t, ends, transition, level, signature, steps, peak): steady states with the steps of their changes and by how much these overshoot."""
    found = steady_states_of(readings, ("value",), noise, state, emit_only, with_run=True)
    both = found.join(signatures(readings, state, longest), ["meter", "run"], "left")
    peak = F.when(F.col("transition_value") > 0, F.col("high") - F.col("transition_value")).otherwise(F.col("low") - F.col("transition_value"))
    return both.select("meter", "t", "ends", F.col("transition_value").alias("transition"), F.col("level_value").alias("level"), "signature", "steps", peak.alias("peak"))


class _Emitted:
    """Levels that differ by more than `noise` from the one put out last."""

    def __init__(self, noise: float, columns: int):
        self.noise, self.before = noise, (0.0,) * columns

    def row(self, run: int, t: int, ends: int, first: int, *level: float) -> Iterable[tuple]:
        moved = tuple(x - y for x, y in zip(level, self.before, strict=True))
        if any(abs(x) > self.noise for x in moved):
            self.before = level
            yield (run, t, ends, first, *level, *moved)

    def end(self) -> Iterable[tuple]:
        return ()


def steady_states_of(readings: DataFrame, columns: tuple[str, ...] = ("value",), noise: float = 70, state: float = 15, emit_only: bool = False, with_run: bool = False) -> DataFrame:
    """(meter, t, ends, transition_<c>..., level_<c>...): the same of several columns, as active and reactive power, of which any may change; `with_run` also names each change's run.

    `ends` is the first calm row's time after the change. The rows become runs by windows; with emit_only, where the
    reference level depends on what was emitted, the runs alone (one row a change) go through a sequential pass.
    """
    found = runs(readings, state, columns)
    if not emit_only:
        order = Window.partitionBy("meter").orderBy("run")
        found = found.select("meter", "run", "t", "ends", "first", *(F.col(c).alias(f"level_{c}") for c in columns), *((F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0.0))).alias(f"transition_{c}") for c in columns))
        found = found.where(" or ".join(f"abs(transition_{c}) > {noise}" for c in columns))
    else:
        levels = [f"level_{c}" for c in columns]
        own = found.select("meter", "run", "t", "ends", "first", *(F.col(c).alias(x) for c, x in zip(columns, levels, strict=True)))
        shape = "run long, t long, ends long, first long, " + ", ".join(f"{x} double" for x in [*levels, *(f"transition_{c}" for c in columns)])
        found = ordered.scan(own, ["meter"], ["run"], ["run", "t", "ends", "first", *levels], lambda: _Emitted(noise, len(columns)), shape)
    return _without_start(found, noise, columns).select("meter", *["run"] * with_run, "t", "ends", *(f"transition_{c}" for c in columns), *(f"level_{c}" for c in columns))


def pair_in_buffer(buffer: list[list], rows: Iterable[tuple[int, float]], size: int, tolerance: float, share: float, large: float) -> tuple[list[tuple], list[list]]:
    """The pairs that rows (t, transition), in order, make with a ring buffer of (t, transition, matched), and the buffer after them."""
    out = []
    for t, p in rows:
        if len(buffer) == size:
            kept = [b for b in buffer if not b[2]]
            buffer = kept if len(kept) < size else kept[1:]
        buffer.append([t, p, False])
        if p < 0:  # older pairs failed before, so only the new fall can match: the nearest rise first
            for a in reversed(buffer[:-1]):
                big = max(abs(a[1]), abs(p))
                if a[1] > 0 and not a[2] and abs(a[1] + p) < (tolerance if big < large else share * big):
                    a[2] = buffer[-1][2] = True
                    out.append((a[0], a[1], t, p))
                    break
    return out, buffer


class _Buffered:
    """Pairs by a ring buffer, which is all that is held."""

    def __init__(self, *limits: float):
        self.limits, self.buffer = limits, []

    def row(self, t: int, transition: float) -> Iterable[tuple]:
        out, self.buffer = pair_in_buffer(self.buffer, [(t, transition)], *self.limits)
        return out

    def end(self) -> Iterable[tuple]:
        return ()


PAIR = "on_t long, on double, off_t long, off double"


def _switches(transitions: DataFrame, *more: str) -> DataFrame:
    return transitions.select("meter", "t", *more, F.col("transition").cast("double").alias("transition")).where("transition is not null and not isnan(transition)")


def pair_transitions(transitions: DataFrame, size: int = 20, tolerance: float = 100, share: float = 0.035, large: float = 1000) -> DataFrame:
    """(meter, on_t, on, off_t, off): rises paired with later falls of like size in a ring buffer, nearest first.

    Of transitions at one instant the larger fall comes first; null and NaN ones are left out. A task holds a buffer, however long the series.
    """
    return ordered.scan(_switches(transitions), ["meter"], ["t", "transition"], ["t", "transition"], lambda: _Buffered(size, tolerance, share, large), PAIR)


def _density(x: Column, p: tuple[float | Column, float | Column]) -> Column:
    return F.exp(-((x - p[0]) * (x - p[0])) / (2 * p[1] * p[1])) / (p[1] * math.sqrt(2 * math.pi))


def near_pairs(switches: DataFrame, window_us: int, tolerance: float) -> DataFrame:
    """(meter, on_t, rise, off_t, fall) of rises and falls of like size inside a window; time buckets make it an equi join."""
    rises = switches.where("delta > 0").select("meter", F.col("t").alias("on_t"), F.col("delta").alias("rise")).withColumn("bucket", F.explode(F.array(F.expr(f"on_t div {window_us}"), F.expr(f"on_t div {window_us} + 1"))))
    falls = switches.where("delta < 0").select("meter", F.col("t").alias("off_t"), F.col("delta").alias("fall"), F.expr(f"t div {window_us}").alias("bucket"))
    return rises.join(falls, ["meter", "bucket"]).drop("bucket").where((F.col("off_t") > F.col("on_t")) & (F.col("off_t") < F.col("on_t") + window_us) & (F.abs(F.col("rise") + F.col("fall")) < tolerance))


def _likelihood(on: tuple, off: tuple, span: tuple) -> Column:
    return (_density(F.col("rise"), on) * _density(F.col("fall"), off) * _density((F.col("off_t") - F.col("on_t")) / 1e6, span)).alias("likelihood")


def likelihood_pairs(switches: DataFrame, window_us: int, tolerance: float, on: tuple[float, float], off: tuple[float, float], span: tuple[float, float]) -> DataFrame:
    """(meter, on_t, off_t, likelihood) of near pairs with the product of three normal densities."""
    return near_pairs(switches, window_us, tolerance).select("meter", "on_t", "off_t", _likelihood(on, off, span))


def likelihood_of_devices(switches: DataFrame, window_us: int, tolerance: float, devices: DataFrame, least_deviation: float = 1.0) -> DataFrame:
    """(meter, device, on_t, off_t, likelihood) of near pairs for every device of (device, on_mean, on_deviation, off_..., span_...), a row a pair and device."""
    p = [c for n in ("on", "off", "span") for c in (F.col(f"{n}_mean").alias(f"{n}_mean"), F.greatest(f"{n}_deviation", F.lit(least_deviation)).alias(f"{n}_deviation"))]
    listed = devices.agg(F.collect_list(F.struct("device", *p)).alias("_d"))  # one row
    both = near_pairs(switches, window_us, tolerance).join(F.broadcast(listed)).select("meter", "on_t", "rise", "off_t", "fall", F.explode("_d").alias("_d"))
    of = lambda n: (F.col(f"_d.{n}_mean"), F.col(f"_d.{n}_deviation"))
    return both.select("meter", F.col("_d.device").alias("device"), "on_t", "off_t", _likelihood(of("on"), of("off"), of("span")))


def kmeans_1d(x: np.ndarray, k: int, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Centres of values that each stand there `weight` (a whole number) times."""
    weight = np.ones(len(x), np.int64) if weight is None else weight
    order = np.argsort(x, kind="stable")
    x, weight = x[order], weight[order]
    place = (np.arange(k) + 0.5) / k * (weight.sum() - 1)
    below, upto = np.floor(place), np.cumsum(weight)
    low, high = (x[np.searchsorted(upto, p, "right")] for p in (below, np.ceil(place)))
    centres = low + (high - low) * (place - below)
    for _ in range(rounds):
        own = np.abs(x[:, None] - centres[None]).argmin(1)
        new = np.array([np.average(x[own == i], weights=weight[own == i]) if (own == i).any() else centres[i] for i in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return np.sort(centres)


def cluster_states(readings: DataFrame, k: int = 2, least: float = 10, few: int = 20) -> DataFrame:
    """(meter, states array<int>): rounded centres of the values above `least`, and 0. Values are counted in bins of 1 W first, so a task holds a histogram, not the series."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        n, x = rows["n"].to_numpy(), rows["w"].to_numpy(float)
        states = [0] if n.sum() < few else sorted({0, *np.rint(kmeans_1d(x, min(k, len(np.unique(x))), weight=n)).astype(int).tolist()})
        return pd.DataFrame({"meter": [rows["meter"].iloc[0]], "states": [states]})

    kind = dict(readings.dtypes)["meter"]
    counted = known(readings).where(F.col("value") > least).groupBy("meter", F.round("value").alias("w")).agg(F.count("*").alias("n"))
    return counted.groupBy("meter").applyInPandas(one, f"meter {kind}, states array<int>")


def fhmm_train(readings: DataFrame, levels: list[float], prior: float = 1.0) -> DataFrame:
    """(meter, state, mean, n, start, move array<double>) of each meter's chain over the sorted levels.

    Readings go to the nearest level (of two the upper) and moves are counted from each reading to the next, `prior` added to
    every count; a level without readings keeps its own value as mean. One ordered pass and one aggregation, no inner loop.
    """
    levels = sorted({float(x) for x in levels})
    states = F.array(*map(F.lit, levels))
    placed = known(readings).select("meter", "t", "id", "value", (F.array_position(states, nearest(states, F.col("value"))) - 1).alias("state"))
    next_one = F.lead("state").over(Window.partitionBy("meter").orderBy("t", "id"))
    counted = placed.withColumn("_next", next_one).groupBy("meter", "state").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), *(F.count_if(F.col("_next") == k).alias(f"_{k}") for k in range(len(levels))))
    every = counted.select("meter").distinct().withColumn("state", F.explode(F.array(*(F.lit(k).cast("long") for k in range(len(levels))))))
    full = every.join(counted, ["meter", "state"], "left").na.fill(0, ["n", *(f"_{k}" for k in range(len(levels)))])
    moves = [F.col(f"_{k}") + F.lit(prior) for k in range(len(levels))]
    share = F.col("n") / F.sum("n").over(Window.partitionBy("meter"))
    return full.select("meter", F.col("state").cast("int").alias("state"), F.coalesce("mean", F.get(states, F.col("state").cast("int"))).alias("mean"), "n", share.alias("start"), F.array(*(m / sum(moves, F.lit(0.0)) for m in moves)).alias("move"))


def fhmm_decode(mains: DataFrame, states: dict[str, list[float]], stay: float = 0.95, variance: float = 5.0, moves: dict[str, list[list[float]]] | None = None, longest: int = chains.LONGEST) -> DataFrame:
    """Viterbi decoding of the product chain of all devices (last device fastest): (meter, t, a column a device), the same for any `longest` samples a task.

    `moves` gives a device's matrix of moves, as trained; a device without one stays with probability `stay`.
    """
    names, levels = list(states), list(states.values())
    own = [np.array(moves[n], float) if moves and n in moves else chains.staying(len(v), stay) for n, v in states.items()]
    product = chains.Product(levels, own, variance)
    found = chains.decode(mains, lambda _: product, [], (), longest)
    return found.select("meter", "t", *(F.col("levels")[k].alias(n) for k, n in enumerate(names)))


class _FromFalls:
    """Falls wait, the last of them first, for a rise that comes before them; rows come from the last to the first."""

    def __init__(self, tolerance: float, share: float, large: float):
        self.tolerance, self.share, self.large = tolerance, share, large
        self.waiting: list[list] = []  # (t, transition, power undone so far)

    def row(self, t: int, v: float) -> Iterable[tuple]:
        free, still = v > 0, []
        for fall in self.waiting:
            near = self.tolerance if abs(v - fall[1]) < self.large else self.share * max(abs(v), abs(fall[1]))
            if free and abs(v + fall[1]) < near:
                free = False
                yield t, v, fall[0], fall[1]
                continue
            fall[2] -= v
            if fall[2] >= fall[1] - near:
                still.append(fall)
        self.waiting = still
        if v < 0:
            still.append([t, v, 0.0])

    def end(self) -> Iterable[tuple]:
        return ()


def pair_from_falls(transitions: DataFrame, tolerance: float = 100, share: float = 0.035, large: float = 1000) -> DataFrame:
    """(meter, on_t, on, off_t, off): from the last fall to the first, each with the nearest free rise of like size before it.

    The way back ends where the power, undone step by step from the fall, lies below what the fall could have switched off, so
    a task holds the falls that are still on their way. Of transitions at one instant that of the larger `id` is the later one or, without
    that column, the larger rise; null and NaN ones are left out.
    """
    later = "id" if "id" in transitions.columns else "transition"
    rows = _switches(transitions, *["id"] * (later == "id"))
    return ordered.scan(rows, ["meter"], [F.desc("t"), F.desc(later)], ["t", "transition"], lambda: _FromFalls(tolerance, share, large), PAIR)


class _Free:
    """Spans that don't overlap those taken before."""

    def __init__(self):
        self.taken: list[tuple[int, int]] = []

    def row(self, on_t: int, off_t: int, likelihood: float) -> Iterable[tuple]:
        at = bisect.bisect_right(self.taken, (on_t, off_t))
        if (at == 0 or self.taken[at - 1][1] <= on_t) and (at == len(self.taken) or self.taken[at][0] >= off_t):
            self.taken.insert(at, (on_t, off_t))
            yield on_t, off_t, likelihood

    def end(self) -> Iterable[tuple]:
        return ()


def accept_pairs(pairs: DataFrame, least: float = 0.0, keys: tuple[str, ...] = ("meter",)) -> DataFrame:
    """Of (meter, on_t, off_t, likelihood) the rows that are taken by descending likelihood while their span is still free; of equal ones the earlier. Spans of different `keys` don't stand in each other's way.

    A task holds the spans taken of one group, not its candidates.
    """
    some = pairs.where(F.col("likelihood") >= least)
    return ordered.scan(some, list(keys), [F.desc("likelihood"), "on_t", "off_t"], ["on_t", "off_t", "likelihood"], _Free, "on_t long, off_t long, likelihood double")


def centroid_states(transitions: DataFrame, centroids: dict[str, float]) -> DataFrame:
    """(meter, t, device, state) of every transition: 1 for a rise, 0 for a fall, of the device whose centroid is nearest in size (of two the first)."""
    size = F.abs("transition")
    near = F.array_min(F.array(*(F.struct(F.abs(size - abs(float(c))).alias("far"), F.lit(k).alias("k"), F.lit(n).alias("device")) for k, (n, c) in enumerate(centroids.items()))))
    return transitions.select("meter", "t", near["device"].alias("device"), F.when(F.col("transition") > 0, 1).otherwise(0).alias("state"))


def filled_power(readings: DataFrame, states: DataFrame, centroids: dict[str, float]) -> DataFrame:
    """(meter, t, id, device, power) for every reading: the device's centroid while it is on, from the reading after the event; 0 before any event.

    Events and readings meet in one ordered pass a meter. Of several events of a device at one instant the off state counts.
    """
    once = states.groupBy("meter", "t", "device").agg(F.min("state").alias("state"))
    wide = once.groupBy("meter", "t").pivot("device", list(centroids)).agg(F.first("state"))
    both = known(readings).select("meter", "t", "id").withColumn("_own", F.lit(True)).unionByName(wide.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    before = Window.partitionBy("meter").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    power = {n: F.coalesce(F.last(F.col(f"`{n}`"), True).over(before), F.lit(0)) * float(c) for n, c in centroids.items()}
    filled = both.select("meter", "t", "id", "_own", *(x.alias(n) for n, x in power.items())).where("_own").drop("_own")
    return filled.unpivot(["meter", "t", "id"], [F.col(f"`{n}`") for n in centroids], "device", "power")
