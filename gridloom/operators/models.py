"""Disaggregators with one face: train on readings of single devices, then take the mains apart.

Training keeps a table of models (one row a device), which `save` writes and `load` reads; predictions are rows (meter, t, a
column a device), as `store.predictions` takes them.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import chains, disaggregate, eventbased, training


class Disaggregator(Protocol):
    """What takes mains (meter, t, id, value) apart."""

    def disaggregate(self, mains: DataFrame) -> DataFrame: ...


class Supervised(Disaggregator, Protocol):
    """One that learns from readings (meter, t, id, value) of single devices, a meter a device."""

    model: DataFrame | None

    def train(self, devices: DataFrame) -> None: ...


MOST = 64  # devices that one mains may be split into


def _few(models: DataFrame) -> list:
    rows = models.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} devices can't be combined; train them by building")
    return rows


class _Kept:
    """A model in a table."""

    model: DataFrame | None = None

    def _trained(self) -> DataFrame:
        if self.model is None:
            raise ValueError("train or load a model first")
        return self.model

    def save(self, path: str) -> None:
        self._trained().write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> None:
        self.model = spark.read.parquet(path)


class CombinatorialOptimisation(_Kept):
    """States of each device by k-means; then the combination of states whose sum is nearest. More than twelve devices get two states."""

    def __init__(self, most: int = 3):
        self.most = most

    def train(self, devices: DataFrame) -> None:
        many = devices.select("meter").distinct().limit(13).count() > 12
        self.model = training.states_by_silhouette(devices, 2 if many else self.most).select(F.col("meter").cast("string").alias("device"), "states")

    def states(self) -> dict[str, list[float]]:
        """Of all devices, whose combinations are tried; more than MOST raise ValueError."""
        return {r.device: [float(x) for x in r.states] for r in _few(self._trained().orderBy("device"))}

    def disaggregate(self, mains: DataFrame) -> DataFrame:
        return disaggregate.co_predict(mains, self.states())


class FactorialChains(_Kept):
    """A Gaussian chain a device by EM, decoded together. With `key` other than the meter, as an appliance's type, meters of many buildings train one chain.

    With `building` named, the devices and the mains carry such a column; each building's devices are trained for themselves and its mains are
    decoded by them alone, models and mains meeting in a join.
    """

    def __init__(self, states: int = 2, rounds: int = 10, gap_s: float = 3600, longest: int = 4096, key: str = "meter", building: str | None = None):
        self.states, self.rounds, self.gap_s, self.longest, self.key, self.building = states, rounds, gap_s, longest, key, building

    def train(self, devices: DataFrame) -> None:
        """The model has key (the device), mean, var, start, move and, where asked for, the building."""
        if self.building is None:
            packed = training._cut(training.parts(devices, self.gap_s, self.longest, self.key))
            self.model = training.fit_chains(packed, self.states, self.rounds).withColumn("key", F.col("key").cast("string"))
            return
        place = F.struct(F.col(self.building).alias("building"), F.col(self.key).cast("string").alias("key"))
        named = devices.withColumns({"_place": place, "_key": F.to_json(place)})
        names = named.groupBy(F.col("_key").alias("key")).agg(F.first("_place").alias("_place"))
        # a meter number may stand in several buildings
        packed = training._cut(training.parts(named.withColumn("meter", F.col("_key")), self.gap_s, self.longest, "_key"))
        found = training.fit_chains(packed, self.states, self.rounds)
        self.model = found.join(names, "key").select(F.col("_place.building").alias(self.building), F.col("_place.key").alias("key"), *(c for c in found.columns if c != "key"))

    def disaggregate(self, mains: DataFrame) -> DataFrame:
        """(meter, t, a column a device); by building (building, meter, t, id, device, power)."""
        if self.building is not None:
            levels = F.transform("mean", lambda x: F.rint(x))
            return chains.decode_buildings(mains, self._trained().select(self.building, F.col("key").alias("device"), levels.alias("levels"), F.col("move").alias("moves")), [self.building])
        rows = _few(self._trained().orderBy("key"))
        levels = {r.key: [float(round(x)) for x in r["mean"]] for r in rows}
        return disaggregate.fhmm_decode(mains, levels, moves={r.key: r.move for r in rows})


class Hart:
    """Unsupervised: steady states, pairs of rises and falls, and the centroids of the pairs' sizes fill the power in."""

    def __init__(self, noise: float = 70, state: float = 15, width: float = 50):
        self.noise, self.state, self.width = noise, state, width

    def disaggregate(self, mains: DataFrame) -> DataFrame:
        found = disaggregate.steady_states(mains, self.noise, self.state)
        pairs = disaggregate.pair_transitions(found)
        centres = sorted(r.centroid for r in eventbased.pair_centroids(pairs.withColumn("meter", F.lit(1)), self.width).collect())  # some sizes of all pairs
        names = {f"device {k + 1}": float(c) for k, c in enumerate(centres)}
        if not names:
            return mains.select("meter", "t").where("false")
        long = disaggregate.filled_power(mains, disaggregate.centroid_states(found, names), names)
        return long.groupBy("meter", "t").pivot("device", list(names)).agg(F.max("power"))


class LikelihoodPairs(_Kept):
    """Normal rises, falls and spans of every device, then for each device pairs of the mains' switches by their likelihood, the best first."""

    def __init__(self, window_us: int, tolerance: float, least: float = 0.0):
        self.window_us, self.tolerance, self.least = window_us, tolerance, least

    def train(self, devices: DataFrame) -> None:
        found = disaggregate.steady_states(devices)
        self.model = eventbased.switch_parameters(disaggregate.pair_from_falls(found), F.col("on_t"), F.col("off_t"))

    def disaggregate(self, mains: DataFrame) -> DataFrame:
        """(meter, device, on_t, off_t, likelihood): every device has pairs of its own."""
        switches = disaggregate.steady_states(mains).select("meter", "t", F.col("transition").alias("delta"))
        found = disaggregate.likelihood_of_devices(switches, self.window_us, self.tolerance, self._trained().withColumnRenamed("meter", "device"))
        return disaggregate.accept_pairs(found, self.least, ("meter", "device"))


class EventBased:
    """Unsupervised, by segments of transients: clusters of segments of two, three and four, decoding of the longer ones, power of each appliance."""

    def __init__(self, noise: float = 10, state: float = 15, threshold: float = 70, most: int = 4, spread: float = 400.0):
        self.noise, self.state, self.threshold, self.most, self.spread = noise, state, threshold, most, spread

    def events(self, mains: DataFrame) -> DataFrame:
        """(meter, appliance, run, t, transition): the transients that went to an appliance; a run is one use of it."""
        return self._grouped(disaggregate.steady_states(mains, self.noise, self.state, emit_only=True))

    def _grouped(self, states: DataFrame) -> DataFrame:
        segments = training._cut(eventbased.segments(states, self.threshold))
        fours = eventbased.split_fours(segments)
        run = lambda *c: F.xxhash64("meter", "segment", *c)
        # segments of four that are two pairs count as segments of two
        halves = fours.withColumns({"segment": run("grp"), "size": F.lit(2).cast("long")}).withColumn("place", F.expr("row_number() over (partition by meter, segment order by place) - 1").cast("int"))
        whole = segments.join(fours.select("meter", "segment").distinct(), ["meter", "segment"], "left_anti")
        small = whole.where("size < 5").withColumn("segment", run()).unionByName(halves.select(*whole.columns))
        out, rings = None, {}
        for size in (2, 3, 4):
            some = small.where(F.col("size") == size)
            features = eventbased.segment_features(some, size)
            columns = ["transition_avg"] if size == 2 else eventbased.ORDINALS[:size]
            placed = eventbased.mixture_by_bic(features, columns, self.most, columns).where("confident")
            named = placed.select("meter", "segment", F.concat_ws(" ", F.lit("size"), F.lit(size), F.lit("group"), "component").alias("appliance"))
            found = some.join(named, ["meter", "segment"]).select("meter", "appliance", F.col("segment").alias("run"), "t", "transition", "place")
            found = training._cut(found)
            for r in found.groupBy("appliance", "place").agg(F.avg("transition").alias("m")).orderBy("appliance", "place").collect():  # a few appliances
                rings.setdefault(r.appliance, []).append(([float(r.m)], [[self.spread]]))
            out = found if out is None else out.unionByName(found)
        out = out.drop("place")
        if rings:
            long = eventbased.decode_segments(whole, ["transition"], rings).where("appliance is not null")
            turns = F.sum((F.col("step") == 0).cast("int")).over(_by("meter", "segment", "appliance"))
            rows = whole.select("meter", "segment", "t", "place", "transition").join(long.drop("t"), ["meter", "segment", "place"]).withColumn("_turn", turns)
            out = out.unionByName(rows.select("meter", "appliance", run("appliance", "_turn").alias("run"), "t", "transition"))
        return out

    def disaggregate(self, mains: DataFrame) -> DataFrame:
        """(meter, appliance, t, power) after each event."""
        return eventbased.appliance_power(self.events(mains))

    def events_of_phases(self, mains: DataFrame, phases: int = 3, eps_s: float = 300, least: int = 5, fewest: int = 10) -> DataFrame:
        """(building, phases array, phase, appliance, run, t, transition) of mains (building, phase, t, id, value): what of each event lies on each of its phases.

        Switches that phases share are a power flow of their own, for every set of phases, and so is what each phase has alone; the flows
        are taken apart each for itself, by the level that its own switches add up to.
        """
        place = F.to_json(F.struct("building", "phase"))
        named = mains.withColumn("meter", place)
        names = named.groupBy("meter").agg(F.first("building").alias("building"), F.first("phase").alias("phase"))
        found = disaggregate.steady_states(named, self.noise, self.state, emit_only=True).join(names, "meter")
        flow = F.to_json(F.struct("building", "phases"))
        parted = training._cut(eventbased.separate_phases(found.select("building", "phase", "t", "transition"), phases, eps_s, least, fewest).withColumn("meter", flow))
        total = F.aggregate("transitions", F.lit(0.0), lambda a, x: a + x)
        states = eventbased.dealt(parted.select("meter", "t", total.alias("transition")), "meter").withColumn("level", F.sum("transition").over(Window.partitionBy("meter").orderBy("t")))
        given = self._grouped(states).drop("transition").join(parted, ["meter", "t"])
        each = F.explode(F.arrays_zip(F.col("phases").alias("phase"), F.col("transitions").alias("transition")))
        return given.select("building", "phases", "appliance", "run", "t", each.alias("_e")).select("building", "phases", "_e.phase", "appliance", "run", "t", "_e.transition")

    def disaggregate_phases(self, mains: DataFrame, phases: int = 3, eps_s: float = 300, least: int = 5, fewest: int = 10) -> DataFrame:
        """(building, phases array, phase, appliance, t, power) on a phase after each event; an appliance is one of its building's and phases'."""
        key = ["building", "phases", "phase"]
        found = self.events_of_phases(mains, phases, eps_s, least, fewest).withColumn("meter", F.struct(*key))
        return eventbased.appliance_power(found).select(*(F.col("meter")[k].alias(k) for k in key), "appliance", "t", "power")


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
