"""Operators over unbounded streams: a session window a good section, closed by the watermark; pairing with a ring buffer as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.disaggregate import pair_in_buffer


def good_sections(readings: DataFrame, max_gap_s: int, late: str = "1 hour") -> DataFrame:
    """(meter, start, end) of streamed rows (meter, ts timestamp, value): the gap is inclusive, single samples are left out."""
    rows = readings.where(F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", late)
    found = rows.groupBy("meter", F.session_window("ts", f"{max_gap_s} seconds 1 microsecond")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return found.where("end > start").select("meter", "start", "end")


def tumbling_mean(readings: DataFrame, step: str, late: str = "1 hour") -> DataFrame:
    return readings.withWatermark("ts", late).groupBy("meter", F.window("ts", step)).agg(F.avg("value").alias("value")).select("meter", F.col("window.start").alias("ts"), "value")


def pair_transitions(transitions: DataFrame, size: int = 20, tolerance: float = 100, share: float = 0.035, large: float = 1000) -> DataFrame:
    """(meter, on_t, on, off_t, off) of streamed rows (meter, t long, transition): a meter's state is its ring buffer of `size` transitions.

    Rows of one batch are put in order; a row older than an earlier batch is taken as it comes. Null transitions are left out.
    """

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(parts)).sort_values("t")
        out, buffer = pair_in_buffer(buffer, zip(rows["t"].tolist(), rows["transition"].tolist(), strict=True), size, tolerance, share, large)
        state.update(tuple([b[k] for b in buffer] for k in range(3)))
        yield pd.DataFrame(out, columns=["on_t", "on", "off_t", "off"]).assign(meter=key[0])[["meter", "on_t", "on", "off_t", "off"]]

    kind = dict(transitions.dtypes)["meter"]
    some = transitions.select("meter", "t", "transition").where("transition is not null")
    return some.groupBy("meter").applyInPandasWithState(one, f"meter {kind}, on_t long, on double, off_t long, off double", "t array<long>, transition array<double>, matched array<boolean>", "append", GroupStateTimeout.NoTimeout)
