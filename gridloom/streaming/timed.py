"""Pairing over a stream whose state ends: a meter that rests loses its buffer, and nothing leaves without a row.

The session must keep state in RocksDB (`STORE`), as every processor with timers does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.operators.disaggregate import pair_in_buffer

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
COLUMNS = ["kind", "on_t", "on", "off_t", "off"]


class _Pairing(StatefulProcessor):
    """State of a meter: its ring buffer, and the latest instant that was paired."""

    def __init__(self, idle_us: int, limits: tuple):
        self.idle_us, self.limits = idle_us, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buffer", "t array<long>, transition array<double>, matched array<boolean>, last long")

    def _held(self) -> tuple[list[list], int]:
        if not self.state.exists():
            return [], -(1 << 62)
        *columns, last = self.state.get()
        return [list(x) for x in zip(*columns, strict=True)], last

    def _out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS).astype({"on_t": "Int64", "off_t": "Int64"})
        out.insert(0, "meter", key[0])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        buffer, last = self._held()
        own = pd.concat(list(rows)).sort_values(["t", "transition"])
        late = own[own["t"] < last]
        fresh = own[own["t"] >= last]
        out = [("late", t, v, None, None) if v > 0 else ("late", None, None, t, v) for t, v in zip(late["t"].tolist(), late["transition"].tolist(), strict=True)]
        if len(fresh):
            found, buffer = pair_in_buffer(buffer, zip(fresh["t"].tolist(), fresh["transition"].tolist(), strict=True), *self.limits)
            out += [("pair", *x) for x in found]
            last = int(fresh["t"].iloc[-1])
            self.state.update((*([b[k] for b in buffer] for k in range(3)), last))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer((last + self.idle_us) // 1000 + 1)
        yield self._out(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        buffer, _ = self._held()
        self.state.clear()
        yield self._out(key, [("open", t, v, None, None) for t, v, matched in buffer if v > 0 and not matched])

    def close(self) -> None:
        pass


def pair_transitions(transitions: DataFrame, idle_s: float, late: str = "0 seconds", size: int = 20, tolerance: float = 100, share: float = 0.035, large: float = 1000) -> DataFrame:
    """(meter, kind, on_t, on, off_t, off) of streamed rows (meter, t long in microseconds, transition).

    `pair`: a rise with its fall, as the batch operator pairs them. `late`: a row older than what its meter has paired already, for a
    side table (`split`). `open`: a rise still alone in the buffer when its meter has had no row for `idle_s` of event time; then
    its state goes. The watermark stays `late` behind; what is older still, Spark drops and counts. Null and NaN transitions are left out.
    """
    kind = dict(transitions.dtypes)["meter"]
    some = transitions.select("meter", "t", F.col("transition").cast("double").alias("transition")).where("t is not null and transition is not null and not isnan(transition)")
    timed = some.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", late)
    shape = f"meter {kind}, kind string, on_t long, on double, off_t long, off double"
    return timed.groupBy("meter").transformWithStateInPandas(_Pairing(int(idle_s * 1_000_000), (size, tolerance, share, large)), shape, "Append", "EventTime")


def split(found: DataFrame, checkpoint: str, path: str):
    """A query that keeps each kind of row in a table of its own below `path`: pair, late and open. A batch that runs again replaces its own files."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(path)

    return found.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
