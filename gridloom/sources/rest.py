"""Readings behind a REST service: a batch reader, a stream that polls, and a sink.

The service answers GET <url>/load?id=<key>&start=<ISO>&end=<ISO>&columns=<c,...>&sample_period=<seconds> with a JSON list of
objects with `ts` (ISO) and the columns, start included and end not, resampled by the server; POST <url>/put and <url>/append with ?id=<key> take
such a list. Register with `register(spark)`; formats `readings_rest` (read, readStream and write).
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage


def _call(url: str, verb: str, parameters: dict[str, str], body: str | None = None, tries: int = 3, wait_s: float = 60) -> str:
    request = Request(f"{url.rstrip('/')}/{verb}?{urlencode(parameters)}", None if body is None else body.encode(), {"Content-Type": "application/json"})
    for left in range(tries - 1, -1, -1):
        try:
            with urlopen(request, timeout=wait_s) as answer:
                return answer.read().decode()
        except OSError:
            # a lost answer to an append may have been stored, so only calls that can be repeated are
            if not left or verb == "append":
                raise
            time.sleep(2 ** (tries - 1 - left) / 4)
    raise AssertionError


def _when(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


class Slice(InputPartition):
    def __init__(self, key: str, start: str, end: str) -> None:
        self.key, self.start, self.end = key, start, end


def slices(key: str, start: datetime, end: datetime, period_s: float, rows: int) -> list[Slice]:
    """Stretches of at most `rows` samples each."""
    n = max(0, math.ceil((end - start).total_seconds() / (period_s * rows)))
    step = timedelta(seconds=period_s * rows)
    return [Slice(key, (start + step * k).isoformat(), min(start + step * (k + 1), end).isoformat()) for k in range(n)]


def _rows(options: dict[str, str], columns: list[str], part: Slice) -> Iterator[tuple]:
    asked = {"id": part.key, "start": part.start, "end": part.end, "columns": ",".join(columns), "sample_period": options.get("sample_period", "1")}
    for x in json.loads(_call(options["url"], "load", asked)):
        yield (part.key, _when(x["ts"]), *(None if x.get(c) is None else float(x[c]) for c in columns))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def partitions(self) -> list[Slice]:
        o = self.options
        return [s for key in o["keys"].split(",") for s in slices(key, _when(o["start"]), _when(o["end"]), float(o.get("sample_period", 1)), int(o.get("rows", 100_000)))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _rows(self.options, self.columns, partition)


class _Poller(DataSourceStreamReader):
    """The offset is the instant up to which all has been read. Samples count as complete `delay` seconds after their time."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def initialOffset(self) -> dict:
        return {"to": _when(self.options["start"]).isoformat()}

    def latestOffset(self) -> dict:
        now = datetime.now(UTC) - timedelta(seconds=float(self.options.get("delay", 0)))
        end = min(now, _when(self.options["end"])) if "end" in self.options else now
        return {"to": max(end, _when(self.options["start"])).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        o = self.options
        return [s for key in o["keys"].split(",") for s in slices(key, _when(start["to"]), _when(end["to"]), float(o.get("sample_period", 1)), int(o.get("rows", 100_000)))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _rows(self.options, self.columns, partition)

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    """Rows go out in lists of at most `rows` per key. A task that is run again sends its lists again; the service keeps one row a key and instant."""

    def __init__(self, options: dict[str, str], columns: list[str], verb: str) -> None:
        self.options, self.columns, self.verb = options, columns, verb

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        held: dict[str, list[dict]] = {}
        most = int(self.options.get("rows", 100_000))

        def send(key: str) -> None:
            _call(self.options["url"], self.verb, {"id": key}, json.dumps(held.pop(key)))

        for r in iterator:
            held.setdefault(r["key"], []).append({"ts": r["ts"].astimezone(UTC).isoformat()} | {c: r[c] for c in self.columns})
            if sum(map(len, held.values())) >= most:
                send(max(held, key=lambda k: len(held[k])))
        for key in list(held):
            send(key)
        return WriterCommitMessage()


class RestReadings(DataSource):
    """Options: url, keys (comma-separated; for reading), start, end, sample_period, rows, columns (comma-separated, default value)."""

    @classmethod
    def name(cls) -> str:
        return "readings_rest"

    @property
    def _columns(self) -> list[str]:
        return self.options.get("columns", "value").split(",")

    def schema(self) -> str:
        return "key string, ts timestamp, " + ", ".join(f"`{c}` double" for c in self._columns)

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self._columns)

    def streamReader(self, schema) -> _Poller:
        return _Poller(dict(self.options), self._columns)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), self._columns, "put" if overwrite else "append")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestReadings)
