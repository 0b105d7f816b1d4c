"""Sequential rules over the ordered rows of many groups: a task takes its groups one after the other, batch by batch.

A group's rows pass by once, so what is held of a group is what its rule keeps, not the rows; and small groups cost
no table each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Rule(Protocol):
    """One group's rule: called with the values of each row, in order, and once at the end; both give rows to put out."""

    def row(self, *values) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def scan(rows: DataFrame, keys: list[str], order: list[str | Column], values: list[str], rule: Callable[[], Rule], schema: str) -> DataFrame:
    """(keys..., schema's columns) that a new `rule()` a group puts out for `values` of its rows, in `order`.

    The row number asks for rows clustered by the keys and sorted, so where the input already is (after a window by meter), no shuffle
    is added; it also shows a task where a group begins, and that no row is out of place. Rows with null keys are one group, an
    empty table gives an empty one. `order` should tell all rows apart that the rule doesn't take as equal.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    typed = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys), schema])
    shape = to_arrow_schema(StructType.fromDDL(typed))
    width = len(keys)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, own = (), 0, None
        for b in batches:
            out: list[tuple] = []
            for n, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n == 1:
                    if own is not None:
                        out.extend((*key, *x) for x in own.end())
                    key, own = tuple(row[:width]), rule()
                elif n != last + 1:
                    raise RuntimeError("rows of a group are out of order")
                last = n
                out.extend((*key, *x) for x in own.row(*row[width:]))
            if out:
                yield table(out)
        if own is not None and (out := [(*key, *x) for x in own.end()]):
            yield table(out)

    return rows.select(place.alias("_place"), *keys, *values).mapInArrow(run, typed)
