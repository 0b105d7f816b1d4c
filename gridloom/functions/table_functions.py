"""Operators by name in SQL, known to a session after `register`.

    SELECT * FROM hart_pairs(TABLE(SELECT meter, t, transition FROM changes) PARTITION BY meter ORDER BY (t, transition))
    SELECT * FROM fall_pairs(TABLE(changes) PARTITION BY meter ORDER BY (t DESC, id DESC))
    SELECT * FROM good_sections(3600)
    SELECT meter, dropout_rate(count(value), min(t), max(t), 60) AS rate FROM readings WHERE value IS NOT NULL GROUP BY meter
    SELECT meter, kendall(x, y) AS tau FROM pairs GROUP BY meter

The pairing functions hold what their rule keeps, not the partition's rows. Sections are SQL over the view `readings`, and the rate
is one of merged aggregates, so both are planned like any other SQL. Kendall's tau takes a whole
group in one task, and can't stand beside built-in aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from gridloom.operators import disaggregate, forecast

PAIRS = "meter long, " + disaggregate.PAIR


class _Paired:
    """The rows (meter, t, transition) of a partition, in order, through a rule; null and NaN ones are left out."""

    rule: object

    def eval(self, row: Row) -> Iterator[tuple]:
        t, v = row["t"], row["transition"]
        if t is not None and v is not None and v == v:
            for pair in self.rule.row(int(t), float(v)):
                yield (row["meter"], *pair)


class HartPairs(_Paired):
    """Ascending rows: rises with later falls of like size by a ring buffer, as `disaggregate.pair_transitions`."""

    def __init__(self):
        self.rule = disaggregate._Buffered(20, 100, 0.035, 1000)


class FallPairs(_Paired):
    """Descending rows: falls, the last first, with the nearest free rise before them, as `disaggregate.pair_from_falls`."""

    def __init__(self):
        self.rule = disaggregate._FromFalls(100, 0.035, 1000)


def _kendall(x: pd.Series, y: pd.Series) -> float:
    """Tau-b of the rows where both sides are known; null where one is constant."""
    some = x.notna() & y.notna()
    return forecast.kendall_tau(x[some].to_numpy(), y[some].to_numpy())


SECTIONS = """CREATE OR REPLACE TEMPORARY FUNCTION good_sections(max_gap_s DOUBLE) RETURNS TABLE (meter BIGINT, `start` BIGINT, `end` BIGINT)
COMMENT 'Runs of known readings with gaps of at most max_gap_s (0: no limit); single readings vanish.'
RETURN WITH known AS (SELECT meter, t, id FROM readings WHERE value IS NOT NULL AND NOT isnan(value)),
gaps AS (SELECT meter, t, id, t - lag(t) OVER (PARTITION BY meter ORDER BY t, id) AS gap FROM known),
runs AS (SELECT meter, t, sum(CASE WHEN gap IS NOT NULL AND (good_sections.max_gap_s = 0 OR gap <= good_sections.max_gap_s * 1000000) THEN 0 ELSE 1 END) OVER (PARTITION BY meter ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)
SELECT meter, min(t), max(t) FROM runs GROUP BY meter, run HAVING max(t) > min(t)"""

RATE = """CREATE OR REPLACE TEMPORARY FUNCTION dropout_rate(n BIGINT, first_t BIGINT, last_t BIGINT, period_s DOUBLE) RETURNS DOUBLE
COMMENT '1 - n / (readings that the span should hold), at least 0; null below five readings.'
RETURN CASE WHEN n >= 5 THEN greatest(0.0D, 1 - n / (rint((last_t - first_t) / 1000000D / period_s) + 1)) END"""


def register(spark: SparkSession, readings: DataFrame | None = None) -> None:
    """Make the functions known to the session; `readings` (meter, t, value, id) becomes the view of that name, if given.

    The view has to be there for `good_sections`, and is read whenever that is called.
    """
    spark.udtf.register("hart_pairs", F.udtf(HartPairs, returnType=PAIRS))
    spark.udtf.register("fall_pairs", F.udtf(FallPairs, returnType=PAIRS))
    spark.udf.register("kendall", F.pandas_udf(_kendall, "double"))
    spark.sql(RATE)
    if readings is not None:
        readings.createOrReplaceTempView("readings")
        spark.sql(SECTIONS)
