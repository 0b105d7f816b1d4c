"""Aggregates that have a value, or null, for every input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation over the rows where both sides are known; null where a side is constant or no row has both."""
    x, y = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (x, y))
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
