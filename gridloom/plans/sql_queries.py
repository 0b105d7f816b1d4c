"""Registered queries that call the operators by name in SQL; each must give what the operator's own query gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import table_functions
from gridloom.operators import disaggregate
from gridloom.plans import registry, training_queries  # noqa: F401  the SQL of pairs
from gridloom.plans.registry import GAP, H, query, r6
from gridloom.sources import store

_SQL = registry._sql


@query(_SQL["good_sections"])
def sql_good_sections(s, d):
    table_functions.register(s, store.events(s, d))
    return s.sql(f"SELECT * FROM good_sections({GAP})")


@query(_SQL["hart_pairs"])
def sql_hart_pairs(s, d):
    table_functions.register(s)
    found = disaggregate.steady_states(store.events(s, d), emit_only=True).select("meter", "t", "transition")
    return r6(s.sql("SELECT * FROM hart_pairs(TABLE({changes}) PARTITION BY meter ORDER BY (t, transition))", changes=found), "on", "off")


@query(_SQL["pairs_from_falls"])
def sql_fall_pairs(s, d):
    table_functions.register(s)
    found = registry.transitions(s, d)
    return r6(s.sql("SELECT * FROM fall_pairs(TABLE({changes}) PARTITION BY meter ORDER BY (t DESC, id DESC))", changes=found), "on", "off")


@query(_SQL["dropout_rate"])
def sql_dropout_rate(s, d):
    table_functions.register(s)
    known = store.events(s, d).where("value is not null")
    return r6(s.sql(f"SELECT meter, dropout_rate(count(value), min(t), max(t), {H}) AS rate, count(value) AS n FROM {{known}} GROUP BY meter", known=known), "rate")


@query(_SQL["kendall_correlation"])
def sql_kendall(s, d):
    table_functions.register(s)
    rows = store.events(s, d).select("meter", "value", F.hour(F.timestamp_micros("t")).cast("double").alias("h"))
    return r6(s.sql("SELECT meter, kendall(value, h) AS tau FROM {rows} GROUP BY meter", rows=rows), "tau")
