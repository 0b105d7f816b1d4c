"""Small functions of columns and of plain values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of period aliases, in seconds.
ALIASES = {"D": 86400, "H": 3600, "h": 3600, "T": 60, "min": 60, "S": 1, "s": 1, "W": 604800}


def period_seconds(alias: str) -> int:
    """Seconds of an alias as `D`, `15T` or `2H`; an unknown one raises ValueError."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+)", alias)
    if not m or m[2] not in ALIASES:
        raise ValueError(f"unknown period {alias!r}")
    return int(m[1] or 1) * ALIASES[m[2]]


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, with fractions, between two timestamps."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def capitalised(text: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def joined(values: Column, separator: str = "_") -> Column:
    """The elements of an array as one string; of a null array null."""
    return F.when(values.isNotNull(), F.array_join(F.transform(values, lambda x: x.cast("string")), separator))


def flat(values: Column) -> Column:
    return F.flatten(values)


def simplest(values: Column) -> Column:
    """The one different value of an array, null if there are more."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.element_at(values, 1))


def utc(ts: Column, zone: str) -> Column:
    """A naive local time of a zone as an instant."""
    return F.to_utc_timestamp(ts, zone)


def local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def timestamp_or_null(text: Column) -> Column:
    """What reads as a timestamp; `NaT`, `NaN`, an empty string and anything else become null."""
    return F.try_to_timestamp(text)


def day_group(ts: Column, group: str) -> Column:
    """1 on the weekdays of a group as `0-4` (Monday is 0, both ends in) or `6`, else 0."""
    lo, _, hi = group.partition("-")
    return F.weekday(ts).between(int(lo), int(hi or lo)).cast("int")


def hour_group(ts: Column, group: str) -> Column:
    """1 in the hours of a group as `06-09` (the end out; `22-06` passes midnight), else 0."""
    lo, hi = (int(x) for x in group.split("-"))
    h = F.hour(ts)
    return ((h >= lo) & (h < hi) if lo < hi else (h >= lo) | (h < hi)).cast("int")


def merged(base: dict, more: dict) -> dict:
    """Two nested dicts as one; at equal keys the second one's value, dicts merged in turn."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in more.items()}


def unsatisfied(state: dict, requirements: dict, path: str = "") -> list[str]:
    """What nested requirements ask for and the state doesn't have; `ANY VALUE` is met by any value."""
    out = []
    for k, want in requirements.items():
        at = f"{path}.{k}" if path else k
        if k not in state:
            out.append(f"{at} is missing")
        elif isinstance(want, dict):
            out += unsatisfied(state[k], want, at) if isinstance(state[k], dict) else [f"{at} is no mapping"]
        elif want != "ANY VALUE" and state[k] != want:
            out.append(f"{at} is {state[k]!r}, not {want!r}")
    return out
