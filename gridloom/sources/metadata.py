"""Metadata of a store (dataset, meter devices, one file a building) as dimension tables.

The files are small; they are read through Spark, so that any path that Spark reads will do. YAML needs the yaml module,
JSON files nothing more. Missing keys are null; a building without meters or appliances gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METERS = "building int, meter int, device_model string, site_meter boolean, submeter_of int, data_location string, disabled boolean"
APPLIANCES = "building int, type string, instance int, original_name string, meters array<int>, on_power double, min_on_duration double, min_off_duration double, dominant boolean"
DEVICES = "model string, manufacturer string, sample_period double, max_sample_period double, measurements array<struct<physical_quantity:string,ac_type:string,lower_limit:double,upper_limit:double>>"


def _parse(name: str, text: str) -> dict:
    if name.endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError as e:
        raise ImportError("metadata in YAML needs the yaml module; give JSON files") from e
    return yaml.safe_load(text) or {}


def _number(x) -> float | None:
    return None if x is None else float(x)


def records(name: str, text: str) -> list[tuple[str, dict]]:
    """(table, row) for everything that one metadata file says."""
    stem, found, out = name.rsplit(".", 1)[0], _parse(name, text), []
    if stem == "meter_devices":
        for model, x in found.items():
            ms = [{"physical_quantity": m.get("physical_quantity"), "ac_type": m.get("type") or None, "lower_limit": _number(m.get("lower_limit")), "upper_limit": _number(m.get("upper_limit"))} for m in x.get("measurements") or []]
            out.append(("devices", {"model": model, "manufacturer": x.get("manufacturer"), "sample_period": _number(x.get("sample_period")), "max_sample_period": _number(x.get("max_sample_period")), "measurements": ms}))
    elif re.fullmatch(r"building\d+", stem):
        b = int(found.get("instance") or stem[len("building") :])
        for m, x in (found.get("elec_meters") or {}).items():
            x = x or {}
            up = x.get("submeter_of")
            row = {"building": b, "meter": int(m), "device_model": x.get("device_model"), "site_meter": bool(x.get("site_meter", False)), "submeter_of": None if up is None else int(up)}
            out.append(("meters", row | {"data_location": x.get("data_location") or f"/building{b}/elec/meter{m}", "disabled": bool(x.get("disabled", False))}))
        for x in found.get("appliances") or []:
            on = x.get("on_power_threshold", (x.get("nominal_consumption") or {}).get("on_power"))
            row = {"building": b, "type": x.get("type"), "instance": int(x.get("instance") or 1), "original_name": x.get("original_name"), "meters": [int(m) for m in x.get("meters") or []], "on_power": _number(on)}
            out.append(("appliances", row | {"min_on_duration": _number(x.get("min_on_duration")), "min_off_duration": _number(x.get("min_off_duration")), "dominant": bool(x.get("dominant_appliance", False))}))
    return out


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """`meters`, `appliances` and `devices` of a metadata folder; each file is parsed in the task that reads it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(kind, json.dumps(x)) for f, text in zip(rows["f"], rows["value"], strict=True) for kind, x in records(f.rsplit("/", 1)[-1], text)]
            yield pd.DataFrame(found, columns=["kind", "record"])

    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.{yaml,yml,json}").select(F.input_file_name().alias("f"), "value")
    parsed = texts.mapInPandas(run, "kind string, record string")
    one = lambda kind, schema: parsed.where(F.col("kind") == kind).select(F.from_json("record", schema).alias("_r")).select("_r.*")
    return {"meters": one("meters", METERS), "appliances": one("appliances", APPLIANCES), "devices": one("devices", DEVICES)}


def save(found: dict[str, DataFrame], path: str) -> None:
    for name, df in found.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("meters", "appliances", "devices")}


def edges(meters: DataFrame) -> DataFrame:
    """(meter, parent) for the wiring tree, meters named building/meter; `submeter_of: 0` means the first site meter."""
    name = lambda m: F.concat_ws("/", F.col("building"), m)
    site = meters.where("site_meter").groupBy("building").agg(F.min("meter").alias("_site"))
    up = F.when(F.col("submeter_of") == 0, F.col("_site")).otherwise(F.col("submeter_of"))
    rows = meters.join(site, "building", "left").withColumn("_up", F.when(~F.col("site_meter"), up))
    return rows.select(name(F.col("meter")).alias("meter"), F.when(F.col("_up").isNotNull() & (F.col("_up") != F.col("meter")), name(F.col("_up"))).alias("parent"))


def on_thresholds(meters: DataFrame, appliances: DataFrame, default: float = 10.0) -> DataFrame:
    """(building, meter, on_power, min_on, min_off): the least threshold and the longest durations of a meter's appliances."""
    each = appliances.select("building", F.explode("meters").alias("meter"), "on_power", "min_on_duration", "min_off_duration")
    found = meters.select("building", "meter").join(each, ["building", "meter"], "left").groupBy("building", "meter")
    return found.agg(F.min(F.coalesce("on_power", F.lit(default))).alias("on_power"), F.coalesce(F.max("min_on_duration"), F.lit(0.0)).alias("min_on"), F.coalesce(F.max("min_off_duration"), F.lit(0.0)).alias("min_off"))
