"""Progress of a run in the output folder: which steps are complete, and the tables to go on with."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from datetime import UTC, date, datetime, timedelta
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions import names

FILE = "progress.json"


def load(out_root: str) -> dict:
    """The record of earlier steps; an absent or broken one is empty."""
    try:
        with open(f"{out_root}/{FILE}", encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def completed(record: dict) -> set[int]:
    """Ids of complete steps, by the list or by the steps' own records."""
    listed, steps = record.get("Completed steps"), record.get("steps")
    ids = [*(listed if isinstance(listed, list) else []), *(steps if isinstance(steps, dict) else {})]
    return {int(i) for i in ids if str(i).isdecimal()}


def json_safe(value: object) -> object:
    """value as JSON has it: enums by name, times in ISO 8601, durations as objects, sets in order; anything else as text."""
    match value:
        case Enum():
            return value.name
        case None | bool() | int() | float() | str():
            return value
        case datetime() | date():
            return value.isoformat()
        case timedelta():
            return {"iso8601": f"PT{value.total_seconds():g}S", "seconds": int(value.total_seconds())}
        case Mapping():
            return {str(json_safe(k)): json_safe(v) for k, v in value.items()}
        case set() | frozenset():
            return sorted((json_safe(v) for v in value), key=str)
        case list() | tuple():
            return [json_safe(v) for v in value]
    return str(value)


def save(out_root: str, step: int, seconds: float, result: dict | Callable[[], dict], tables: dict[str, DataFrame], in_root: str, message: str = "") -> None:
    """Writes the tables and only then the record that names them, which replaces the old one at once.

    Each save has a folder of its own, so that a save that breaks off leaves the earlier one whole.
    ``result`` may be called for once the tables are written, if it is measured meanwhile.
    """
    record = load(out_root)
    stamp = datetime.now(UTC)
    snapshot = f"snapshots/step{step}-{stamp:%Y%m%dT%H%M%S%f}"
    for name, table in tables.items():
        table.write.parquet(f"{out_root}/{snapshot}/{name}")
    steps = record.get("steps") if isinstance(record.get("steps"), dict) else {}
    found = json_safe(result() if callable(result) else result)
    steps[str(step)] = {"duration": json_safe(timedelta(seconds=seconds)), "result": found, "message": message, "snapshot": snapshot, "tables": sorted(tables), "dataset_root": in_root.replace("\\", "/"), "output_root": out_root.replace("\\", "/")}
    new = {"Completed steps": sorted(completed(record) | {step}), "steps": steps, "dataset_root": in_root.replace("\\", "/"), "output_root": out_root.replace("\\", "/"), "snapshot": snapshot, "tables": sorted(tables), "updated_at": stamp.isoformat()}
    os.makedirs(out_root, exist_ok=True)
    part = f"{out_root}/{FILE}.tmp"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(new, f, indent=2, ensure_ascii=False)
    os.replace(part, f"{out_root}/{FILE}")


def restore(spark: SparkSession, out_root: str, in_root: str, path_columns: tuple[str, ...] = ("path", "source", "target")) -> dict[str, DataFrame]:
    """The saved tables of all complete steps, of one name the last step's, with paths below the old roots moved to the present ones; empty without a record."""
    record = load(out_root)
    if "snapshot" not in record:
        return {}
    steps = record.get("steps") if isinstance(record.get("steps"), dict) else {}
    # Each step's tables have the roots of the run that wrote them.
    where = {t: s for i, s in sorted(steps.items(), key=lambda x: int(x[0])) if "snapshot" in s for t in s["tables"]}
    where |= {t: record for t in record["tables"] if t not in where}

    def move(table: DataFrame, saved: dict) -> DataFrame:
        for c in set(path_columns) & set(table.columns):
            old_in, old_out = F.lit(saved["dataset_root"]), F.lit(saved["output_root"])
            path = F.col(c)
            table = table.withColumn(c, F.when(names.is_sub_path(path, old_out), names.rebased(path, old_out, F.lit(out_root))).otherwise(names.rebased(path, old_in, F.lit(in_root))))
        return table

    return {t: move(spark.read.parquet(f"{out_root}/{saved['snapshot']}/{t}"), saved) for t, saved in where.items()}
