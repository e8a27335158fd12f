"""Readers, generators and configuration files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A decision table by its suffix; CSV has a header, and its types are inferred only if no schema is given."""
    kind = FORMATS.get(Path(str(path).rstrip("/")).suffix.lower())
    if kind is None:
        raise ValueError(f"no reader for {path}; known suffixes: {', '.join(FORMATS)}")
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    return (reader.option("header", True) if kind == "csv" else reader).load(str(path))


def load_yaml(path: str) -> dict:
    import yaml

    loaded = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} must hold a mapping")
    return loaded


def normalize_context(context: dict | None) -> dict[str, str]:
    """Flat audit context: scalar values as strings, empty ones left out."""
    out = {}
    for k, v in (context or {}).items():
        if isinstance(v, (dict, list, tuple)):
            raise ValueError(f"context value {k!r} must be a scalar")
        if v is not None and str(v).strip():
            out[str(k)] = str(v).strip()
    return out


def load_context(path: str | None) -> dict[str, str]:
    return normalize_context(load_yaml(path)) if path else {}


def load_report(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """A fleet of report documents as rows."""
    return spark.read.option("multiLine", True).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An evidence log in order of its sequence numbers."""
    return spark.read.json(path).orderBy("seq")


# Generators. A cell is a hash of (row, column, seed), so a table doesn't depend on partitioning.

DISPATCH = {"A": (0.5, 0.0), "B": (0.3, 0.25), "C": (0.2, 0.45)}
STAFFING = {"FT": (0.5, 0.0), "PT": (0.3, 0.25), "temp": (0.2, 0.45)}


def unit(name: str, seed: int) -> F.Column:
    """A uniform number in [0, 1) for each id, from 52 bits of a hash that other engines have too."""
    digest = F.md5(F.concat_ws(":", F.lit(name), F.lit(str(seed)), F.col("id").cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _checked(n: int, bias: float) -> None:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    if isinstance(bias, bool) or not 0.0 <= bias <= 1.0:
        raise ValueError("bias_strength must lie in 0..1")


def _grouped(spark: SparkSession, n: int, groups: dict, seed: int) -> DataFrame:
    rows, low = spark.range(n).withColumn("u", unit("group", seed)), 0.0
    label, penalty = None, None
    for name, (share, cost) in groups.items():
        low += share
        hit = F.col("u") < low
        label = F.when(hit, name) if label is None else label.when(hit, name)
        penalty = F.when(hit, cost) if penalty is None else penalty.when(hit, cost)
    last = list(groups)[-1]
    return rows.select("id", label.otherwise(last).alias("group"), penalty.otherwise(groups[last][1]).alias("penalty"))


def _chance(base: float, bias: float) -> F.Column:
    return F.least(F.greatest(F.lit(base) - F.lit(bias) * F.col("penalty"), F.lit(0.01)), F.lit(0.99))


def generate_dispatch(spark: SparkSession, n: int = 5000, bias_strength: float = 0.0, seed: int = 42) -> DataFrame:
    """driver_id, group, packages_assigned, priority_route (the decision), on_time (the outcome)."""
    _checked(n, bias_strength)
    rows = _grouped(spark, n, DISPATCH, seed)
    rows = rows.withColumn("packages_assigned", (F.lit(20) + F.floor(unit("packages", seed) * 100)).cast("int"))
    rows = rows.withColumn("priority_route", (unit("priority", seed) < _chance(0.55, bias_strength)).cast("int"))
    rows = rows.withColumn("on_time", (unit("on_time", seed) < 0.86 + 0.06 * F.col("priority_route")).cast("int"))
    return rows.select(F.format_string("DRV-%06d", "id").alias("driver_id"), "group", "packages_assigned", "priority_route", "on_time")


def generate_staffing(spark: SparkSession, n: int = 5000, bias_strength: float = 0.0, seed: int = 42) -> DataFrame:
    """worker_id, group, tenure_months, shifts_requested, shifts_granted (the decision), completed_satisfactorily (the outcome)."""
    _checked(n, bias_strength)
    rows = _grouped(spark, n, STAFFING, seed)
    rows = rows.withColumn("tenure_months", (F.lit(1) + F.floor(unit("tenure", seed) * 59)).cast("int"))
    rows = rows.withColumn("shifts_requested", (F.lit(1) + F.floor(unit("requested", seed) * 7)).cast("int"))
    rows = rows.withColumn("shifts_granted", (unit("granted", seed) < _chance(0.60, bias_strength)).cast("int"))
    rows = rows.withColumn("completed_satisfactorily", (unit("completed", seed) < 0.80 + 0.05 * F.col("tenure_months") / 60).cast("int"))
    return rows.select(F.format_string("WRK-%06d", "id").alias("worker_id"), "group", "tenure_months", "shifts_requested", "shifts_granted", "completed_satisfactorily")
