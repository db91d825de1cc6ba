"""Sinks: distributed tables by Spark's committer, small reports by an atomic rename on the driver."""

from __future__ import annotations

import json
import os
import platform
import tempfile
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(path: str | Path, text: str) -> None:
    """A small file on the driver, whole or not at all (K3)."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False) as f:
        f.write(text)
    os.replace(f.name, path)


def write_json(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(value, indent=2, default=lambda x: x.item() if hasattr(x, "item") else str(x)))


def ordered_columns(records: Sequence[Mapping[str, Any]]) -> list[str]:
    """Keys of all records in the order in which they are first seen (K3)."""
    return list(dict.fromkeys(k for r in records for k in r))


def write_manifest(df: DataFrame, path: str, report: DataFrame | None = None, csv: bool = False) -> None:
    """The manifest and, beside it, a one-row report as JSON (K1)."""
    (df.write.option("header", True).csv if csv else df.write.parquet)(f"{path}/manifest")
    if report is not None:
        report.coalesce(1).write.json(f"{path}/report")


def write_clean(df: DataFrame, path: str, report: DataFrame | None = None) -> None:
    """Included rows and quarantine, two folders of one partitioned write, so the plan runs once (K2)."""
    df.write.partitionBy("included").parquet(f"{path}/rows")
    if report is not None:
        report.coalesce(1).write.json(f"{path}/report")


def write_splits(df: DataFrame, path: str, provenance: Mapping[str, Any]) -> None:
    """New split files, sorted by id, never over old ones, with where they come from (K4). A large split is several files, one range of ids each."""
    (df.repartitionByRange("new_split", "id_code").sortWithinPartitions("new_split", "id_code").write.mode("errorifexists").partitionBy("new_split").option("header", True).csv(f"{path}/splits"))
    df.sparkSession.createDataFrame([(json.dumps(dict(provenance), sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/provenance")


def write_counts(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.option("header", True).csv(path)


def append_epoch(df: DataFrame, path: str) -> None:
    """One epoch's row; earlier ones stay as they are (K7)."""
    df.coalesce(1).write.mode("append").parquet(path)


def processed_cache(df: DataFrame, path: str, geometry: str) -> None:
    """Processed rows under their geometry's hash (K9)."""
    df.withColumn("preprocessing_hash", F.lit(geometry)).write.mode("append").partitionBy("preprocessing_hash").parquet(path)


def run_manifest(hashes: Mapping[str, str], seed: int) -> dict[str, Any]:
    """What a run was made with."""
    import pyspark

    return {"hashes": dict(hashes), "seed": seed, "python": platform.python_version(), "spark": pyspark.__version__, "platform": platform.platform()}


def report_json(df: DataFrame) -> DataFrame:
    """A table's rows as JSON documents."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
