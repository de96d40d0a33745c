"""Sinks: submissions, label sets, comparison tables and run documents."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, is_dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.operators.select import alignment_gaps


def submission(ids: DataFrame, labels: DataFrame, id_column: str = "Id") -> DataFrame:
    """Id, Predicted, joined by id; the two must hold the same rows."""
    keyed = ids.select(F.col(id_column).cast("long").alias("row_id"))
    if alignment_gaps(keyed, labels.select(F.col("row_id").cast("long").alias("row_id"))).limit(1).count():
        raise ValueError("ids and labels hold different rows")
    return keyed.join(labels, "row_id").select(F.col("row_id").alias("Id"), F.col("label").cast("int").alias("Predicted"))


def write_submission(ids: DataFrame, labels: DataFrame, path: str, id_column: str = "Id") -> None:
    """One CSV file with a header, in the order of the ids."""
    submission(ids, labels, id_column).orderBy("Id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select(F.col("row_id").cast("long"), F.col("label").cast("int")).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A small table, such as a scan or a comparison, as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_jsonable(value: Any) -> Any:
    """Plain JSON values: records as objects, keys as strings, arrays as lists, numbers that aren't finite as null."""
    if is_dataclass(value) and not isinstance(value, type):
        return to_jsonable(asdict(value))
    if isinstance(value, dict):
        return {str(k): to_jsonable(v) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return to_jsonable(value.tolist())
    if isinstance(value, list | tuple | set):
        return [to_jsonable(v) for v in value]
    if isinstance(value, np.generic):
        return to_jsonable(value.item())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return str(value) if isinstance(value, Path) else value


def write_result(folder: str | Path, payload: dict, filename: str = "result.json", add_timestamp: bool = True) -> str:
    """The run document, with the UTC time in seconds unless it has one; keys keep their order. Returns where it is.

    With a session the folder may be in any file system that Spark reads; without one it is the driver's.
    """
    document = dict(payload)
    if add_timestamp and "timestamp" not in document:
        document["timestamp"] = datetime.now(UTC).isoformat(timespec="seconds")
    text, target = json.dumps(to_jsonable(document), indent=2), f"{str(folder).rstrip('/')}/{filename}"
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        Path(target).write_text(text)
        return target
    handle = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = handle.getFileSystem(spark._jsc.hadoopConfiguration()).create(handle, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return target


def jsonable_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON document, numbers that aren't finite as null."""
    from clustrum.functions.profile import finite

    fields = [finite(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))
