"""Sources: tables, label sets and run documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.operators.select import alignment_gaps

#: The nested fields of a run document that the comparison reads.
RUN_SCHEMA = """notebook string, preprocess_strategy string, labels_path string, timestamp string,
best_model struct<algorithm: string, params: map<string, string>,
  internal_metrics: struct<silhouette: double, davies_bouldin: double, calinski_harabasz: double, bic: double>,
  stability: struct<mean_ari: double, std_ari: double, n_iter: int, sample_frac: double, per_iter: array<double>>>"""


def _exists(spark: SparkSession, path: str) -> bool:
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(handle) is not None and bool(len(handle.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(handle)))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet, CSV (with header), JSON or ORC table by its ending, or a folder of Parquet files."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} isn't there; put the table there or pass another path")
    kind = next((k for k in ("csv", "json", "orc") if path.endswith(f".{k}")), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return (reader if schema else reader.option("inferSchema", True)).option("header", True).csv(path)
    return getattr(reader, kind)(path)


def read_raw(spark: SparkSession, folder: str = "data/raw") -> DataFrame:
    return read_table(spark, os.path.join(folder, "data.csv"))


def read_template(spark: SparkSession, folder: str = "data/raw") -> DataFrame:
    return read_table(spark, os.path.join(folder, "sample_submission.csv"))


def read_labels(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """A label set (row_id, label); with ids it must hold exactly those rows."""
    labels = read_table(spark, path).select(F.col("row_id").cast("long"), F.col("label").cast("int"))
    if ids is not None and alignment_gaps(labels, ids).limit(1).count():
        raise ValueError(f"{path} doesn't hold the rows that are wanted")
    return labels


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison table of all <folder>/*/result.json; fields that a run lacks are null."""
    runs = spark.read.option("multiLine", True).schema(RUN_SCHEMA).json(f"{folder.rstrip('/')}/*/result.json")
    m, s = F.col("best_model.internal_metrics"), F.col("best_model.stability")
    return runs.select(
        "notebook", F.col("best_model.algorithm").alias("algorithm"), F.col("preprocess_strategy").alias("preprocess"), m["silhouette"].alias("silhouette"), m["davies_bouldin"].alias("davies_bouldin"),
        m["calinski_harabasz"].alias("calinski_harabasz"), m["bic"].alias("bic"), s["mean_ari"].alias("stab_mean"), s["std_ari"].alias("stab_std"), "labels_path",
    ).orderBy("notebook")


def setting(name: str, default, kind=str, environment=os.environ):
    """A run-bounding setting from the environment, or its default; a list is cut at commas."""
    value = environment.get(name)
    return default if value is None else [kind(v) for v in value.split(",")] if isinstance(default, list) else kind(value)
