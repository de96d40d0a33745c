"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode, a temporary folder that is set there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="clustrum-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back, so lineage ends there; files go with the session."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/clustrum/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a hint to broadcast it if it has so few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with 0, 1, .. in this order, without a task that holds all rows: ranges are sorted apart and counted, and the
    number of ranges, not of rows, meets on the driver."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(sorted_.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "numbered")
    sizes = {r["_range"]: (r["n"], r["first"]) for r in held.groupBy("_range").agg(F.count("*").alias("n"), F.min("_place").alias("first")).collect()}
    start, before = {}, 0
    for part in sorted(sizes):
        start[part] = before - sizes[part][1]
        before += sizes[part][0]
    if not start:
        return held.withColumn(name, F.col("_place")).drop("_range", "_place")
    shift = F.create_map(*(F.lit(x) for p, v in start.items() for x in (p, v)))
    return held.withColumn(name, F.col("_place") + F.element_at(shift, F.col("_range"))).drop("_range", "_place")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a Spark application, so that their Python finds it wherever it is installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="clustrum-")) / "clustrum_core.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
