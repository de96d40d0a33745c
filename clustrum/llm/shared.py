"""Folders and files that the driver and all executors share."""

from __future__ import annotations

import hashlib
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.functions import scratch
from clustrum.functions.scratch import scratch_root


def cut(df: DataFrame, name: str, schema=None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives executors.

    The files go when the session's JVM ends, or earlier by drop().
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/clustrum/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() returned and that no later step reads."""
    spark, path = df.sparkSession, df.scratch_path
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Rows in an Arrow batch between the JVM and Python, unless the session sets its own: whole texts are long.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a Spark application, so that their Python finds it anywhere."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    scratch.ship(spark)


_TABLES: dict[str, dict] = {}


def worker_tables(operator: str) -> dict:
    """What an operator keeps in a Python worker from task to task; the tables of other operators are given up, since
    Spark hands the same workers from stage to stage."""
    for other in [k for k in _TABLES if k != operator]:
        del _TABLES[other]
    return _TABLES.setdefault(operator, {})


def spare(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


class FileBytes:
    """A file of the driver as executors see it: its bytes, broadcast, under a digest."""

    def __init__(self, spark: SparkSession, path: str):
        raw = Path(path).read_bytes()
        self.digest = hashlib.sha256(raw).hexdigest()
        self.shared = spark.sparkContext.broadcast(raw)


def worker_model(operator: str, file: FileBytes, make):
    """make(bytes), once for each worker process and file."""
    kept = worker_tables(operator)
    if file.digest not in kept:
        kept[file.digest] = make(file.shared.value)
    return kept[file.digest]


def hash_place(key: str) -> Column:
    """A number below 2**30 that puts keys in a random order, the same in every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30))


def sample_bound(limit: int, total: int) -> int:
    """The place below which the first `limit` of `total` keys are for sure but for a chance of less than 10**-9: so few
    rows are left that sorting them needs no task with all rows."""
    return -(-(1 << 30) * min(total, 2 * limit + 200) // max(total, 1))


def first_by_hash(df: DataFrame, key: str, limit: int, total: int) -> DataFrame:
    """At most `limit` of the df's `total` rows, those whose keys come first in the random order."""
    return df.where(hash_place(key) < sample_bound(limit, total)).orderBy(hash_place(key), key).limit(limit)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths; bytes of like weight stand together and are compressed."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        parts += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little")]
    parts += [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    at, out = 1 + 12 * raw[0], []
    for i in range(raw[0]):
        head = raw[1 + 12 * i : 13 + 12 * i]
        dtype, n = np.dtype(head[:4].decode().strip()), int.from_bytes(head[4:], "little")
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out
