"""Mini-batch k-means on a stream: each micro-batch moves the centres once, whatever is restarted or comes again.

The model's state after a batch, its centres and their counts, is a small Parquet folder named by the batch's id beside
the query's checkpoint. A query that starts again goes on from the last whole state, and a batch that is not newer than
it is skipped; a batch whose state was not written is one that Spark sends again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from clustrum.operators.kmeans import MiniBatch

#: States that are kept: the last one, and one before it.
KEPT = 2


class ModelState:
    """States of a model in a folder that every driver of the query can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The ids of the batches whose state is whole, in order."""
        if not self._files.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and self._files.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def save(self, model: MiniBatch, batch_id: int) -> None:
        rows = [(i, c.tolist(), float(n)) for i, (c, n) in enumerate(zip(model.centres, model.counts, strict=True))]
        self.spark.createDataFrame(rows, "label int, centre array<double>, n double").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id:012d}")
        for old in self.batches()[:-KEPT]:
            self._files.delete(self._path(f"{self.folder}/batch-{old:012d}"), True)

    def load(self, model: MiniBatch) -> int:
        """Put the last whole state into the model; its batch's id, -1 if there is none."""
        known = self.batches()
        if not known:
            return -1
        rows = self.spark.read.parquet(f"{self.folder}/batch-{known[-1]:012d}").orderBy("label").collect()
        model.centres, model.counts = np.array([r["centre"] for r in rows], float), np.array([r["n"] for r in rows]).astype(model.counts.dtype)
        return known[-1]


def follow(stream: DataFrame, model: MiniBatch, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the query that updates model with every micro-batch of `features`, each once.

    The state is kept in the checkpoint's subfolder `model`; if one is there, it replaces what the model holds.
    """
    state = ModelState(stream.sparkSession, f"{checkpoint.rstrip('/')}/model")
    last = state.load(model)

    def step(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        if batch_id <= last:
            return
        if not batch.isEmpty():
            model.update(batch)
        state.save(model, batch_id)
        last = batch_id

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_model(centres: list[list[float]]) -> MiniBatch:
    return MiniBatch(np.array(centres, float))
