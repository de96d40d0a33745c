"""The stream's model after restarts, replays and lost states."""

import glob
import os
import shutil

import numpy as np

from clustrum.streaming import minibatch


def test_restarts_and_replays(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2)) + np.repeat([[0, 0], [9, 9], [0, 9]], 30, 0)
    x = x[rng.permutation(90)]
    schema = "row_id long, features array<double>"
    parts = [spark.createDataFrame([(i, x[i].tolist()) for i in range(a, a + 30)], schema).coalesce(1) for a in (0, 30, 60)]
    once = minibatch.start_model(x[:3].tolist())
    for p in parts:
        once.update(p)
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")

    def run():
        model = minibatch.start_model(x[:3].tolist())
        minibatch.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), model, check).awaitTermination(120)
        return model

    sums = []
    for p in parts:  # each run is a new process's: nothing but the folders is kept
        p.write.mode("append").parquet(folder)
        sums.append(run().counts.sum())
    assert sums == [30, 60, 90]
    last = run()  # no new files
    assert np.allclose(last.centres, once.centres) and last.counts.tolist() == once.counts.tolist()
    # the driver was killed after the state, before Spark's commit: the batch comes again and is skipped
    for f in glob.glob(f"{check}/commits/*2") + glob.glob(f"{check}/commits/.*2.crc"):
        os.remove(f)
    again = run()
    assert np.allclose(again.centres, once.centres) and again.counts.sum() == 90
    # killed while the state was written: it isn't whole, and the batch counts once
    for f in glob.glob(f"{check}/commits/*2") + glob.glob(f"{check}/commits/.*2.crc") + glob.glob(f"{check}/model/batch-*2/_SUCCESS"):
        os.remove(f)
    again = run()
    assert np.allclose(again.centres, once.centres) and again.counts.sum() == 90
    assert len(minibatch.ModelState(spark, f"{check}/model").batches()) == minibatch.KEPT
    shutil.rmtree(tmp_path)
