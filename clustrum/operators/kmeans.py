"""Centroid clusterers: k-means with restarts, a deterministic Lloyd iteration in DataFrame operations, mini-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.scratch import ship

from .stability import FitPredict, sample_rows

MAX_ITER, TOL = 300, 1e-4


def kmeans(n_clusters: int, n_init: int = 20, seed: int = 42, max_iter: int = MAX_ITER) -> FitPredict:
    """Best of n_init runs by the sum of squared distances."""

    def fit_predict(points: DataFrame) -> DataFrame:
        rows = points.select("row_id", array_to_vector("features").alias("features")).persist()
        best = None
        for i in range(n_init):
            model = KMeans(k=n_clusters, seed=seed + i, maxIter=max_iter, tol=TOL).fit(rows)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        out = best.transform(rows).select("row_id", F.col("prediction").cast("int").alias("label"))
        rows.unpersist()
        return out

    return fit_predict


def assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """row_id, label (the first of equally near centres), dist2."""
    ship(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for frame in frames:
            if len(frame):
                x = np.stack(frame["features"].to_numpy())
                d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2) if x.size * len(c) <= 20_000_000 else (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
                label = d.argmin(1)
                yield pd.DataFrame({"row_id": frame["row_id"], "label": label.astype(np.int32), "dist2": d[np.arange(len(d)), label]})

    return points.select("row_id", "features").mapInPandas(near, "row_id long, label int, dist2 double")


def lloyd(points: DataFrame, initial: DataFrame, iterations: int) -> tuple[DataFrame, DataFrame]:
    """(labels, centres) after fixed iterations from given centres (label, centre), in DataFrame operations alone.

    Each iteration broadcasts the k centres and sends one partial sum for each (task, label, axis); an empty cluster
    keeps its centre.
    """
    centres = initial.select("label", "centre")
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)

    def nearest(centres: DataFrame) -> DataFrame:
        table = [(r["label"], list(r["centre"])) for r in centres.orderBy("label").collect()]
        options = F.array(*(F.struct(square(F.col("features"), F.array(*map(F.lit, c))).alias("d"), F.lit(label).alias("label")) for label, c in table))
        return points.select("row_id", "features", F.array_min(options)["label"].alias("label"))

    for _ in range(iterations):
        axes = nearest(centres).select("label", F.posexplode("features").alias("axis", "x")).groupBy("label", "axis").agg(F.avg("x").alias("m"))
        moved = axes.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "m"))), lambda e: e["m"]).alias("moved"))
        centres = centres.join(moved, "label", "left").select("label", F.coalesce("moved", "centre").alias("centre"))
        centres = points.sparkSession.createDataFrame(centres.orderBy("label").collect(), "label int, centre array<double>")
    return nearest(centres).select("row_id", "label"), centres


class MiniBatch:
    """Centres that follow batches: each centre moves to the mean of all rows that it ever had."""

    def __init__(self, centres: np.ndarray, counts: np.ndarray | None = None):
        self.centres = np.array(centres, float)
        self.counts = np.zeros(len(self.centres)) if counts is None else np.array(counts, float)

    def update(self, batch: DataFrame) -> None:
        """One step on a batch (features): rows are summed by centre where they are; only k sums reach the driver."""
        ship(batch.sparkSession)
        shared = batch.sparkSession.sparkContext.broadcast(self.centres)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["features"].to_numpy())
                    near = ((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T).argmin(1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"label": np.arange(len(c), dtype=np.int32), "n": n, "total": list(total)})

        parts = batch.select("features").mapInPandas(sums, "label int, n long, total array<double>").where("n > 0")
        axes = parts.select("label", "n", F.posexplode("total").alias("axis", "x")).groupBy("label", "axis").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
        for label, own in axes.groupby("label"):
            n = float(own["n"].iloc[0])
            x = own.sort_values("axis")["x"].to_numpy()
            self.counts[label] += n
            self.centres[label] += (x - n * self.centres[label]) / self.counts[label]

    def predict(self, points: DataFrame) -> DataFrame:
        return assign(points, self.centres).select("row_id", "label")


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds of a bounded sample."""
    out = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = ((x[:, None, :] - np.array(out)[None, :, :]) ** 2).sum(2).min(1)
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(out)


def lloyd_numpy(x: np.ndarray, k: int, n_init: int, rng: np.random.Generator, iterations: int = MAX_ITER) -> np.ndarray:
    """Labels of a bounded sample by k-means with restarts."""
    best, label = np.inf, np.zeros(len(x), int)
    for _ in range(n_init):
        c = plus_plus(x, k, rng)
        for _ in range(iterations):
            d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
            near = d.argmin(1)
            moved = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            if np.allclose(moved, c, atol=1e-8):
                break
            c = moved
        cost = d[np.arange(len(x)), near].sum()
        if cost < best - 1e-12:
            best, label = cost, near
    return label


def minibatch_kmeans(n_clusters: int, batch_size: int = 4096, n_init: int = 10, seed: int = 42, batches: int = 20) -> FitPredict:
    """Mini-batch k-means: the best of n_init seedings on one batch, then steps on further batches.

    Rows are dealt to batches once, in the order of a hash: a batch is a slice of the hash's range, so none is sorted.
    """

    def fit_predict(points: DataFrame) -> DataFrame:
        first = np.array([r["features"] for r in sample_rows(points, batch_size, seed).orderBy("row_id").select("features").collect()], float)
        rng = np.random.default_rng(seed)
        tried = [plus_plus(first, n_clusters, rng) for _ in range(n_init)]
        cost = [((first[:, None, :] - c[None]) ** 2).sum(2).min(1).sum() for c in tried]
        model = MiniBatch(tried[int(np.argmin(cost))])
        n = points.count()
        share, place = min(1.0, batch_size / max(n, 1)), F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        dealt = points.withColumn("place", place)
        for i in range(batches):
            low = i * share % 1.0
            # a slice that passes the end goes on at the beginning
            inside = ((F.col("place") >= low) & (F.col("place") < low + share)) | (F.col("place") < low + share - 1.0)
            model.update(dealt.where(inside))
        return model.predict(points)

    return fit_predict
