"""Spectral clustering on a neighbour graph or a radial kernel."""

from __future__ import annotations

from typing import Literal

import numpy as np
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hierarchical import _frame, _gather
from .kmeans import lloyd_numpy
from .pairwise import distances, knn, propagate
from .stability import FitPredict, sample_rows

#: Rows from which a radial kernel is fitted on a sample, and that sample's rows.
RBF_MAX_ROWS, SUBSAMPLE_ROWS = 20_000, 10_000
#: Rows whose graph is decomposed at once; more are sampled.
GRAPH_ROWS = 5_000


def _embed(a: np.ndarray, k: int) -> np.ndarray:
    degree = np.maximum(a.sum(1), 1e-12)
    root = 1 / np.sqrt(degree)
    value, vector = np.linalg.eigh(np.eye(len(a)) - root[:, None] * a * root[None, :])
    z = vector[:, :k] * root[:, None]
    return z * np.where(z[np.abs(z).argmax(0), np.arange(k)] < 0, -1, 1)


def spectral(
    n_clusters: int, affinity: Literal["nearest_neighbors", "rbf"] = "nearest_neighbors", n_neighbors: int = 10, seed: int = 42, gamma: float = 1.0,
    rbf_max_rows: int = RBF_MAX_ROWS, subsample_size: int = SUBSAMPLE_ROWS, graph_rows: int = GRAPH_ROWS, vote_k: int = 5,
) -> FitPredict:
    """k-means on the first eigenvectors of the normalised Laplacian. Tables of more rows than can be decomposed are
    fitted on a sample, whose labels the others take by the vote of their nearest sampled rows."""
    if affinity not in ("nearest_neighbors", "rbf"):
        raise ValueError(f"unknown affinity {affinity!r}")

    def fit_predict(points: DataFrame) -> DataFrame:
        n = points.count()
        limit = min(graph_rows, subsample_size if affinity == "rbf" and n > rbf_max_rows else n)
        some = sample_rows(points, limit, seed) if n > limit else points
        ids, x = _gather(some)
        if affinity == "rbf":
            a = np.exp(-gamma * distances(x, x, np.eye(len(x), dtype=bool)) ** 2)
        else:
            near = knn(some, some, min(n_neighbors, len(ids))).select("row_id", "nbr_id").toPandas()
            c = np.zeros((len(ids), len(ids)))
            c[np.searchsorted(ids, near["row_id"]), np.searchsorted(ids, near["nbr_id"])] = 1
            a = (c + c.T) / 2
        label = lloyd_numpy(_embed(a, n_clusters), n_clusters, 10, np.random.default_rng(seed))
        own = _frame(points, ids, label)
        return own if n <= limit else propagate(points, some, own, vote_k)

    return fit_predict


def power_iteration(n_clusters: int, n_neighbors: int = 10, max_iter: int = 20) -> FitPredict:
    """The distributed approximation for tables of any size: power iteration on the neighbour graph of all rows."""

    def fit_predict(points: DataFrame) -> DataFrame:
        near = knn(points, points, n_neighbors, exclude_self=True)
        edges = near.select(F.least("row_id", "nbr_id").alias("src"), F.greatest("row_id", "nbr_id").alias("dst")).groupBy("src", "dst").agg((F.count("*") / 2).alias("weight"))
        model = PowerIterationClustering(k=n_clusters, maxIter=max_iter, srcCol="src", dstCol="dst", weightCol="weight")
        return model.assignClusters(edges).select(F.col("id").alias("row_id"), F.col("cluster").cast("int").alias("label"))

    return fit_predict
