"""The workflow's steps as calls on tables: prepare, scan, sweep, embed, agree, rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.profile import label_summary
from clustrum.functions.scratch import cut
from clustrum.operators import density, dimred, gmm, hierarchical, kmeans, metrics, pairwise, select, stability
from clustrum.operators.preprocess import STRATEGIES, Preprocessor, Strategy
from clustrum.operators.schema import ColumnTypes, infer_column_types

#: The default grids and shares of the workflow.
MIN_CLUSTER_SIZES = (30, 50, 100, 200, 400)
LINKAGES = ("ward", "complete", "average")
LINKAGE_SHARE = 0.7
EMBEDDINGS = ((2, 15), (2, 30), (5, 30), (10, 30))


def _row(df: DataFrame, **extra) -> DataFrame:
    return df.select(*(F.lit(v).alias(k) for k, v in extra.items()), *df.columns)


def prepare(df: DataFrame, strategy: str | Strategy, id_column: str, types: ColumnTypes | None = None) -> DataFrame:
    """row_id, features of a table."""
    types = types or infer_column_types(df, (id_column,))
    plan = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    out = Preprocessor(types, plan).fit(df).transform(df, [id_column])
    return out.select(F.col(id_column).cast("long").alias("row_id"), "features")


def compare_strategies(df: DataFrame, id_column: str, k: int = 10, n_init: int = 10, strategies: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """strategy and the internal metrics of k-means on each preparation, the best silhouette first."""
    types = infer_column_types(df, (id_column,))
    rows = []
    for name in strategies:
        points = prepare(df, name, id_column, types).persist()
        rows.append(points.sparkSession.createDataFrame([(name, *metrics.internal_metrics(points, kmeans.kmeans(k, n_init)(points)).first())], "strategy string, silhouette double, davies_bouldin double, calinski_harabasz double, bic double").drop("bic"))
        points.unpersist()
    return select.sort_by_metric(reduce(DataFrame.unionByName, rows), "silhouette", "strategy")


def bic_curves(points: DataFrame, ks: list[int], covariances: tuple[str, ...] = ("full", "tied", "diag", "spherical"), n_init: int = 3) -> DataFrame:
    """covariance, k, bic."""
    rows = [(c, k, gmm.gmm_bic(c, n_init=n_init)(k, points)) for c in covariances for k in ks]
    return points.sparkSession.createDataFrame(rows, "covariance string, k int, bic double")


def density_sweep(points: DataFrame, sizes: tuple[int, ...] = MIN_CLUSTER_SIZES) -> DataFrame:
    """min_cluster_size, n_clusters, n_noise, noise_share and the metrics without noise, for each size."""
    rows = []
    for size in sizes:
        labels = density.hdbscan(size)(points).persist()
        rows.append(_row(label_summary(labels).drop("n_rows").join(metrics.internal_metrics(points, labels).drop("bic")), min_cluster_size=size))
    return reduce(DataFrame.unionByName, rows)


def pick_cluster_size(sweep: DataFrame, sizes: tuple[int, ...] = MIN_CLUSTER_SIZES) -> int:
    """The size of the largest silhouette, the first of the grid if none is known."""
    return select.pick_with_fallback(sweep, "min_cluster_size", "silhouette", sizes[0])


def density_labels(points: DataFrame, size: int, policy: str = "nearest", k: int = 5) -> DataFrame:
    """HDBSCAN labels with noise given to the nearest clusters, or made a cluster of its own, or kept."""
    labels = density.hdbscan(size)(points)
    if policy not in ("nearest", "own_cluster", "keep"):
        raise ValueError(f"unknown noise policy {policy!r}")
    return pairwise.assign_noise_to_nearest(points, labels, k) if policy == "nearest" else pairwise.noise_as_own_cluster(labels) if policy == "own_cluster" else labels


def linkage_scan(points: DataFrame, ks: list[int], linkages: tuple[str, ...] = LINKAGES, max_rows: int | None = 3000, n_iter: int = 0) -> DataFrame:
    """linkage, k and metrics (with stability if n_iter) on a sample, or on all rows if max_rows is None: one tree for each
    linkage serves every k, and one pass over the distances all label sets."""
    some = (points if max_rows is None else stability.sample_rows(points, max_rows)).persist()
    sets = {(linkage, k): cut(labels, "labels") for linkage in linkages for k, labels in hierarchical.agglomerative_cuts(some, ks, linkage, max_rows or hierarchical.TREE_ROWS).items()}
    scored = metrics.internal_metrics_of(some, list(sets.values()))
    rows = []
    for ((linkage, k), labels), own in zip(sets.items(), scored, strict=True):
        row = _row(own.drop("bic"), linkage=linkage, k=k)
        if n_iter:
            report = stability.stability(hierarchical.agglomerative(k, linkage), some, n_iter, LINKAGE_SHARE, reference=labels)
            row = row.withColumns({"stability_mean": F.lit(report.mean), "stability_std": F.lit(report.std)})
        rows.append(row)
    return reduce(DataFrame.unionByName, rows)


def pick_linkage(scan: DataFrame) -> DataFrame:
    """linkage, k of the largest silhouette; nulls are skipped, the first in order of linkage and k wins ties."""
    best = F.min(F.struct((-F.col("silhouette")).alias("s"), "linkage", "k")).alias("b")
    return scan.where("silhouette is not null").agg(best).select("b.linkage", "b.k")


def embed_and_cluster(points: DataFrame, k: int = 3, grid: tuple[tuple[int, int], ...] = EMBEDDINGS, max_rows: int = dimred.LAYOUT_ROWS, share: float = 0.95) -> DataFrame:
    """space, algorithm and metrics in each embedding's own space, the best silhouette first. The neighbours of the
    sample are found once, for the largest grid entry."""
    some = stability.sample_rows(points, max_rows).persist()
    pca = dimred.fit_pca(some)
    spaces = {"pca": dimred.as_points(pca.transform(some, dimred.components_for(some, share)))}
    if grid:
        near = pairwise.knn(some, some, max(n for _, n in grid) + 1).persist()
        spaces |= {f"umap_d{d}_nn{n}": dimred.as_points(dimred.umap(some, d, n, neighbours=near)) for d, n in grid}
    rows = []
    for space, own in spaces.items():
        own = own.persist()
        for name, model in (("KMeans", kmeans.kmeans(k, 10)), ("GMM_full", gmm.gmm(k, "full", 3))):
            rows.append(_row(metrics.internal_metrics(own, model(own)).drop("bic"), space=space, algorithm=name))
    return select.sort_by_metric(reduce(DataFrame.unionByName, rows), "silhouette", "space")


def agree(points: DataFrame, label_sets: list[DataFrame], k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(consensus labels of all rows, their metrics, agreement without each set)."""
    k = k or hierarchical.consensus_k(label_sets)
    labels = hierarchical.consensus(label_sets, k)
    return labels, metrics.internal_metrics(points, labels), hierarchical.leave_one_out(label_sets, k)


def final_selection(master: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked candidates, the individual choice, the consensus choice)."""
    ranked = select.rank_candidates(master)
    return ranked, select.pick_individual(ranked), select.pick_consensus(ranked)
