"""Ranking of candidates by internal signals, and the choices that the workflow makes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrum.functions.profile import first_best

#: Signals of the combined score, and whether a larger value is better.
SIGNALS = {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True, "stab_mean": True}
CONSENSUS_PREFIX = "08_"


def z_score(name: str, higher_is_better: bool = True) -> Column:
    """Population z-score over the non-null values; null stays null, equal values give 0, lower-is-better is negated.

    The window spans the candidates, a table of a few rows.
    """
    whole = Window.partitionBy()
    x = F.col(name)
    std = F.stddev_pop(x).over(whole)
    z = F.when(x.isNull(), F.lit(None)).when(std == 0, F.lit(0.0)).otherwise((x - F.avg(x).over(whole)) / std)
    return z if higher_is_better else -z


def mean_of_present(columns: list[Column]) -> Column:
    """The mean of the non-null ones; null if all are."""
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))
    return F.when(n > 0, total / n)


def rank_candidates(master: DataFrame, signals: dict[str, bool] = SIGNALS) -> DataFrame:
    """master with z_<signal> and combined_score, the best first, null scores last."""
    out = master.withColumns({f"z_{c}": z_score(c, up) for c, up in signals.items()})
    out = out.withColumn("combined_score", mean_of_present([F.col(f"z_{c}") for c in signals]))
    return out.orderBy(F.col("combined_score").desc_nulls_last(), "notebook")


def pick_individual(ranked: DataFrame) -> DataFrame:
    """The best scored candidate that isn't a consensus; of equals the one of the least deviation."""
    own = ranked.where(~F.col("notebook").startswith(CONSENSUS_PREFIX) & F.col("algorithm").isNotNull())
    return own.orderBy(F.col("combined_score").desc_nulls_last(), F.col("stab_std").asc_nulls_last(), "notebook").limit(1)


def pick_consensus(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("notebook").startswith(CONSENSUS_PREFIX)).orderBy("notebook").limit(1)


def sort_by_metric(df: DataFrame, metric: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), tie)


def best_per_metric(df: DataFrame, key: str, metrics: dict[str, bool]) -> DataFrame:
    """metric, best: the key of the best value of each metric, the first key of equals."""
    found = [first_best(df, key, m, up).select(F.lit(m).alias("metric"), F.col(key).alias("best")) for m, up in metrics.items()]
    return reduce(DataFrame.unionByName, found)


def best_k(scan: DataFrame, metric: str = "silhouette", largest: bool = True) -> int:
    return first_best(scan, "k", metric, largest).first()["k"]


def pick_bic(curves: DataFrame) -> DataFrame:
    """covariance, k of (covariance, k, bic): the lowest BIC of all, the first of equals."""
    return curves.where("bic is not null").agg(F.min(F.struct("bic", "covariance", "k")).alias("b")).select("b.covariance", "b.k", "b.bic")


def pick_with_fallback(grid: DataFrame, key: str, metric: str, fallback: int) -> int:
    """The key of the largest metric; the fallback if no metric is known."""
    value = first_best(grid, key, metric).first()[key]
    return fallback if value is None else value


def alignment_gaps(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """side, key of the ids that one table has and the other lacks: empty if they hold the same ids."""
    left = a.select(key).exceptAll(b.select(key)).select(F.lit("left").alias("side"), key)
    return left.union(b.select(key).exceptAll(a.select(key)).select(F.lit("right").alias("side"), key))


def signal_curves(scan: DataFrame) -> DataFrame:
    """k, signal, value of a scan without nulls: what a chart of the signals draws."""
    names = [c for c in scan.columns if c != "k"]
    return scan.unpivot("k", names, "signal", "value").where("value is not null")


def cluster_scatter(embedding: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id, x, y, label, is_noise: the first two coordinates by label."""
    return embedding.join(labels, "row_id").select("row_id", F.col("z")[0].alias("x"), F.col("z")[1].alias("y"), "label", (F.col("label") == -1).alias("is_noise"))


def elbow(scan: DataFrame, metric: str) -> DataFrame:
    return scan.select("k", F.col(metric).alias("value")).orderBy("k")
