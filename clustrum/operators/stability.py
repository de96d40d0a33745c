"""Sampling, stability under repeated subsampling, and scans over the number of clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.functions.scratch import cut

from .metrics import adjusted_rand, internal_metrics_of

#: (row_id, features) -> (row_id, label)
FitPredict = Callable[[DataFrame], DataFrame]
ModelFactory = Callable[[int], FitPredict]
BicFunction = Callable[[int, DataFrame], float]


#: Digits of a place in the random order that a counting pass tells apart, and keys that are read at last.
DIGIT_BITS, READ_KEYS = 12, 20_000


def sample_key(seed: int, key: str = "row_id") -> Column:
    """A number below 2**32 that orders ids at random by seed; for ids below 2**32 it is (id * 2654435761 + seed * 40503)
    modulo 2**32. Ids of all 64 bits are multiplied in halves of 16 bits, which can't overflow."""
    x = F.col(key).cast("long")
    part = lambda shift, by: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(0xFFFF)) * F.lit(by)
    low = part(0, 2654435761) + part(16, 2654435761).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    high = part(32, 2246822519) + part(48, 3266489917)
    return F.pmod(low + high + F.lit(seed * 40503), F.lit(4294967296))


def _thresholds(df: DataFrame, sizes: dict[int, int], key: str) -> dict[int, tuple[int, int]]:
    """For each seed the (sample key, id) of the last row that its sample takes, for seeds that don't take all rows.

    A place is a number of 96 bits, the sample key before the id. Each pass counts one digit of the places that begin as
    the threshold does, for all seeds; when few such places are left they are read. So no task and no driver holds rows
    in the number of the sample, and equal keys are told apart by their ids.
    """
    seeds, ids = list(sizes), F.col(key).cast("long")
    unsigned = ids.bitwiseXOR(F.lit(-(1 << 63)))
    keys = df.select(F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), sample_key(s, key).alias("a")) for s in seeds))).alias("s"), unsigned.alias("u")).select("s.seed", "s.a", "u")
    # digits from the left: (column, bits to its right); the ids' sign bit is flipped, so they order without sign
    steps = [(c, max(0, width - DIGIT_BITS * (i + 1)), min(DIGIT_BITS, width - DIGIT_BITS * i)) for c, width in (("a", 32), ("u", 64)) for i in range(-(-width // DIGIT_BITS))]
    begin: dict[int, list[tuple[str, int, int, int]]] = {s: [] for s in seeds}
    want, done = dict(sizes), {}
    for c, shift, bits in steps:
        left = [s for s in seeds if s not in done]
        if not left:
            break
        digit = lambda c, shift, bits: F.shiftrightunsigned(F.col(c), shift).bitwiseAND(F.lit((1 << bits) - 1))
        inside = reduce(lambda a, b: a | b, (reduce(lambda a, d: a & (digit(*d[:3]) == d[3]), begin[s], F.col("seed") == s) for s in left))
        counts: dict[int, dict[int, int]] = {s: {} for s in left}
        for r in keys.where(inside).groupBy("seed", digit(c, shift, bits).alias("d")).count().collect():
            counts[r["seed"]][r["d"]] = r["count"]
        read = []
        for s in left:
            for d in sorted(counts[s]):
                if want[s] <= counts[s][d]:
                    begin[s].append((c, shift, bits, d))
                    if counts[s][d] <= READ_KEYS // len(left):
                        read.append(s)
                    break
                want[s] -= counts[s][d]
        if read:
            inside = reduce(lambda a, b: a | b, (reduce(lambda a, d: a & (digit(*d[:3]) == d[3]), begin[s], F.col("seed") == s) for s in read))
            found: dict[int, list[tuple[int, int]]] = {s: [] for s in read}
            for r in keys.where(inside).collect():
                found[r["seed"]].append((r["a"], r["u"] ^ -(1 << 63)))
            for s in read:
                done[s] = sorted(found[s])[want[s] - 1]
    for s in seeds:
        if s not in done:  # rows that repeat one id
            a = sum(d << shift for c, shift, _, d in begin[s] if c == "a")
            u = sum(d << shift for c, shift, _, d in begin[s] if c == "u")
            done[s] = (a, u - (1 << 63))
    return done


def sample_seeds(df: DataFrame, n: int, seeds: list[int], key: str = "row_id", total: int | None = None) -> list[DataFrame]:
    """sample_rows() for each seed, with the counting shared among them."""
    total = df.count() if total is None else total
    if total <= n:
        return [df for _ in seeds]
    if n <= 0:
        return [df.limit(0) for _ in seeds]
    last = _thresholds(df, dict.fromkeys(seeds, n), key)
    x = F.col(key).cast("long")
    return [df.where((sample_key(s, key) < last[s][0]) | ((sample_key(s, key) == last[s][0]) & (x <= last[s][1]))) for s in seeds]


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Exactly n rows without replacement (all, if fewer): those that the seed puts first, ties to the smaller id.

    Ids are 64-bit integers without nulls; rows that repeat the last id that is taken are all taken. The sample is a filter
    by a threshold that counting finds: rows are never sorted or gathered.
    """
    return sample_seeds(df, n, [seed], key)[0]


def sample_size(n: int, share: float) -> int:
    """At least two rows; halves go to the even number."""
    return max(2, round(share * n))


@dataclass(frozen=True)
class StabilityReport:
    mean: float
    std: float
    n_iter: int
    sample_frac: float
    per_iter: list[float] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)


def stability(fit_predict: FitPredict, points: DataFrame, n_iter: int = 20, sample_frac: float = 0.8, seed: int = 42, reference: DataFrame | None = None) -> StabilityReport:
    """How alike a clustering stays when it is fitted again on subsamples: adjusted Rand indices against all rows' labels.

    The reference labels are fitted once, or passed on by a scan that has them.
    """
    reference = (fit_predict(points) if reference is None else reference).persist()
    total = reference.count()
    samples = sample_seeds(points, sample_size(total, sample_frac), [seed + i for i in range(n_iter)], total=total)
    runs = [adjusted_rand(fit_predict(some), reference).withColumn("i", F.lit(i)) for i, some in enumerate(samples)]
    found = [r["ari"] for r in reduce(DataFrame.unionByName, runs).orderBy("i").collect()]
    reference.unpersist()
    return StabilityReport(float(np.mean(found)), float(np.std(found)), n_iter, sample_frac, found)


def scan_clusters(
    factory: ModelFactory, points: DataFrame, ks: list[int], n_iter: int = 10, sample_frac: float = 0.8, seed: int = 42, bic: BicFunction | None = None
) -> DataFrame:
    """k, silhouette, davies_bouldin, calinski_harabasz, bic, stability_mean, stability_std for each k.

    Each k is fitted once on all rows; its metrics and its stability share those labels, every k the subsamples, and one pass
    over the distances serves the metrics of all.
    """
    models = {k: factory(k) for k in ks}
    sets = {k: cut(fit_predict(points), "labels") for k, fit_predict in models.items()}
    rows = []
    for k, scored in zip(sets, internal_metrics_of(points, list(sets.values())), strict=True):
        report = stability(models[k], points, n_iter, sample_frac, seed, sets[k])
        value = scored.first().asDict()
        rows.append((k, *(value[c] for c in ("silhouette", "davies_bouldin", "calinski_harabasz")), bic(k, points) if bic else None, report.mean, report.std))
    return points.sparkSession.createDataFrame(
        rows, "k int, silhouette double, davies_bouldin double, calinski_harabasz double, bic double, stability_mean double, stability_std double"
    )
