"""Gaussian mixtures by expectation maximisation, and a Dirichlet-process mixture by variational inference.

Every iteration is one pass: partitions turn their rows into responsibilities and send sufficient statistics, a few
numbers for each component; the driver does the maximisation. Data are centred first, for the sums' sake.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.scratch import ship

from .kmeans import lloyd_numpy
from .stability import BicFunction, FitPredict, sample_rows

Covariance = Literal["full", "tied", "diag", "spherical"]
#: Rows of the sample that responsibilities start from.
START_ROWS = 10_000
TOL = 1e-3


@dataclass
class Mixture:
    """log N(x) = const - |P'(x - mean)|^2 / 2 with triangular P of each component; log_weight adds its prior."""

    offset: np.ndarray
    means: np.ndarray
    precision: np.ndarray
    log_weight: np.ndarray
    log_const: np.ndarray
    log_likelihood: float = -np.inf
    lower_bound: float = -np.inf

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        x = x - self.offset
        out = np.empty((len(x), len(self.means)))
        for j, (m, p) in enumerate(zip(self.means, self.precision, strict=True)):
            z = (x - m) @ p
            out[:, j] = self.log_weight[j] + self.log_const[j] - 0.5 * (z * z).sum(1)
        return out


def _logsumexp(a: np.ndarray) -> np.ndarray:
    top = a.max(1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(1, keepdims=True)))[:, 0]


def _statistics(points: DataFrame, mixture: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Sums of responsibilities, of responsibility x row and of its square, the log-likelihood and n."""
    ship(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(mixture)
    d = mixture.means.shape[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.means)
        n, s, q, ll, rows = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0, 0
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["features"].to_numpy())
            joint = m.log_joint(x)
            norm = _logsumexp(joint)
            r = np.exp(joint - norm[:, None])
            x = x - m.offset
            n += r.sum(0)
            s += r.T @ x
            for j in range(k):
                q[j] += (x * r[:, j : j + 1]).T @ x
            ll += float(norm.sum())
            rows += len(x)
        yield pd.DataFrame({"j": range(k), "n": n, "stats": [np.concatenate((s[j], q[j].ravel())) for j in range(k)], "ll": [ll] + [0.0] * (k - 1), "rows": [rows] + [0] * (k - 1)})

    parts = points.select("features").mapInPandas(run, "j int, n double, stats array<double>, ll double, rows long")
    sums = parts.select("j", F.posexplode("stats").alias("i", "v")).groupBy("j", "i").agg(F.sum("v").alias("v"))
    flat = sums.groupBy("j").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("stats"))
    whole = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum("ll").alias("ll"), F.sum("rows").alias("rows")).join(flat, "j").orderBy("j").collect()
    stats = np.array([r["stats"] for r in whole])
    return np.array([r["n"] for r in whole]), stats[:, :d], stats[:, d:].reshape(-1, d, d), sum(r["ll"] for r in whole), sum(r["rows"] for r in whole)


def _covariances(n: np.ndarray, s: np.ndarray, q: np.ndarray, kind: Covariance, reg: float) -> tuple[np.ndarray, np.ndarray]:
    weight = np.maximum(n, 10 * np.finfo(float).eps)
    means = s / weight[:, None]
    full = q / weight[:, None, None] - means[:, :, None] * means[:, None, :]
    eye = np.eye(means.shape[1])
    if kind == "tied":
        full = np.repeat(((full * n[:, None, None]).sum(0) / n.sum())[None], len(n), 0)
    elif kind == "diag":
        full = full * eye
    elif kind == "spherical":
        full = np.einsum("kii->k", full)[:, None, None] / len(eye) * eye
    return means, full + reg * eye


def _mixture(offset: np.ndarray, n: np.ndarray, means: np.ndarray, cov: np.ndarray) -> Mixture:
    d = means.shape[1]
    chol = np.linalg.cholesky(cov)
    precision = np.array([np.linalg.solve(c, np.eye(d)).T for c in chol])
    const = -0.5 * d * np.log(2 * np.pi) - np.log(np.einsum("kii->ki", chol)).sum(1)
    return Mixture(offset, means, precision, np.log(np.maximum(n, 1e-300) / n.sum()), const)


def _start(points: DataFrame, k: int, rng: np.random.Generator, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.array([r["features"] for r in sample_rows(points, START_ROWS, seed).orderBy("row_id").collect()], float)
    axes = points.select(F.posexplode("features").alias("axis", "x")).groupBy("axis").agg(F.avg("x").alias("m")).orderBy("axis").collect()
    offset = np.array([r["m"] for r in axes])
    x = x - offset
    label = lloyd_numpy(x, min(k, len(x)), 1, rng, 50)
    n = np.bincount(label, minlength=k).astype(float)
    s = np.array([x[label == j].sum(0) for j in range(k)])
    q = np.array([x[label == j].T @ x[label == j] for j in range(k)])
    return offset, n, s, q


def fit_gmm(points: DataFrame, k: int, covariance: Covariance = "full", n_init: int = 5, reg: float = 1e-6, max_iter: int = 200, seed: int = 42) -> tuple[Mixture, int, int]:
    """(the best of n_init mixtures, rows, iterations of its run)."""
    if covariance not in ("full", "tied", "diag", "spherical"):
        raise ValueError(f"unknown covariance {covariance!r}")
    points = points.select("row_id", "features").persist()
    best, n_rows, steps = None, 0, 0
    for i in range(n_init):
        rng = np.random.default_rng(seed + i)
        offset, n, s, q = _start(points, k, rng, seed + i)
        model, last = _mixture(offset, n, *_covariances(n, s, q, covariance, reg)), -np.inf
        for step in range(1, max_iter + 1):
            n, s, q, ll, n_rows = _statistics(points, model)
            model.log_likelihood = ll
            if abs(ll / n_rows - last) < TOL:
                break
            last = ll / n_rows
            model = _mixture(offset, n, *_covariances(n, s, q, covariance, reg))
        else:
            model.log_likelihood = _statistics(points, model)[3]
        if best is None or model.log_likelihood > best.log_likelihood:
            best, steps = model, step
    points.unpersist()
    return best, n_rows, steps


def predict(points: DataFrame, mixture: Mixture) -> DataFrame:
    """row_id, label: the component of the largest posterior."""
    ship(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(mixture)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"row_id": frame["row_id"], "label": shared.value.log_joint(np.stack(frame["features"].to_numpy())).argmax(1).astype(np.int32)})

    return points.select("row_id", "features").mapInPandas(run, "row_id long, label int")


def n_parameters(k: int, d: int, covariance: Covariance) -> int:
    own = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[covariance]
    return own + k * d + k - 1


def bic(mixture: Mixture, n_rows: int, covariance: Covariance) -> float:
    k, d = mixture.means.shape
    return -2 * mixture.log_likelihood + n_parameters(k, d, covariance) * float(np.log(n_rows))


def gmm(n_components: int, covariance: Covariance = "full", n_init: int = 5, reg: float = 1e-6, max_iter: int = 200, seed: int = 42) -> FitPredict:
    return lambda points: predict(points, fit_gmm(points, n_components, covariance, n_init, reg, max_iter, seed)[0])


def gmm_bic(covariance: Covariance = "full", n_init: int = 5, reg: float = 1e-6, max_iter: int = 200, seed: int = 42) -> BicFunction:
    def value(k: int, points: DataFrame) -> float:
        mixture, n, _ = fit_gmm(points, k, covariance, n_init, reg, max_iter, seed)
        return bic(mixture, n, covariance)

    return value


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        shift[small] -= 1 / x[small]
        x[small] += 1
    return shift + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def fit_bayesian(points: DataFrame, k: int = 30, prior: float = 1e-2, reg: float = 1e-6, max_iter: int = 500, seed: int = 42) -> Mixture:
    """A full-covariance mixture with a Dirichlet-process prior on the weights, by mean-field updates."""
    points = points.select("row_id", "features").persist()
    rng = np.random.default_rng(seed)
    offset, n, s, q = _start(points, k, rng, seed)
    d = s.shape[1]
    flat = Mixture(offset, np.zeros((1, d)), np.eye(d)[None], np.zeros(1), np.zeros(1))
    n1, s1, q1, _, rows = _statistics(points, flat)
    mean0, cov0 = s1[0] / n1[0], q1[0] / n1[0] - np.outer(s1[0] / n1[0], s1[0] / n1[0]) + reg * np.eye(d)
    model, last = None, None
    for _ in range(max_iter):
        weight = n + 10 * np.finfo(float).eps
        mean = s / weight[:, None]
        scatter = q / weight[:, None, None] - mean[:, :, None] * mean[:, None, :] + reg * np.eye(d)
        rest = np.concatenate((np.cumsum(n[::-1])[-2::-1], [0.0]))
        g1, g2 = 1 + n, prior + rest
        stick = digamma(g1) - digamma(g1 + g2)
        left = np.concatenate(([0.0], np.cumsum(digamma(g2) - digamma(g1 + g2))[:-1]))
        beta, nu = 1 + n, d + n
        m = (mean0 + n[:, None] * mean) / beta[:, None]
        gap = mean - mean0
        inverse = cov0 + n[:, None, None] * scatter + (n / beta)[:, None, None] * gap[:, :, None] * gap[:, None, :]
        chol = np.linalg.cholesky(inverse)
        scale = np.array([np.linalg.solve(c, np.eye(d)).T for c in chol])
        log_det = digamma((nu[:, None] + 1 - np.arange(1, d + 1)) / 2).sum(1) + d * np.log(2) - 2 * np.log(np.einsum("kii->ki", chol)).sum(1)
        const = 0.5 * log_det - 0.5 * d * np.log(2 * np.pi) - 0.5 * d / beta
        model = Mixture(offset, m, scale * np.sqrt(nu)[:, None, None], stick + left, const)
        n, s, q, bound, rows = _statistics(points, model)
        model.lower_bound = bound
        if last is not None and abs(bound - last) / rows < TOL:
            break
        last = bound
    points.unpersist()
    return model


def bayesian_gmm(max_components: int = 30, prior: float = 1e-2, reg: float = 1e-6, max_iter: int = 500, seed: int = 42) -> FitPredict:
    return lambda points: predict(points, fit_bayesian(points, max_components, prior, reg, max_iter, seed))
