"""Preprocessing of mixed tables: imputation, scaling, power and quantile maps, encodings, assembled into features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Literal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.functions.profile import is_numeric, quantiles
from clustrum.functions.scratch import cut, numbered, ship

from .schema import ColumnTypes

Scaling = Literal["standard", "robust", "quantile", "none"]
Encoding = Literal["onehot", "ordinal", "target_freq"]

#: What stands for a missing category, grid points of the quantile map, and where its tails end.
MISSING = "missing"
N_QUANTILES = 1000
TAIL = 1e-7
#: Coefficients of Acklam's rational approximation of the normal quantile (relative error 1.2e-9).
#: Fixed values.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
#: Categories up to which a mapping is written into the expression; a larger one is joined.
INLINE_CATEGORIES = 256


@dataclass(frozen=True)
class Strategy:
    """How continuous and categorical columns are prepared."""

    scaling: Scaling = "standard"
    encoding: Encoding = "onehot"
    power: bool = False

    def __post_init__(self) -> None:
        if self.scaling not in ("standard", "robust", "quantile", "none"):
            raise ValueError(f"unknown scaling {self.scaling!r}")
        if self.encoding not in ("onehot", "ordinal", "target_freq"):
            raise ValueError(f"unknown encoding {self.encoding!r}")


#: The strategies that the reference workflow compares, by name.
STRATEGIES = {
    "standard+onehot": Strategy("standard", "onehot"), "standard+onehot+yeo": Strategy("standard", "onehot", True), "robust+ordinal": Strategy("robust", "ordinal"),
    "robust+freq": Strategy("robust", "target_freq"), "quantile+ordinal": Strategy("quantile", "ordinal"), "quantile+freq+yeo": Strategy("quantile", "target_freq", True),
}


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def number(name: str) -> Column:
    """The column as double, NaN as null."""
    x = column(name).cast("double")
    return F.when(~F.isnan(x), x)


def yeo_johnson(y: Column, lam: float) -> Column:
    up = F.log1p(y) if lam == 0 else (F.pow(y + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-y) if lam == 2 else -(F.pow(1 - y, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(y >= 0, up).otherwise(down)


def _psi(y: np.ndarray, lam: float) -> np.ndarray:
    out, pos = np.empty_like(y), y >= 0
    out[pos] = np.log1p(y[pos]) if lam == 0 else ((y[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-y[~pos]) if lam == 2 else -((1 - y[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def fit_yeo_johnson(df: DataFrame, values: dict[str, Column], rounds: int = 3, low: float = -2.0, high: float = 4.0, steps: int = 25) -> dict[str, float]:
    """The exponent of each column by maximum likelihood on a grid that is refined around its best point.

    Each round is one pass: partitions send moments for every (column, exponent), merged by parallel variances.
    """
    names = list(values)
    if not names:
        return {}
    ship(df.sparkSession)
    table = df.select(*(values[c].alias(f"c{i}") for i, c in enumerate(names)))
    grids = {c: np.linspace(low, high, steps) for c in names}
    best: dict[str, float] = {}
    for _ in range(rounds):

        def moments(frames: Iterator[pd.DataFrame], grids=dict(grids)) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for i, c in enumerate(names):
                    y = frame[f"c{i}"].to_numpy(float)
                    y = y[np.isfinite(y)]
                    if len(y):
                        sign = float((np.sign(y) * np.log1p(np.abs(y))).sum())
                        for g in grids[c].tolist():
                            psi = _psi(y, g)
                            out.append((i, g, len(y), float(psi.mean()), float(((psi - psi.mean()) ** 2).sum()), sign))
                yield pd.DataFrame(out, columns=["i", "lam", "n", "mean", "m2", "sign"])

        parts = table.mapInPandas(moments, "i int, lam double, n long, mean double, m2 double, sign double")
        whole = parts.groupBy("i", "lam").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("sign").alias("sign"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("q")).toPandas()
        variance = (whole["q"] / whole["n"] - (whole["s"] / whole["n"]) ** 2).clip(lower=1e-300)
        whole["ll"] = -whole["n"] / 2 * np.log(variance) + (whole["lam"] - 1) * whole["sign"]
        for i, c in enumerate(names):
            own = whole[whole["i"] == i].sort_values("lam")
            best[c] = float(own["lam"].iloc[int(own["ll"].to_numpy().argmax())]) if len(own) else 1.0
            step = grids[c][1] - grids[c][0]
            grids[c] = np.linspace(best[c] - step, best[c] + step, steps)
    return {c: round(v, 10) for c, v in best.items()}


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda a, b: a * x + F.lit(b), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(u: Column) -> Column:
    """The normal quantile of u by rational functions, with a relative error below 1.2e-9."""
    far = lambda q: _horner(ACKLAM_C, q) / _horner(ACKLAM_D, q)
    r = (u - 0.5) * (u - 0.5)
    middle = (u - 0.5) * _horner(ACKLAM_A, r) / _horner(ACKLAM_B, r)
    return F.when(u < 0.02425, far(F.sqrt(-2 * F.log(u)))).when(u > 0.97575, -far(F.sqrt(-2 * F.log(1 - u)))).otherwise(middle)


def quantile_normal(x: Column, grid: list[float], ranks: list[float]) -> Column:
    """The normal score of x on a grid of quantiles: the mean of the interpolations from below and from above."""
    q, r = np.array(grid, float), np.array(ranks, float)

    @F.pandas_udf("double")
    def place(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float)
        return pd.Series(np.clip(0.5 * (np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1])), TAIL, 1 - TAIL))

    return normal_quantile(place(x))


@dataclass
class Preprocessor:
    """fit() reads a table's parameters, transform() is a lazy projection: the id columns and an array `features`."""

    types: ColumnTypes
    strategy: Strategy = field(default_factory=Strategy)
    medians: dict[str, float] = field(default_factory=dict)
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    grids: dict[str, list[float]] = field(default_factory=dict)
    ranks: list[float] = field(default_factory=list)
    lambdas: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    shares: dict[str, list[tuple]] = field(default_factory=dict)
    numeric: set[str] = field(default_factory=set)
    #: Code tables of columns with more than INLINE_CATEGORIES values.
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.types.continuous and not self.types.categorical:
            raise ValueError("no column to prepare")

    def fit(self, df: DataFrame) -> Preprocessor:
        ship(df.sparkSession)
        cont, kind = self.types.continuous, self.strategy.scaling
        self.numeric = {f.name for f in df.schema.fields if is_numeric(f.dataType)}
        if cont:
            n = df.count()
            m = min(N_QUANTILES, n) - 1
            places = [(j, m) for j in range(m + 1)] if m > 0 else [(0, 1)]
            self.ranks = [j / m for j, m in places] if kind == "quantile" else []
            found = quantiles(df, cont, [0.25, 0.5, 0.75, *([] if kind != "quantile" else [0.0, 1.0])])
            self.medians = {c: found[c][1] if found[c][1] is not None else 0.0 for c in cont}
            filled = df.select(*(self._filled(c).alias(c) for c in cont))
            if kind == "standard":
                row = filled.agg(*(f(column(c)).alias(f"{k}{i}") for i, c in enumerate(cont) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
                self.centre = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(cont)}
                self.scale = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(cont)}
            elif kind in ("robust", "quantile"):
                q = quantiles(filled, cont, [0.25, 0.75] if kind == "robust" else places)
                if kind == "robust":
                    self.centre = dict(self.medians)
                    self.scale = {c: (q[c][1] - q[c][0]) or 1.0 if q[c][0] is not None else 1.0 for c in cont}
                else:
                    self.grids = {c: np.maximum.accumulate(np.array(q[c], float)).tolist() if q[c][0] is not None else [0.0] * len(self.ranks) for c in cont}
            if self.strategy.power:
                self.lambdas = fit_yeo_johnson(df, {c: self._scaled(c) for c in cont})
        cat = self.types.categorical
        if cat:
            n = df.count()
            for c in cat:
                counts = df.groupBy(self._category(c).alias("v")).agg(F.count("*").alias("n"))
                if self.strategy.encoding != "onehot" and len(counts.select("v").head(INLINE_CATEGORIES + 1)) > INLINE_CATEGORIES:
                    if self.strategy.encoding == "target_freq":
                        self.tables[c] = cut(counts.select("v", (F.col("n") / F.lit(float(n))).alias("code")), "categories")
                    else:
                        self.tables[c] = numbered(counts.select("v"), "v", name="code").withColumn("code", F.col("code").cast("double"))
                    continue
                if self.strategy.encoding == "target_freq":
                    self.shares[c] = [(r["v"], r["n"] / n) for r in counts.orderBy("v").collect()]
                else:
                    self.categories[c] = [r["v"] for r in counts.select("v").orderBy("v").collect()]
        return self

    def _filled(self, c: str) -> Column:
        return F.coalesce(number(c), F.lit(float(self.medians.get(c, 0.0))))

    def _category(self, c: str) -> Column:
        """Numbers that miss nothing keep their order as numbers; other values, and missing ones, are strings."""
        if c in self.numeric:
            return F.struct(column(c).isNull().alias("z"), F.coalesce(column(c).cast("double"), F.lit(0.0)).alias("v")).cast("struct<z:boolean,v:double>")
        return F.struct(F.lit(False).alias("z"), F.coalesce(column(c).cast("string"), F.lit(MISSING)).alias("v"))

    def _scaled(self, c: str) -> Column:
        kind, x = self.strategy.scaling, self._filled(c)
        if kind == "quantile":
            return quantile_normal(x, self.grids[c], self.ranks)
        return x if kind == "none" else (x - F.lit(self.centre[c])) / F.lit(self.scale[c])

    def _literal(self, v) -> Column:
        return F.struct(F.lit(v["z"]).alias("z"), F.lit(v["v"]).alias("v"))

    def _coded(self, c: str) -> list[Column]:
        own = self._category(c)
        if c in self.tables:
            return [F.coalesce(F.col(f"_code_{self.types.categorical.index(c)}"), F.lit(-1.0 if self.strategy.encoding == "ordinal" else 0.0))]
        if self.strategy.encoding == "onehot":
            return [(own == self._literal(v)).cast("double") for v in self.categories[c]]
        if self.strategy.encoding == "ordinal":
            table, default = [(v, float(i)) for i, v in enumerate(self.categories[c])], -1.0
        else:
            table, default = self.shares[c], 0.0
        if not table:
            return [F.lit(default)]
        lookup = F.map_from_arrays(F.array(*(self._literal(v) for v, _ in table)), F.array(*(F.lit(float(x)) for _, x in table)))
        return [F.coalesce(F.try_element_at(lookup, own), F.lit(default))]

    def feature_names(self) -> list[str]:
        names = list(self.types.continuous)
        for c in self.types.categorical:
            names += [f"{c}={v['v'] if not v['z'] else MISSING}" for v in self.categories[c]] if self.strategy.encoding == "onehot" else [c]
        return names

    def columns(self) -> list[Column]:
        """One column for each feature: continuous ones first, then categorical ones."""
        out = []
        for c in self.types.continuous:
            x = self._scaled(c)
            out.append(yeo_johnson(x, self.lambdas[c]) if self.strategy.power else x)
        for c in self.types.categorical:
            out += self._coded(c)
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = self.types.excluded if keep is None else keep
        for c, table in self.tables.items():
            i = self.types.categorical.index(c)
            df = df.withColumn(f"_v_{i}", self._category(c)).join(table.select(F.col("v").alias(f"_v_{i}"), F.col("code").alias(f"_code_{i}")), f"_v_{i}", "left")
        names = [f"f{i}" for i in range(len(self.columns()))]
        wide = df.select(*(column(c) for c in keep), *(x.alias(n) for n, x in zip(names, self.columns(), strict=True)))
        return wide.select(*(column(c) for c in keep), F.array(*names).alias("features"))
