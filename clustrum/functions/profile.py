"""Profiling of a table: counts, exact distinct values, descriptions, value counts, histograms, correlations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which exact percentiles are aggregated in one pass; beyond, they are bracketed by counting.
ONE_PASS_ROWS = 200_000
#: Slices of a column that one counting pass keeps at most, and values that are read at last.
SLICES, READ_VALUES = 16_384, 2_000_000


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType | T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def _long(df: DataFrame, columns: list[str], value: str, kind: str = "double") -> DataFrame:
    """(column, value) of the columns of a one-row table."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias(value)) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def null_counts(df: DataFrame) -> DataFrame:
    """column, n_null, n_rows for every column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in df.columns))
    return one.select(F.explode(pairs).alias("p"), "_n").select("p.*", F.col("_n").alias("n_rows"))


def missing_columns(df: DataFrame) -> DataFrame:
    return null_counts(df).where("n_null > 0")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_distinct: exact, nulls ignored; one shuffle of distinct (column, value) pairs for all columns."""
    columns = columns or df.columns
    values = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns))
    found = df.select(F.explode(values).alias("p")).select("p.*").distinct().groupBy("column").agg(F.count("v").alias("n_distinct"))
    return found


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n: the most frequent first, nulls counted, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_first())


#: A share of the way from the least to the greatest value: a number, or a fraction as (numerator, denominator).
Place = float | tuple[int, int]


def _place(p: Place, n: int) -> tuple[int, float]:
    """The rank at or before a place among n sorted values, and how far it is to the next one. A fraction's rank is found in
    integers, so that it can't slip off the rank that it names."""
    if isinstance(p, tuple):
        low, rest = divmod(p[0] * (n - 1), p[1])
        return low, rest / p[1]
    low = int(p * (n - 1))
    return low, p * (n - 1) - low


def quantiles(df: DataFrame, columns: list[str], probabilities: list[Place]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of each column, nulls and NaN ignored; None for a column without values.

    Small tables are aggregated at once. On large ones each wanted rank is bracketed by counting: see select_ranks().
    Memory and traffic don't depend on the number of rows.
    """
    typed = df.select(*(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    sizes = typed.agg(*(F.count(f"`{c}`").alias(c) for c in columns)).first().asDict()
    exact = any(isinstance(p, tuple) for p in probabilities)
    if max(sizes.values(), default=0) <= ONE_PASS_ROWS and not exact:
        row = typed.agg(*(F.percentile(F.col(f"`{c}`"), F.array(*map(F.lit, map(float, probabilities)))).alias(c) for c in columns)).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in columns}
    ranks = {c: sorted({r for p in probabilities for low in [_place(p, sizes[c])[0]] for r in (low, min(low + 1, sizes[c] - 1))}) for c in columns if sizes[c]}
    if max(sizes.values(), default=0) <= ONE_PASS_ROWS:
        ordered = typed.agg(*(F.array_sort(F.collect_list(F.col(f"`{c}`"))).alias(c) for c in ranks))
        picked = ordered.select(*(F.transform(F.array(*map(F.lit, own)), partial(F.get, F.col(f"`{c}`"))).alias(c) for c, own in ranks.items()))
        row = picked.first() if ranks else {}
        value = {c: dict(zip(own, row[c], strict=True)) for c, own in ranks.items()}
    else:
        value = select_ranks(typed.select(*ranks), ranks)

    def at(c: str, p: Place) -> float | None:
        if not sizes[c]:
            return None
        low, part = _place(p, sizes[c])
        a, b = value[c][low], value[c][min(low + 1, sizes[c] - 1)]
        return a + (b - a) * part

    return {c: [at(c, p) for p in probabilities] for c in columns}


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, infinities included."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & 0x7FFF_FFFF_FFFF_FFFF)


def _double(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & 0x7FFF_FFFF_FFFF_FFFF)).view(np.float64)


def _key_batches(batches: Iterator[pa.RecordBatch], columns: list[int], rows: int = 500_000) -> Iterator[dict[int, np.ndarray]]:
    """The columns' values as integers, many batches at once."""
    held, n = {i: [] for i in columns}, 0
    for batch in batches:
        for i in columns:
            held[i].append(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= rows:
            yield {i: _ordered(np.concatenate(v)) for i, v in held.items()}
            held, n = {i: [] for i in columns}, 0
    if n:
        yield {i: _ordered(np.concatenate(v)) for i, v in held.items()}


def select_ranks(typed: DataFrame, ranks: dict[str, list[int]], slices: int = SLICES, read: int = READ_VALUES) -> dict[str, dict[int, float]]:
    """The values of the sorted ranks (from 0, nulls aside) of each column.

    Each pass deals the values of all columns into slices of the brackets that hold wanted ranks, in tasks that keep one
    number for each slice, and sums those by slice; `slices` bounds a column's slices, however many ranks are wanted.
    Slices are equal in the order of the doubles' bits, so a handful of passes is enough for any values. When few values
    are left in the brackets they are read and sorted.
    """
    from .scratch import ship

    ship(typed.sparkSession)
    names = list(ranks)
    ends = typed.agg(*(f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    done: dict[str, dict[int, float]] = {c: {} for c in names}
    # of each column: disjoint brackets in order, as (lowest, highest, values below, values inside)
    brackets = {i: [(*_ordered(np.array([ends[f"lo{i}"], ends[f"hi{i}"]])).tolist(), 0, None)] for i in range(len(names))}
    left = None
    while brackets and (left is None or left > read):
        # the lowest value of each slice, bracket after bracket, and each bracket's highest value and first slice
        lows, highs, first = {}, {}, {}
        for i, own in brackets.items():
            per = max(2, slices // len(own))
            parts = [sorted({lo + (hi - lo + 1) * j // per for j in range(per)}) for lo, hi, _, _ in own]
            lows[i], highs[i] = np.array([x for p in parts for x in p], np.int64), np.array([b[1] for b in own], np.int64)
            first[i] = np.cumsum([0, *map(len, parts)])

        def counted(batches: Iterator[pa.RecordBatch], lows=lows, highs=highs, first=first) -> Iterator[pa.RecordBatch]:
            n = {i: np.zeros(len(x), np.int64) for i, x in lows.items()}
            least = {i: np.full(len(x), np.iinfo(np.int64).max) for i, x in lows.items()}
            most = {i: np.full(len(x), np.iinfo(np.int64).min) for i, x in lows.items()}
            for values in _key_batches(batches, list(lows)):
                for i, v in values.items():
                    slot = np.searchsorted(lows[i], v, "right") - 1
                    of = np.searchsorted(first[i], slot, "right") - 1
                    inside = (slot >= 0) & (v <= highs[i][np.minimum(of, len(highs[i]) - 1)])
                    v, slot = v[inside], slot[inside]
                    n[i] += np.bincount(slot, minlength=len(n[i]))
                    np.minimum.at(least[i], slot, v)
                    np.maximum.at(most[i], slot, v)
            for i, count in n.items():
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(least[i][some]), pa.array(most[i][some])], ["i", "slot", "n", "lo", "hi"])

        parts = typed.mapInArrow(counted, "i int, slot int, n long, lo long, hi long")
        whole = parts.groupBy("i", "slot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values(["i", "slot"])
        after, left = {}, 0
        for i, own in brackets.items():
            mine = whole[whole["i"] == i]
            slot, n, lo, hi = (mine[k].to_numpy() for k in ("slot", "n", "lo", "hi"))
            of = np.searchsorted(first[i], slot, "right") - 1
            before = np.cumsum(n) - n
            starts = np.searchsorted(of, np.arange(len(own)))
            below = before - before[starts][of] + np.array([b[2] for b in own])[of]
            wanted = [r for r in ranks[names[i]] if r not in done[names[i]]]
            place = (np.searchsorted(below, wanted, "right") - 1).tolist()
            done[names[i]].update((r, float(_double(lo[p : p + 1])[0])) for r, p in zip(wanted, place, strict=True) if lo[p] == hi[p])
            if still := sorted({p for p in place if lo[p] < hi[p]}):
                after[i] = [(int(lo[p]), int(hi[p]), int(below[p]), int(n[p])) for p in still]
                left += sum(int(n[p]) for p in still)
        brackets = after
    if brackets:

        def inside_values(batches: Iterator[pa.RecordBatch], own=brackets) -> Iterator[pa.RecordBatch]:
            for values in _key_batches(batches, list(own)):
                for i, v in values.items():
                    low, high = np.array([b[0] for b in own[i]], np.int64), np.array([b[1] for b in own[i]], np.int64)
                    at = np.searchsorted(low, v, "right") - 1
                    v = v[(at >= 0) & (v <= high[np.maximum(at, 0)])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v)], ["i", "v"])

        got = typed.mapInArrow(inside_values, "i int, v long").toArrow()  # at most READ_VALUES rows
        which, v = got.column("i").to_numpy(), got.column("v").to_numpy()
        for i, rows in brackets.items():
            own, start = _double(np.sort(v[which == i])), 0
            for _, _, below, n in rows:
                done[names[i]].update((r, float(own[start + r - below])) for r in ranks[names[i]] if below <= r < below + n)
                start += n
    return done


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std (sample), min, q25, q50, q75, max; quantiles exact and linear."""
    aggs = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        parts = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        aggs.append(F.struct(F.lit(c).alias("column"), *(v.alias(k) for k, v in parts.items())).alias(c))
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    spark = df.sparkSession
    found = spark.createDataFrame([(c, *map(lambda v: None if v is None else float(v), q[c])) for c in columns], "column string, q25 double, q50 double, q75 double")
    one = df.agg(*aggs).select(F.explode(F.array(*(F.col(f"`{c}`") for c in columns))).alias("p")).select("p.*")
    return one.join(F.broadcast(found), "column").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin (0 first), lower, upper, n of equal-width bins over the values' range; empty bins are there."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin long, lower double, upper double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    found = df.where(x.isNotNull()).groupBy(F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    edges = spark.range(bins).select(F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * F.lit(width)).alias("lower"), (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("upper"))
    return edges.join(F.broadcast(found), "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density(df: DataFrame, column: str, points: int = 200, bins: int = 1024, over: int = 50) -> DataFrame:
    """point (0 first), x, density, height: a Gaussian kernel estimate with Scott's bandwidth at equally spaced points.

    Values are counted in `bins` equal bins over their range, and each bin's count stands at its middle, so the driver gets
    that many counts whatever the rows. `height` is the density in the counts of a histogram of `over` bins. Nulls, NaN and infinities are left out; fewer than two values, or no spread, give an empty result.
    """
    spark, x = df.sparkSession, F.col(f"`{column}`").cast("double")
    own = df.select(x.alias("x")).where(F.abs("x") < float("inf"))
    ends = own.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n")).first()
    if ends["n"] < 2 or not ends["sd"]:
        return spark.createDataFrame([], "point int, x double, density double, height double")
    lo, width, h = ends["lo"], (ends["hi"] - ends["lo"]) / bins, ends["sd"] * ends["n"] ** -0.2
    counts = own.groupBy(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n")).toPandas()
    middle, weight = lo + (counts["bin"].to_numpy(float) + 0.5) * width, counts["n"].to_numpy(float)
    at = lo + (ends["hi"] - lo) * np.arange(points) / (points - 1)
    curve = (np.exp(-0.5 * ((at[:, None] - middle) / h) ** 2) * weight).sum(1) / (ends["n"] * h * np.sqrt(2 * np.pi))
    height = curve * (ends["n"] * (ends["hi"] - lo) / over)
    return spark.createDataFrame(list(zip(range(points), at.tolist(), curve.tolist(), height.tolist(), strict=True)), "point int, x double, density double, height double")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of each unordered pair of columns: Pearson, pairwise complete, all pairs in one pass."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    one = df.agg(*(F.corr(F.when(x[b].isNotNull(), x[a]), F.when(x[a].isNotNull(), x[b])).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("p")).select("p.*")


def correlation_summary(pairs: DataFrame, strong: float = 0.7) -> DataFrame:
    """max_abs_r (null without pairs) and n_strong: pairs of |r| above the limit."""
    return pairs.agg(F.max(F.abs("r")).alias("max_abs_r"), F.count_if(F.abs("r") > strong).alias("n_strong"))


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, lowest, highest, spread."""
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.lo").alias("lowest"), F.col(f"`{c}`.hi").alias("highest")) for c in columns))
    one = df.agg(*(F.struct(F.min(F.col(f"`{c}`").cast("double")).alias("lo"), F.max(F.col(f"`{c}`").cast("double")).alias("hi")).alias(c) for c in columns))
    return one.select(F.explode(parts).alias("p")).select("p.*", (F.col("p.highest") - F.col("p.lowest")).alias("spread"))


def column_kinds(df: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """column, dtype, n_distinct, kind: excluded, continuous or categorical; sorted by kind and distinct values."""
    spark = df.sparkSession
    named = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, dtype string")
    kind = F.when(F.col("column").isin(continuous), "continuous").when(F.col("column").isin(categorical), "categorical").otherwise("excluded")
    return distinct_counts(df).join(F.broadcast(named), "column").select("column", "dtype", "n_distinct", kind.alias("kind")).orderBy("kind", F.desc("n_distinct"), "column")


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)


def finite(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def first_best(df: DataFrame, key: str, metric: str, largest: bool = True) -> DataFrame:
    """One row: the key of the best non-null metric, the first key of equal ones."""
    value = F.col(metric) if largest else -F.col(metric)
    return df.where(F.col(metric).isNotNull()).agg(F.min_by(key, F.struct((-value).alias("m"), F.col(key).alias("k"))).alias(key), (F.max(metric) if largest else F.min(metric)).alias(metric))


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """A running sum over a table of a few rows, such as the components of a decomposition."""
    from pyspark.sql import Window

    return df.withColumn(name, F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def first_reaching(df: DataFrame, order: str, total: str, share: float) -> DataFrame:
    """The smallest order whose running total reaches the share; one more than all if none does."""
    return df.agg(F.coalesce(F.min(F.when(F.col(total) >= share, F.col(order))), F.max(order) + 1).cast("long").alias(order))


def label_summary(labels: DataFrame) -> DataFrame:
    """n_rows, n_clusters, n_noise, noise_share of (row_id, label); -1 is noise."""
    n, noise = F.count("*"), F.count_if(F.col("label") == -1)
    return labels.agg(n.alias("n_rows"), F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"), noise.alias("n_noise"), F.when(n > 0, noise / n).alias("noise_share"))
