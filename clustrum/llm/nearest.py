"""Approximate nearest neighbours by cosine: inverted lists scanned dimension by dimension, with early abandoning.

Unit vectors are rotated at random once, so the first d of D coordinates estimate a squared distance, and the test of
Gao and Long (2023) abandons a candidate whose partial distance is too large for the threshold:
partial > threshold * (d / D) * (1 + EPSILON / sqrt(d))**2. Lists are scanned in column blocks of COLUMNS coordinates;
only candidates that passed are read further. Survivors are scored in double precision on the original vectors.

The rotation, the list centres, how many lists are probed and each query's threshold come from a bounded sample; every
vector is put in a list, and lists are scanned in blocks of vectors and of queries. Only what a scan finds is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, first_by_hash, read_table, ship

#: Vectors that the index is fitted on, at most, by the hash of the id; sample queries that set how many lists are probed.
SAMPLE, TRIALS = 10_000, 400
#: Share of those queries' true neighbours that the probed lists hold; lists, at most.
COVER, LISTS = 0.985, 1024
#: Coordinates read at a time, and the test's width in standard deviations.
COLUMNS, EPSILON = 16, 3.0
#: Vectors and queries of a list that one task scans at once.
BLOCK_VECTORS, BLOCK_QUERIES, CHUNK = 8192, 4096, 1024


@dataclass(frozen=True)
class Index:
    dimensions: int
    rotation: np.ndarray
    centres: np.ndarray
    probes: int
    ids: np.ndarray
    #: The sample's vectors.
    vectors: np.ndarray


def matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors in double precision) of the vectors of this length that take part: no nulls, no non-finite, not all
    0. Each is scaled by a power of 2, which changes no cosine and lets no square over- or underflow."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    rows = np.flatnonzero(sizes == dimensions)
    if not len(rows):
        return rows, np.zeros((0, dimensions))
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dimensions)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    rows, x = rows[good], x[good]
    _, power = np.frexp(np.abs(x).max(1)) if len(x) else (None, np.zeros(0, np.int64))
    return rows, np.ldexp(x, -power[:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; the same two vectors give the same number wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T - (c * c).sum(1) / 2).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _list_order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, less the vector's own norm."""
    return (centres * centres).sum(1) - 2 * x @ centres.T


def fit(vectors: DataFrame, n: int, dimensions: int, k: int, seed: int = 3) -> Index | None:
    """An index for the n rows (vec_id, embedding), vectors of one length; None if no vector takes part."""
    rows = first_by_hash(vectors.select("vec_id", "embedding"), "vec_id", SAMPLE, n).toArrow()
    own, x = matrix(rows.column("embedding"), dimensions)
    ids = rows.column("vec_id").to_numpy()[own].astype(np.int64)
    ids, first = np.unique(ids, return_index=True)
    x = x[first]
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    rotation, upper = np.linalg.qr(rng.standard_normal((d, d)))
    rotation = rotation * np.sign(np.diag(upper))
    z = unit(x) @ rotation
    centres = _kmeans(z, int(np.clip(np.sqrt(n), 1, LISTS)), rng)
    probes = len(centres)
    if len(z) > k:
        trial = rng.choice(len(z), min(TRIALS, len(z)), replace=False)
        near = z[trial] @ z.T
        near[np.arange(len(trial)), trial] = -np.inf
        true = np.argsort(-near, 1, kind="stable")[:, :k]
        home = np.concatenate([_list_order(z[a : a + 4096], centres).argmin(1) for a in range(0, len(z), 4096)])
        place = np.argsort(np.argsort(_list_order(z[trial], centres), 1), 1)
        probes = int(np.quantile(np.take_along_axis(place, home[true], 1), COVER, method="higher")) + 1
    return Index(d, rotation, centres, probes, ids, x)


def _assign(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    for batch in batches:
        rows, x = matrix(batch.column(1), index.dimensions)
        for a in range(0, len(rows), 2048):
            part = x[a : a + 2048]
            home = _list_order(unit(part) @ index.rotation, index.centres).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home.astype(np.int32)), batch.column(0).take(pa.array(rows[a : a + 2048])), pa.array([v.tobytes() for v in part], pa.binary())], ["list", "vec_id", "vector"]
            )


def _plan(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """For each query the lists to probe, and the squared distance of its (2 k)-th nearest sample vector: beyond the k-th,
    for the test is by estimates."""
    index: Index = shared.value
    sample = unit(index.vectors)
    for batch in batches:
        rows, x = matrix(batch.column(1), index.dimensions)
        for a in range(0, len(rows), 512):
            part = x[a : a + 512]
            ids = batch.column(0).take(pa.array(rows[a : a + 512])).to_numpy(zero_copy_only=False)
            lists = np.argsort(_list_order(unit(part) @ index.rotation, index.centres), 1, kind="stable")[:, : index.probes]
            near = unit(part) @ sample.T
            near[ids[:, None] == index.ids[None, :]] = -np.inf
            far = min(2 * k, near.shape[1]) - 1
            kth = -np.partition(-near, far, 1)[:, far] if far >= k else np.full(len(part), -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([v.tobytes() for v in part], pa.binary()), pa.array(2 - 2 * kth), pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                ["query_id", "vector", "reach", "lists"],
            )


_PLAN = "query_id long, vector binary, reach double, lists array<int>"


def scan(q: np.ndarray, reach: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places of the candidates that no test abandoned; q and v are rotated unit vectors."""
    d = q.shape[1]
    kept_q, kept_v = [], []
    limit = reach * (1 + 1e-5) + 1e-6
    for start in range(0, len(v), CHUNK):
        part = v[start : start + CHUNK]
        stop = min(COLUMNS, d)
        a, b = q[:, :stop], part[:, :stop]
        partial = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        test = lambda s: 1.0 if s >= d else s / d * (1 + EPSILON / np.sqrt(s)) ** 2
        qi, vi = np.nonzero(partial <= (limit * min(1.0, test(stop)))[:, None])
        partial = partial[qi, vi]
        while stop < d and len(qi):
            more = min(stop + COLUMNS, d)
            gap = q[qi, stop:more] - part[vi, stop:more]
            partial = partial + (gap * gap).sum(1)
            stop = more
            ok = partial <= limit[qi] * min(1.0, test(stop))
            qi, vi, partial = qi[ok], vi[ok], partial[ok]
        kept_q.append(qi)
        kept_v.append(vi + start)
    return np.concatenate(kept_q), np.concatenate(kept_v)


def _scan(left: pa.Table, right: pa.Table, shared, k: int) -> pa.Table:
    index: Index = shared.value
    out = {"query_id": [], "vec_id": [], "score": []}
    if left.num_rows and right.num_rows:
        read = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(t.num_rows, -1)
        v, q = read(left), read(right)
        ids, queries, reach = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy(), right.column("reach").to_numpy()
        rotated = ((unit(v) @ index.rotation).astype(np.float32), (unit(q) @ index.rotation).astype(np.float32))
        for a in range(0, len(q), 256):
            qi, vi = scan(rotated[1][a : a + 256], reach[a : a + 256], rotated[0])
            qi = qi + a
            other = queries[qi] != ids[vi]
            qi, vi = qi[other], vi[other]
            score = np.concatenate([cosine(q[qi[b : b + 65536]], v[vi[b : b + 65536]]) for b in range(0, len(qi), 65536)] or [np.zeros(0)])
            order = np.lexsort((ids[vi], -score, qi))
            qi, vi, score = qi[order], vi[order], score[order]
            # one row of a vector that repeats its id, then the best k of each query
            pair = np.unique(np.stack((qi, ids[vi]), 1), axis=0, return_index=True)[1] if len(qi) else np.zeros(0, np.int64)
            once = np.sort(pair)
            qi, vi, score = qi[once], vi[once], score[once]
            begins = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, np.int64)
            rank = np.arange(len(qi)) - np.repeat(begins, np.diff(np.r_[begins, len(qi)]))
            top = rank < k
            out["query_id"] += queries[qi[top]].tolist()
            out["vec_id"] += ids[vi[top]].tolist()
            out["score"] += score[top].tolist()
    return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


_NEAREST = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) found for each of queries (the same).

    Nearest first, ties to the smaller vec_id; fewer if there are fewer. A row's own id is never its candidate. Rows
    without id, and vectors that are null, empty, all 0, or hold a null or non-finite component, take no part. Vectors of
    different lengths have no cosine, so each length is searched by itself. Of candidates that repeat an id the nearest
    counts; of queries the smallest vector. No vectors, or no queries, give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    typed = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    vectors, queries = typed(vectors), typed(queries)
    lengths = vectors.groupBy(F.size("embedding").alias("d")).count().join(queries.select(F.size("embedding").alias("d")).distinct(), "d").collect()
    one = lambda df, d: df.where(F.size("embedding") == d)
    parts = [_search_length(one(vectors, r["d"]), one(queries, r["d"]), r["count"], r["d"], k) for r in sorted(lengths)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], _NEAREST)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_length(vectors: DataFrame, queries: DataFrame, n: int, dimensions: int, k: int) -> DataFrame | None:
    """query_id, vec_id, score of what the scans of each block found, for vectors of one length."""
    index = fit(vectors, n, dimensions, k)
    if index is None:
        return None
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    once = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    plan = cut(once.mapInArrow(lambda b: _plan(b, shared, k), _PLAN), "queries")
    placed = cut(vectors.mapInArrow(lambda b: _assign(b, shared), "list int, vec_id long, vector binary"), "lists")

    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # LISTS rows at most
    blocks = [max(1, -(-sizes.get(i, 0) // BLOCK_VECTORS)) for i in range(len(index.centres))]
    n_blocks = F.element_at(F.array(*map(F.lit, blocks)), F.col("list") + 1)
    query_blocks = max(1, -(-plan.count() // BLOCK_QUERIES))
    left = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), n_blocks).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))) if query_blocks > 1 else left.withColumn("part", F.lit(0))
    right = plan.select("query_id", "vector", "reach", F.explode("lists").alias("list"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    right = right.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    key = ["list", "block", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _scan(a, b, shared, k), "query_id long, vec_id long, score double")


def op2_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
