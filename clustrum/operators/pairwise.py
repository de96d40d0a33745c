"""Distances between rows: one block primitive behind neighbours, votes, ranges and silhouettes.

Rows are (row_id, features). A fit set of a checked size is broadcast once and every partition of the queries goes over
it in blocks; a larger one is dealt into blocks, each met by blocks of the queries, and the results are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrum.functions.scratch import cut, numbered, ship

#: Bytes of a fit set up to which it is broadcast; rows of the blocks that a larger one is dealt into.
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 50_000
#: Rows of a fit set from which queries are dealt out anew, so that all cores take part.
SPREAD_ROWS = 1_000
#: Pivots of a search that prunes, at most, and fit rows of a pivot's list on average until those are used up; lists and the
#: queries that visit them meet in blocks of as many rows.
PIVOTS, LIST_ROWS = 512, 4096
#: Queries that tell what pruning spares, about, and the share of visits from which nothing is pruned: rows would be dealt once
#: for each list instead of each block.
PROBES, UNPRUNED = 500, 0.25
#: Distances are computed for so many pairs at once; a search for neighbours goes over tiles of so many rows of either side.
PAIRS_AT_ONCE, TILE = 2_000_000, 512
#: Distances are ranked by this many decimals, then by row_id, so that equal distances tie whatever the order of sums.
DECIMALS = 9


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distances(x: np.ndarray, y: np.ndarray, same: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of all rows; `same` marks pairs of one row, whose distance is 0 exactly."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    out = np.sqrt(np.maximum(square, 0))
    if same is not None:
        out[same] = 0.0
    return out


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of equal place, from their differences: the same in both directions to the last bit, 0 of equal rows."""
    gap = x - y
    return np.sqrt(np.ascontiguousarray(gap * gap).sum(1))


def same_rows(ids: np.ndarray, fit_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ids, places in fit_ids) of equal ids."""
    order = np.argsort(fit_ids, kind="stable")
    low, high = (np.searchsorted(fit_ids, ids, side, sorter=order) for side in ("left", "right"))
    n = high - low
    return np.repeat(np.arange(len(ids)), n), order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def least(g: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of all finite entries up to slack above the k-th smallest of their row, and of a few more: the k-th
    smallest of the least entries of groups of columns is no smaller, and is found without ordering rows."""
    rows, cols = g.shape
    wide = max(1, min(64, cols // (4 * k)))
    held = cols // wide
    low = g[:, : held * wide].reshape(rows, held, wide).min(2)
    if held * wide < cols:
        low = np.hstack((low, g[:, held * wide :]))
    bound = np.partition(low, k - 1, 1)[:, k - 1] if k > 1 else low.min(1)
    bound = np.where(np.isfinite(bound), bound, np.finfo(float).max)
    return np.nonzero(g <= (bound + slack)[:, None])


_HELD: list = []


def turned(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(-2 y transposed, squared lengths of y), made once for all blocks of queries that meet the same fit rows: a few queries
    at a time cost less than that."""
    if not _HELD or _HELD[0] is not y:
        _HELD[:] = [y, -2 * y.T, (y * y).sum(1)]
    return _HELD[1], _HELD[2]


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances of all rows by one product, how far each row's may be off)."""
    t, b = turned(y)
    a = (x * x).sum(1)
    g = x @ t
    g += a[:, None]
    g += b[None, :]
    return g, 1e-14 * (8 + x.shape[1]) * (a + b.max(initial=0)) + 1e-300


#: Axes up to which tiles have boxes that rule them out; queries that are held against a tile's box at once.
BOX_AXES, BOX_ROWS = 16, 4096


class Tiles:
    """Fit rows in tiles for searches: moved to their mean, in single precision where their size allows it, which finds what may
    be near before distances come from differences. Rows of few axes are put in order by halving their widest axis, so that a
    tile's box tells how near its rows can be."""

    def __init__(self, y: np.ndarray):
        n, d = y.shape
        finite = bool(np.isfinite(y).all())
        self.boxed = finite and d <= BOX_AXES and n >= 16 * TILE
        self.order = halved(y, TILE) if self.boxed else np.arange(n)
        self.mid = y.mean(0) if finite and n else np.zeros(d)
        z = y[self.order] - self.mid
        b = (z * z).sum(1)
        self.most, self.starts = b.max(initial=0), np.arange(0, n, TILE)
        self.single = finite and self.most < 1e30
        self.tables: dict = {}
        self.z, self.b = z, b
        if self.boxed:
            self.low, self.high = np.minimum.reduceat(z, self.starts), np.maximum.reduceat(z, self.starts)

    def table(self, kind: type) -> np.ndarray:
        """-2 y transposed over the squared lengths."""
        if kind not in self.tables:
            self.tables[kind] = np.vstack((-2 * self.z.T, self.b)).astype(kind)
        return self.tables[kind]

    def asked(self, x: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, type]:
        """(queries moved, with a column of ones, squared lengths, how far squares may be off, number type) of queries."""
        x = x - self.mid
        a = (x * x).sum(1)
        kind = np.float32 if single and self.single and a.max(initial=0) < 1e30 else np.float64
        unit = 6e-8 if kind is np.float32 else 1.2e-16
        return x, np.hstack((x, np.ones((len(x), 1)))).astype(kind), a, unit * (10 + x.shape[1]) * (a + 2 * self.most) + 1e-300, kind

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from moved queries to the tiles' boxes, a little less for rounding; 0 without boxes."""
        out = np.zeros((len(x), len(self.starts)))
        if self.boxed:
            for k in range(x.shape[1]):
                gap = np.maximum(self.low[:, k] - x[:, k : k + 1], x[:, k : k + 1] - self.high[:, k])
                np.maximum(gap, 0, out=gap)
                out += gap * gap
            out *= 1 - 1e-12
        return out


def halved(y: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows whose runs of `leaf` rows are close together: runs are halved along their widest axis."""
    order, todo = np.arange(len(y)), [(0, len(y))]
    while todo:
        a, b = todo.pop()
        if b - a > leaf:
            part = y[order[a:b]]
            half = leaf * (-(-(b - a) // leaf) // 2)
            order[a:b] = order[a:b][np.argpartition(part[:, np.ptp(part, 0).argmax()], half)]
            todo += [(a, a + half), (a + half, b)]
    return order


_TILED: list = []


def tiled(y: np.ndarray, axes: int | None = None) -> Tiles:
    """Tiles of y, or of its axes up to `axes`, made once for all queries that meet the same fit rows."""
    if not _TILED or _TILED[0] is not y:
        _TILED[:] = [y, Tiles(y if axes is None else np.ascontiguousarray(y[:, :axes]))]
    return _TILED[1]


def nearest(ids: np.ndarray, x: np.ndarray, fit_ids: np.ndarray, y: np.ndarray, k: int, exclude_self: bool, single: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(queries, fit rows) that may be among the k nearest, ties included, and a few more. Fit rows
    are met in tiles that stay near the core; a bound of each query, which falls as nearer rows are found, lets few of a tile's
    rows through, and rules tiles out by their boxes. Where single precision lets many through, double precision is used."""
    fit, k, far = tiled(y), k + exclude_self, np.finfo(float).max
    x0, moved, a, off, kind = fit.asked(x, single)
    table = fit.table(kind)
    slack = 2 * off + 10.0**-DECIMALS * (2 * (np.sqrt(a) + np.sqrt(fit.most)) + 1)
    # bounds and values are squared distances less the query's own length
    bound, held, count, room = np.full(len(ids), far), [], 0, 4 * k * len(ids)

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, f, v = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((v, q))
        q, f, v = q[order], f[order], v[order]
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        kth = np.flatnonzero(np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)])) == k - 1)
        bound[q[kth]] = np.minimum(bound[q[kth]], v[kth])
        keep = v <= (bound + slack)[q]
        return q[keep], f[keep], v[keep]

    def again(single: bool, half: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [nearest(ids[p], x[p], fit_ids, y, k - exclude_self, exclude_self, single) for p in (slice(0, half), slice(half, None)) if len(ids[p])]
        return np.concatenate([p[0] + i * half for i, p in enumerate(parts)]), np.concatenate([p[1] for p in parts])

    kind_single = kind is np.float32
    gaps = fit.gaps(x0) if fit.boxed else None
    steps, done = [(j, slice(None)) for j in range(len(fit.starts))], None
    # with boxes a query meets its nearest tile first, then those within parts of its bound, which falls on the way
    for share in (None, 0.1, 0.4, 1.0) if gaps is not None else (None,):
        if gaps is not None:
            if share is None:
                mine = gaps.argmin(1)
                want = np.zeros(gaps.shape, bool)
                want[np.arange(len(ids)), mine] = True
                done = want
            else:
                reach = np.where(bound < far, np.maximum(bound + a, 0) + slack, far)
                want = (gaps <= (reach * share)[:, None]) & ~done
                done = done | want
            steps = [(j, np.flatnonzero(want[:, j])) for j in np.flatnonzero(want.any(0)).tolist()]
        for j, some in steps:
            i = j * TILE
            g = moved[some] @ table[:, i : i + TILE]
            if share is None and (gaps is not None or not i) and k <= g.shape[1]:
                bound[some] = np.minimum(np.partition(g, k - 1, 1)[:, k - 1], bound[some])
            at = np.flatnonzero(g <= (bound + slack)[some].clip(max=3e38)[:, None].astype(kind))
            q, f = at // g.shape[1], at % g.shape[1]
            held.append((q if gaps is None else some[q], f + i, g.reshape(-1)[at].astype(float)))
            count += len(q)
            if count > room:
                held = [settle()]
                count = len(held[0][0])
                room = max(room, 2 * count)
                if kind_single and count > 16 * k * len(ids):
                    return again(False, len(ids))
                if count > PAIRS_AT_ONCE and len(ids) > 1:
                    # many rows tie: fewer queries at a time
                    return again(single, len(ids) // 2)
        if gaps is not None and held:
            held = [settle()]
            count = len(held[0][0])
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, f, _ = settle()
    f = fit.order[f]
    keep = ids[q] != fit_ids[f] if exclude_self else slice(None)
    return q[keep], f[keep]


Block = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], pa.RecordBatch]


def block_join(queries: DataFrame, fit: DataFrame, block: Block, schema: str, extra: str | None = None, broadcast_bytes: int | None = None, step: int | None = None) -> DataFrame:
    """block(query ids, query rows, fit ids, fit rows, fit extras) over all blocks of queries x fit rows.

    queries and fit have row_id and features, fit also the column `extra` if it is named. The results of blocks of one
    query are rows of their own, for the caller to merge: with a broadcast fit set each query has one block. A block has `step`
    queries, or as many as make PAIRS_AT_ONCE pairs.
    """
    ship(queries.sparkSession)
    wanted = ["row_id", "features", *([extra] if extra else [])]
    fit = fit.select(*wanted)
    queries = queries.select("row_id", "features")
    sample = fit.select(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    n, d = sample["n"], sample["d"] or 0

    def over(ids: np.ndarray, x: np.ndarray, fit_ids: np.ndarray, y: np.ndarray, more: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        many = step or max(1, PAIRS_AT_ONCE // max(1, len(fit_ids)))
        for a in range(0, len(ids), many):
            yield block(ids[a : a + many], x[a : a + many], fit_ids, y, more)

    def arrays(t: pa.Table | pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
        return [matrix(t.column(i)) if pa.types.is_list(t.schema.field(i).type) else t.column(i).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(i).to_numpy() for i, c in enumerate(names)]

    cores = queries.sparkSession.sparkContext.defaultParallelism
    if n * max(d, 1) * 8 <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        got = arrays(fit.orderBy("row_id").toArrow(), wanted)
        shared = queries.sparkSession.sparkContext.broadcast((got[0], got[1], got[2] if extra else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fit_ids, y, more = shared.value
            for batch in batches:
                if batch.num_rows and len(fit_ids):
                    ids, x = arrays(batch, ["row_id", "features"])
                    yield from over(ids, x, fit_ids, y, more)

        # a table of one file would be one task's
        return (queries.repartition(2 * cores, "row_id") if n >= SPREAD_ROWS else queries).mapInArrow(run, schema)

    blocks = -(-n // BLOCK_ROWS)
    asked = queries.count()
    parts = max(-(-asked // BLOCK_ROWS), min(-(-2 * cores // blocks), -(-asked // SPREAD_ROWS)))
    left = queries.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(max(1, parts)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = fit.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, parts) - 1).cast("long"))))

    # names of its own for the fit side, which may be the queries' table itself
    right = right.select(F.col("part").alias("fit_part"), F.col("block").alias("fit_block"), *(F.col(c).alias(f"fit_{c}") for c in wanted))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return out.empty_table()
        ids, x = arrays(a.select(["row_id", "features"]), ["row_id", "features"])
        own = arrays(b.select([f"fit_{c}" for c in wanted]), wanted)
        return pa.Table.from_batches(list(over(ids, x, own[0], own[1], own[2] if extra else None)))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    return left.groupBy("part", "block").cogroup(right.groupBy("fit_part", "fit_block")).applyInArrow(meet, schema)


_FOUND = "row_id long, nbr_id long, dist double"


def _by_rank(cols: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy("row_id").orderBy(F.round("dist", DECIMALS), "nbr_id"))


def knn(queries: DataFrame, fit: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """row_id, nbr_id, dist, rank (from 1): the k nearest fit rows, exact, ties to the smaller id; a query that is a fit
    row counts as its own neighbour unless exclude_self."""

    def block(ids, x, fit_ids, y, _):
        m = min(k, len(fit_ids))
        if not m:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["row_id", "nbr_id", "dist"])
        # all that may be among the first m, ties included, then the exact order
        qi, fi = nearest(ids, x, fit_ids, y, m, exclude_self)
        d = apart(x[qi], y[fi])
        d[ids[qi] == fit_ids[fi]] = np.inf if exclude_self else 0.0
        near = np.round(d, DECIMALS)
        order = np.lexsort((fit_ids[fi], near, qi))
        qi, fi, d = qi[order], fi[order], d[order]
        begins = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, int)
        rank = np.arange(len(qi)) - np.repeat(begins, np.diff(np.r_[begins, len(qi)]))
        keep = (rank < m) & np.isfinite(d)
        qi, fi = qi[keep], fi[keep]
        return pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(fit_ids[fi]), pa.array(d[keep])], ["row_id", "nbr_id", "dist"])

    size = fit.select(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 <= BROADCAST_BYTES:
        found = block_join(queries, fit, block, _FOUND, step=BOX_ROWS if (size["d"] or 0) <= BOX_AXES else TILE)
    else:
        pruned = _PrunedJoin(fit, size["n"], k + exclude_self)
        probes = queries.where(F.pmod(F.xxhash64("row_id"), F.lit(max(1, size["n"] // PROBES))) == 0).select("row_id", "features")
        probes = cut(probes.limit(4 * PROBES), "probes")
        far = block_join(probes, fit, block, _FOUND, step=TILE).withColumn("rank", _by_rank([])).where(F.col("rank") <= k).groupBy("row_id").agg(F.max("dist").alias("reach"))
        visited = pruned.visits(probes, None).union(pruned.visits(probes, far)).count()
        if visited > UNPRUNED * probes.count() * int((pruned.count > 0).sum()):
            found = block_join(queries, fit, block, _FOUND, step=TILE)
        else:
            found = pruned.search(queries, block, k)
    return found.withColumn("rank", _by_rank([])).where(F.col("rank") <= k)


class _PrunedJoin:
    """Fit rows in lists around pivots, each with its radii. By the triangle inequality a list can't hold a row that is
    nearer to a query than the least of |query - pivot| - outer radius and inner radius - |query - pivot| allows.

    A query first meets its nearest lists, which bound the distance of its k-th neighbour, then the lists whose own bound
    doesn't exceed that one; all others are skipped. Lists and the queries that visit them are dealt into blocks.
    """

    def __init__(self, fit: DataFrame, n: int, k: int):
        ship(fit.sparkSession)
        self.k = k
        many = int(np.clip(n // LIST_ROWS, 1, PIVOTS))
        first = fit.select("row_id", "features").orderBy(F.xxhash64("row_id"), "row_id").limit(many).toArrow()
        self.pivots = matrix(first.column("features"))
        self.slack = 1e-6 * (1 + float(np.sqrt((self.pivots**2).sum(1)).max(initial=0)))
        pivots = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = distances(matrix(batch.column(1)), pivots)
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int64)), pa.array(d[np.arange(len(near)), near])], ["row_id", "features", "list", "d"])

        placed = fit.select("row_id", F.col("features").cast("array<double>").alias("features")).mapInArrow(place, "row_id long, features array<double>, list long, d double")
        self.lists = cut(placed, "lists")
        self.count, self.inner, self.outer = np.zeros(many, np.int64), np.full(many, np.inf), np.full(many, -np.inf)
        for r in self.lists.groupBy("list").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect():  # a row a pivot
            self.count[r["list"]], self.inner[r["list"]], self.outer[r["list"]] = r["n"], r["lo"], r["hi"]

    def visits(self, queries: DataFrame, reach: DataFrame | None) -> DataFrame:
        """row_id, features, list: the first lists of each query, or, given (row_id, reach), all others within reach."""
        queries = queries.select("row_id", F.col("features").cast("array<double>").alias("features"))
        if reach is not None:
            queries = queries.join(reach, "row_id").select("row_id", "features", "reach")
        pivots, count, inner, outer, k, slack = self.pivots, self.count, self.inner, self.outer, self.k, self.slack

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 1024):
                    batch = whole.slice(a, 1024)
                    d = distances(matrix(batch.column(1)), pivots)
                    d[:, count == 0] = np.inf
                    order = np.argsort(d, 1, kind="stable")
                    held = np.cumsum(count[order], 1)
                    first = np.zeros(d.shape, bool)
                    # lists in order of their pivots, until they hold k rows
                    np.put_along_axis(first, order, np.hstack((np.ones((len(d), 1), bool), held[:, :-1] < k)), 1)
                    first &= count > 0
                    if batch.num_columns == 3:
                        low = np.maximum(np.maximum(d - outer, inner - d), 0)
                        first = (low <= batch.column(2).to_numpy()[:, None] + slack) & ~first & (count > 0)
                    q, j = np.nonzero(first)
                    part = batch.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(j.astype(np.int64))], ["row_id", "features", "list"])

        return queries.mapInArrow(choose, "row_id long, features array<double>, list long")

    def _meet(self, visits: DataFrame, block: Block) -> DataFrame:
        held = {r["list"]: r["count"] for r in visits.groupBy("list").count().collect()}  # a row a pivot
        parts = lambda n: F.array(*(F.lit(max(1, -(-int(x) // LIST_ROWS))).cast("long") for x in n))
        of = lambda n: F.get(parts(n), F.col("list").cast("int"))
        asked = [held.get(i, 0) for i in range(len(self.count))]
        number, every = lambda n: F.pmod(F.xxhash64("row_id"), of(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), of(n) - 1))
        left = visits.withColumn("part", number(asked)).withColumn("block", every(self.count))
        right = self.lists.where(F.col("list").isin(list(held))).withColumn("block", number(self.count)).withColumn("part", every(asked))
        right = right.select(*(F.col(c).alias(f"fit_{c}") for c in ("list", "part", "block", "row_id", "features")))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"row_id": pa.array([], pa.int64()), "nbr_id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
            ids, x, fit_ids, y = a.column("row_id").to_numpy(), matrix(a.column("features")), b.column("fit_row_id").to_numpy(), matrix(b.column("fit_features"))
            return pa.Table.from_batches([block(ids[i : i + TILE], x[i : i + TILE], fit_ids, y, None) for i in range(0, len(ids), TILE)])

        return left.groupBy("list", "part", "block").cogroup(right.groupBy("fit_list", "fit_part", "fit_block")).applyInArrow(meet, _FOUND)

    def search(self, queries: DataFrame, block: Block, k: int) -> DataFrame:
        near = cut(self._meet(cut(self.visits(queries, None), "visits"), block), "near")
        kth = near.withColumn("rank", _by_rank([])).where(F.col("rank") <= k).groupBy("row_id").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
        reach = queries.select("row_id").join(kth, "row_id", "left").select("row_id", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("reach"))
        return near.union(self._meet(cut(self.visits(queries, reach), "visits"), block))


def list_visits(queries: DataFrame, fit: DataFrame, k: int) -> DataFrame:
    """lists, queries, visited, skipped: what pruning spares a search of a fit set too large to broadcast; the visits are
    those of a search whose k-th distances are known."""
    join = _PrunedJoin(fit, fit.count(), k)
    far = knn(queries, fit, k).groupBy("row_id").agg(F.max("dist").alias("reach"))
    visited = join.visits(queries, None).union(join.visits(queries, far)).agg(F.count("*").alias("visited"))
    lists = int((join.count > 0).sum())
    return visited.crossJoin(queries.agg(F.count("*").alias("queries"))).select(F.lit(lists).alias("lists"), "queries", "visited", (F.col("queries") * lists - F.col("visited")).alias("skipped"))


def k_distance(points: DataFrame, k: int = 4) -> DataFrame:
    """row_id, dist: the distance to the k-th nearest other row."""
    return knn(points, points, k, exclude_self=True).where(F.col("rank") == k).select("row_id", "dist")


def k_distance_curve(points: DataFrame, k: int = 4) -> DataFrame:
    """position (from 0), dist: the k-th neighbour distances in ascending order."""
    return numbered(k_distance(points, k), "dist", "row_id").select("position", "dist")


def pick_eps(points: DataFrame, k: int = 5, quantile: float = 0.95) -> float | None:
    return k_distance(points, k).agg(F.percentile("dist", quantile)).first()[0]


def majority_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id, label: the most frequent label of a row's neighbours, the smallest of equally frequent ones."""
    named = neighbours.join(labels.select(F.col("row_id").alias("nbr_id"), "label"), "nbr_id")
    counted = named.groupBy("row_id", "label").agg(F.count("*").alias("n"))
    return counted.groupBy("row_id").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"))


def propagate(points: DataFrame, fitted: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Labels of all points by the vote of their k nearest rows of a labelled subsample."""
    return majority_vote(knn(points, fitted, k), labels)


def assign_noise_to_nearest(points: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """labels with each noise row given the vote of its k nearest rows that aren't noise; all kept if there are none."""
    clean = points.join(labels.where("label <> -1").select("row_id"), "row_id", "left_semi")
    noise = points.join(labels.where("label = -1").select("row_id"), "row_id", "left_semi")
    voted = majority_vote(knn(noise, clean, k), labels).withColumnRenamed("label", "voted")
    return labels.join(voted, "row_id", "left").select("row_id", F.coalesce("voted", "label").cast("int").alias("label"))


def noise_as_own_cluster(labels: DataFrame) -> DataFrame:
    """All noise rows as one new cluster, after the largest label."""
    top = labels.agg(F.max("label").alias("top"))
    return labels.join(F.broadcast(top)).select("row_id", F.when(F.col("label") == -1, F.col("top") + 1).otherwise(F.col("label")).cast("int").alias("label"))


def within(points: DataFrame, eps: float) -> DataFrame:
    """row_id, nbr_id of all pairs at most eps apart, each row with itself among them."""

    def block(ids, x, fit_ids, y, _):
        d = distances(x, y, ids[:, None] == fit_ids[None, :])
        qi, fi = np.nonzero(d <= eps)
        return pa.RecordBatch.from_arrays([pa.array(ids[qi]), pa.array(fit_ids[fi])], ["row_id", "nbr_id"])

    return block_join(points, points, block, "row_id long, nbr_id long")
