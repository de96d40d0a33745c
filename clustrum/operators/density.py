"""Density clusterers: DBSCAN and HDBSCAN."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.scratch import cut, numbered, ship

from .dimred import fit_pca
from .graph import components
from .pairwise import BOX_ROWS, TILE, apart, block_join, distances, knn, matrix, tiled
from .stability import FitPredict

#: Principal axes of the plane that DBSCAN's cells divide, a cell's side in radii, and rows that meet at once: each row of a
#: crowded cell is dealt once for every part that it meets, so parts are as large as a task can hold.
AXES, CELL_SIDE, PART_ROWS = 2, 2.0, 65_536
#: Rows of either side of a tile of meeting parts, and rows of a tile whose distances are held at a time.
TILE_ROWS, NEAR_ROWS = 4096, 256
#: Rows whose merge tree is condensed on the driver, at most.
TREE_ROWS = 2_000_000
#: Rows whose tree is grown on the driver, at most (a row of distances at a time).
LOCAL_ROWS = 2_000
#: Neighbours that a row keeps besides those of its core distance; the share of components that must know their lightest edge
#: by such lists, lest rows are searched.
LISTED, SETTLED = 10, 0.1


def cells(points: DataFrame, eps: float, axes: int = AXES) -> DataFrame:
    """row_id, features, cell, own: each row in the cell that holds it, and in the others of which a row may be eps away.

    Cells are squares of CELL_SIDE * eps in the plane of the first principal axes; there, no distance is larger than the
    true one, so all rows within eps of a cell's own rows are in the cell.
    """
    pca = fit_pca(points)
    turn, mean, side = pca.axes[:, : min(axes, len(pca.mean))], pca.mean, CELL_SIDE * eps if eps > 0 else 1.0
    reach = eps * (1 + 1e-9) + 1e-12

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = (matrix(batch.column(1)) - mean) @ turn
            home = np.floor(z / side).astype(np.int64)
            for step in product((-1, 0, 1), repeat=z.shape[1]):
                cell = home + np.array(step)
                gap = np.maximum(np.maximum(cell * side - z, z - (cell + 1) * side), 0)
                near = np.flatnonzero((gap * gap).sum(1) <= reach * reach)
                if len(near):
                    part = batch.take(pa.array(near))
                    own = np.full(len(near), not any(step))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(cell[near]), pa.list_(pa.int64())), pa.array(own)], ["row_id", "features", "cell", "own"])

    return points.select("row_id", F.col("features").cast("array<double>").alias("features")).mapInArrow(place, "row_id long, features array<double>, cell array<long>, own boolean")


def _meetings(placed: DataFrame, sizes: DataFrame, meet: Callable, schema: str, extra: list[str]) -> DataFrame:
    """meet(own part, any part) for each part of a cell's own rows and each part of all its rows, PART_ROWS rows each."""
    columns = ["row_id", "features", *extra]
    number = lambda parts: F.pmod(F.xxhash64("row_id"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    dealt = placed.join(sizes, "cell")
    left = dealt.where("own").withColumn("i", number("own_parts")).withColumn("j", every("parts")).select("cell", "i", "j", *columns)
    right = dealt.withColumn("j", number("parts")).withColumn("i", every("own_parts")).select(*(F.col(c).alias(f"r_{c}") for c in ("cell", "i", "j", *columns)))
    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("r_cell", "r_i", "r_j")).applyInArrow(meet, schema)


def _near(a: pa.Table, b: pa.Table, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own ids, other ids, which are within eps)."""
    ids, others = a.column("row_id").to_numpy(), b.column("r_row_id").to_numpy()
    if not len(ids) or not len(others):
        return ids, others, np.zeros((len(ids), len(others)), bool)
    x, y = matrix(a.column("features")), matrix(b.column("r_features"))
    near = np.empty((len(ids), len(others)), bool)
    # a few rows at a time: distances take eight times the memory of what is kept
    for i in range(0, len(ids), NEAR_ROWS):
        part = ids[i : i + NEAR_ROWS]
        near[i : i + NEAR_ROWS] = distances(x[i : i + NEAR_ROWS], y, part[:, None] == others[None, :]) <= eps
    return ids, others, near


def _tiles(a: pa.Table, b: pa.Table, eps: float) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """(own rows, other rows, which are within eps) tile by tile: two whole parts are never held against each other."""
    for i in range(0, a.num_rows, TILE_ROWS):
        for j in range(0, b.num_rows, TILE_ROWS):
            near = _near(a.slice(i, TILE_ROWS), b.slice(j, TILE_ROWS), eps)[2]
            yield slice(i, i + TILE_ROWS), slice(j, j + TILE_ROWS), near


def _linked(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a graph between rows and columns: the number of each row's and of each column's, -1 without edges."""
    row, col, made = np.full(near.shape[0], -1), np.full(near.shape[1], -1), 0
    for i in np.flatnonzero(near.any(1)).tolist():
        if row[i] >= 0:
            continue
        front = np.array([i])
        while len(front):
            row[front] = made
            reached = np.flatnonzero(near[front].any(0) & (col < 0))
            col[reached] = made
            front = np.flatnonzero(near[:, reached].any(1) & (row < 0)) if len(reached) else reached
        made += 1
    return row, col


def dbscan(eps: float, min_samples: int = 5) -> FitPredict:
    """Core rows have min_samples rows within eps, themselves included; clusters are their components. Other rows within
    eps of a core row join the cluster of the smallest label among those; the rest is -1. Clusters are numbered by their
    smallest row_id among core rows.

    Rows meet in the cells of cells() only, a crowded one in parts. A meeting sends on how many neighbours its rows have,
    then how its core rows hang together: a number of rows in proportion to its own, never their pairs.
    """

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        n = np.zeros(a.num_rows, np.int64)
        for p, _, near in _tiles(a, b, eps):
            n[p] += near.sum(1)
        return pa.table({"row_id": a.column("row_id"), "n": pa.array(n)})

    def hang(a: pa.Table, b: pa.Table) -> pa.Table:
        # kind 0: u and v are core rows of one cluster; kind 1: u is no core row, but near core row v
        core = a.column("core").to_numpy()
        rim, a, b = a.filter(pa.array(~core)), a.filter(pa.array(core)), b.filter(b.column("r_core"))
        ids, others, rest = a.column("row_id").to_numpy(), b.column("r_row_id").to_numpy(), rim.column("row_id").to_numpy()
        # the component of each core row on either side; tiles name new ones, and those that a later tile joins are one
        row, col, parent = np.full(len(ids), -1), np.full(len(others), -1), []

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for p, q, near in _tiles(a, b, eps):
            here, there = _linked(near)
            made = len(parent)
            parent.extend(range(made, made + max(here.max(initial=-1), there.max(initial=-1)) + 1))
            for known, new in ((row[p], here), (col[q], there)):
                both = (known >= 0) & (new >= 0)
                for c, t in np.unique(np.stack((known[both], new[both] + made), 1), axis=0).tolist():
                    parent[max(root(c), root(t))] = min(root(c), root(t))
                fresh = (known < 0) & (new >= 0)
                known[fresh] = new[fresh] + made
        final = np.array([root(c) for c in range(len(parent))], np.int64)
        row, col = (np.where(c >= 0, final[c], -1) if len(final) else c for c in (row, col))
        least = np.full(len(final), np.iinfo(np.int64).max)
        np.minimum.at(least, row[row >= 0], ids[row >= 0])
        np.minimum.at(least, col[col >= 0], others[col >= 0])
        u, v = np.r_[least[row[row >= 0]], least[col[col >= 0]]], np.r_[ids[row >= 0], others[col >= 0]]
        name = np.where(col >= 0, least[col], others) if len(final) else others
        border = [np.zeros((0, 2), np.int64)]
        for p, q, near in _tiles(rim, b, eps):
            i, j = np.nonzero(near)
            border.append(np.unique(np.stack((rest[p][i], name[q][j]), 1), axis=0))
        border = np.unique(np.concatenate(border), axis=0)
        kind = np.r_[np.zeros(len(u), np.int32), np.ones(len(border), np.int32)]
        return pa.table({"kind": pa.array(kind), "u": pa.array(np.r_[u, border[:, 0]].astype(np.int64)), "v": pa.array(np.r_[v, border[:, 1]].astype(np.int64))})

    def fit_predict(points: DataFrame) -> DataFrame:
        ship(points.sparkSession)
        if points.isEmpty():
            return points.select("row_id", F.lit(-1).alias("label"))
        placed = cut(cells(points, eps), "cells")
        parts = lambda n: F.greatest(F.ceil(n / PART_ROWS), F.lit(1))
        sizes = placed.groupBy("cell").agg(parts(F.count_if("own")).alias("own_parts"), parts(F.count("*")).alias("parts"), F.count_if("own").alias("n")).where("n > 0")
        # where few cells hold all rows their own rows are dealt further, so that all cores take part
        met = sizes.agg(F.sum(F.col("own_parts") * F.col("parts")).alias("m")).first()["m"]
        more = -(-2 * points.sparkSession.sparkContext.defaultParallelism // met)
        sizes = sizes.withColumn("own_parts", F.least(F.col("own_parts") * more, F.greatest("own_parts", F.ceil(F.col("n") / TILE_ROWS)))).drop("n")
        sizes = cut(sizes, "cell-sizes")
        counted = _meetings(placed, sizes, count, "row_id long, n long", [])
        core = cut(counted.groupBy("row_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("row_id"), "core")
        told = placed.join(core.withColumn("core", F.lit(True)), "row_id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
        found = cut(_meetings(told, sizes, hang, "kind int, u long, v long", ["core"]).distinct(), "links")
        joined = components(core, found.where("kind = 0").select("u", "v"))
        names = numbered(joined.select("component").distinct(), "component", name="label").withColumn("label", F.col("label").cast("int"))
        named = cut(joined.join(names, "component").select("row_id", "label"), "named")
        border = found.where("kind = 1").join(named.withColumnRenamed("row_id", "v"), "v").groupBy(F.col("u").alias("row_id")).agg(F.min("label").alias("label"))
        return points.select("row_id").join(named.union(border), "row_id", "left").select("row_id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))

    return fit_predict


def _prim(ids: np.ndarray, x: np.ndarray, core: np.ndarray) -> list[tuple[int, int, float]]:
    """The same tree of few rows, grown from one row; ties go to the smaller pair of ids here too."""
    n = len(ids)
    outside = np.ones(n, bool)
    weight, low, high = np.full(n, np.inf), np.full(n, -1), np.full(n, -1)
    at, edges = 0, []
    for _ in range(n - 1):
        outside[at] = False
        d = _reach(x, x[at : at + 1], core, core[at])
        a, b = np.minimum(ids, ids[at]), np.maximum(ids, ids[at])
        better = outside & ((d < weight) | ((d == weight) & ((a < low) | ((a == low) & (b < high)))))
        weight[better], low[better], high[better] = d[better], a[better], b[better]
        left = np.flatnonzero(outside)
        at = left[np.lexsort((high[left], low[left], weight[left]))[0]]
        edges.append((int(low[at]), int(high[at]), float(weight[at])))
    return edges


def _reach(x: np.ndarray, y: np.ndarray, core: np.ndarray, cores: np.ndarray) -> np.ndarray:
    """Mutual reachability of rows of equal place, the same from both sides."""
    return np.round(np.maximum(np.maximum(apart(x, y), core), cores), 12)


def _lightest(w: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the lightest edge (w, smaller id, larger id) of each value of `of`."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w, of))
    return order[np.flatnonzero(np.diff(of[order], prepend=-1))]


_OF: list = []


def _lightest_out(ids: np.ndarray, x: np.ndarray, fit_ids: np.ndarray, y: np.ndarray, cu: np.ndarray, parts: Callable, best: np.ndarray, key: object) -> pa.RecordBatch:
    """The lightest edge from rows of each component (cu) to fit rows of others, if it is no heavier than best; rows end in their
    core distance, parts() names the components of fit rows and holds for one key.

    A tile of fit rows is met by rows that may have a lighter edge into it than their component has: it isn't their own
    component's, and neither its box nor its least core distance is beyond that edge.
    """
    fit = tiled(y, -1)
    if not _OF or _OF[0] is not y or _OF[1] is not key:
        cv, core = parts(fit.order), y[fit.order, -1]
        low, high = (f.reduceat(cv, fit.starts) for f in (np.minimum, np.maximum))
        _OF[:] = [y, key, cv, core * core, np.where(low == high, low, -1), np.minimum.reduceat(core * core, fit.starts)]
    _, _, cv, core2, pure, least2 = _OF
    x0, moved, a, off, kind = fit.asked(x[:, :-1], True)
    table, own2, off = fit.table(kind), x[:, -1] ** 2, 2 * off
    name, c = np.unique(cu, return_inverse=True)
    top = best[name]  # the lightest weight of each component so far
    low = np.maximum(np.maximum(fit.gaps(x0), least2[None, :]), own2[:, None])
    low[pure[None, :] == cu[:, None]] = np.inf
    found: list[tuple] = []

    def reach() -> np.ndarray:
        # the square that no lighter edge exceeds, rounding included
        w = top[c]
        return np.where(np.isfinite(w), (w + 1e-11) ** 2 + off, np.finfo(float).max)

    # tiles in the order of how near they may be to some row: the first ones lower the bounds
    for j in np.argsort(low.min(0), kind="stable").tolist():
        bound = reach()
        some = np.flatnonzero(low[:, j] <= bound)
        if not len(some):
            continue
        t = slice(j * TILE, (j + 1) * TILE)
        g = moved[some] @ table[:, t]
        g += a[some, None].astype(kind)
        np.maximum(g, core2[t].astype(kind), out=g)
        np.maximum(g, own2[some, None].astype(kind), out=g)
        if pure[j] < 0:
            g[cv[t][None, :] == cu[some, None]] = np.inf
        low_here = np.full(len(name), np.inf)
        np.minimum.at(low_here, c[some], g.min(1) + off[some])
        at = np.flatnonzero(g <= np.minimum(bound[some], low_here[c[some]] + off[some])[:, None])
        if not len(at):
            continue
        q, f = some[at // g.shape[1]], at % g.shape[1] + j * TILE
        w = _reach(x[q, :-1], y[fit.order[f], :-1], x[q, -1], y[fit.order[f], -1])
        u, v = ids[q], fit_ids[fit.order[f]]
        keep = _lightest(w, u, v, c[q])
        keep = keep[w[keep] <= top[c[q[keep]]]]
        top[c[q[keep]]] = w[keep]
        found.append((cu[q[keep]], w[keep], np.minimum(u, v)[keep], np.maximum(u, v)[keep]))
    if not found:
        found = [(cu[:0], np.zeros(0), ids[:0], ids[:0])]
    cs, w, u, v = (np.concatenate([h[i] for h in found]) for i in range(4))
    at = _lightest(w, u, v, cs)
    return pa.RecordBatch.from_arrays([pa.array(cs[at]), pa.array(w[at]), pa.array(u[at]), pa.array(v[at])], ["c", "w", "u", "v"])


def _edges(points: DataFrame, min_samples: int) -> list[tuple[int, int, float]]:
    """The tree's edges by Boruvka rounds, for minimum_spanning_tree().

    Every row keeps the list of its LISTED nearest rows. Rows outside it are no lighter than the row's bound, so a component
    whose lightest listed edge is below the bounds of all its rows knows its lightest edge. Only where few components do,
    rows with a lower bound are searched block by block, but for those of the largest component, which others join anyway. The
    driver holds the edges and each row's component, which it sends out; a round returns at most an edge for each component
    and task.
    """
    spark = points.sparkSession
    plain = points.select("row_id", F.transform("features", lambda v: v.cast("double") + F.lit(0.0)).alias("features"))
    near = cut(knn(plain, plain, min_samples + LISTED), "near")
    core = cut(near.where(F.col("rank") <= min_samples).groupBy("row_id").agg(F.max("dist").alias("core")), "core")
    rows = cut(plain.join(core, "row_id").select("row_id", F.concat("features", F.array("core")).alias("features")), "reach")
    weight = F.round(F.greatest("dist", "core", "nbr_core"), 12)
    listed = near.join(core, "row_id").join(core.select(F.col("row_id").alias("nbr_id"), F.col("core").alias("nbr_core")), "nbr_id").groupBy("row_id").agg(
        F.collect_list("nbr_id").alias("nbrs"), F.collect_list(weight).alias("ws"), F.round(F.greatest(F.max("dist"), F.max("core")) - 1e-12, 12).alias("bound"), F.count("*").alias("n")
    )
    listed = cut(listed.repartition(2 * spark.sparkContext.defaultParallelism, "row_id"), "lists")
    ids = np.sort(rows.select("row_id").toPandas()["row_id"].to_numpy())
    n, of, tree = len(ids), np.arange(len(ids)), []
    whole = n <= min_samples + LISTED  # the lists hold all rows

    while (many := len(np.unique(of))) > 1:
        shared = spark.sparkContext.broadcast((ids, of))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, of = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, bound = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                size = np.diff(batch.column(1).offsets.to_numpy())
                u, v, w = np.repeat(own, size), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                a = of[np.searchsorted(ids, own)]
                cu, cv = np.repeat(a, size), of[np.searchsorted(ids, v)]
                out = np.flatnonzero(cu != cv)
                best = out[_lightest(w[out], u[out], v[out], cu[out])]
                # the least bound of each component, as an edge without an end
                low = _lightest(bound, own, own, a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[cu[best], a[low]]), pa.array(np.r_[w[best], bound[low]]), pa.array(np.r_[np.minimum(u, v)[best], np.full(len(low), -1)]), pa.array(np.r_[np.maximum(u, v)[best], np.full(len(low), -1)]), pa.array(np.r_[np.ones(len(best), bool), np.zeros(len(low), bool)])],
                    ["c", "w", "u", "v", "edge"],
                )

        seen = listed.select("row_id", "nbrs", "ws", "bound").mapInArrow(look, "c long, w double, u long, v long, edge boolean")
        got = seen.groupBy("c", "edge").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("c", "edge", "e.*").toPandas()
        edges, low = got[got["edge"]], got[~got["edge"]]
        best = np.full(n, np.inf)  # of each component
        best[edges["c"]] = edges["w"]
        bound = np.full(n, np.inf)
        if not whole:
            bound[low["c"]] = low["w"]
        edges = edges[best[edges["c"]] < bound[edges["c"]]]
        if len(edges) < many * SETTLED:
            sizes = np.bincount(of, minlength=n)
            open_ = (best >= bound) & (sizes > 0)
            if len(edges) or open_.sum() > 1:
                open_[sizes.argmax()] = False
            known = spark.sparkContext.broadcast((ids, of, best, open_))

            def wanted(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
                ids, of, best, open_ = known.value
                for batch in batches:
                    if batch.num_rows:
                        c = of[np.searchsorted(ids, batch.column(0).to_numpy())]
                        yield batch.filter(pa.array(open_[c] & (batch.column(1).to_numpy() <= best[c]))).select([0])

            def block(ids_, x, fit_ids, y, _, known=known):
                ids, of, best, _ = known.value
                return _lightest_out(ids_, x, fit_ids, y, of[np.searchsorted(ids, ids_)], lambda at: of[np.searchsorted(ids, fit_ids[at])], best, known)

            asked = cut(rows.join(listed.select("row_id", "bound").mapInArrow(wanted, "row_id long"), "row_id"), "asked")
            more = block_join(asked, rows, block, "c long, w double, u long, v long", step=BOX_ROWS).groupBy("c").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("c", "e.*").toPandas()
            both = pd.concat((got[got["edge"]][["c", "w", "u", "v"]], more))
            both = both.sort_values(["c", "w", "u", "v"]).drop_duplicates("c")
            edges = both[open_[both["c"]] | (best[both["c"]] < bound[both["c"]])]
        if not len(edges):
            raise ValueError("features must be finite")
        name = np.arange(n)

        def root(x: int, name=name) -> int:
            while name[x] != x:
                name[x] = name[name[x]]
                x = name[x]
            return x

        for u, v, w in edges[["u", "v", "w"]].drop_duplicates().sort_values(["w", "u", "v"]).itertuples(index=False):
            a, b = root(int(of[np.searchsorted(ids, u)])), root(int(of[np.searchsorted(ids, v)]))
            if a != b:
                name[max(a, b)] = min(a, b)
                tree.append((int(u), int(v), float(w)))
        while (name[name] != name).any():
            name[:] = name[name]
        of = name[of]
    return tree


def minimum_spanning_tree(points: DataFrame, min_samples: int, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """u, v, w: the tree of least mutual reachability; w = max(core u, core v, distance). Few rows are joined on the
    driver, more by Boruvka rounds, to the same tree.

    The core distance is that to the min_samples-th row, itself counted. Ties go to the smaller pair of ids, so no cycle can
    arise.
    """
    return points.sparkSession.createDataFrame(_tree(points, min_samples, local_rows), "u long, v long, w double")


def _tree(points: DataFrame, min_samples: int, local_rows: int = LOCAL_ROWS) -> list[tuple[int, int, float]]:
    if points.count() > local_rows:
        return _edges(points, min_samples)
    core = knn(points, points, min_samples).groupBy("row_id").agg(F.max("dist").alias("core"))
    got = points.select("row_id", "features").join(core, "row_id").orderBy("row_id").collect()
    return _prim(np.array([r["row_id"] for r in got], np.int64), np.array([r["features"] for r in got], float), np.array([r["core"] for r in got])) if got else []


def _condense(edges: list[tuple[int, int, float]], ids: np.ndarray, size: int) -> np.ndarray:
    """Labels from the sorted tree: condensed clusters of `size` rows at least, chosen by excess of mass."""
    n = len(ids)
    place = {v: i for i, v in enumerate(ids.tolist())}
    parent = list(range(2 * n - 1))
    left, right, height, count = [0] * (n - 1), [0] * (n - 1), [0.0] * (n - 1), [1] * n + [0] * (n - 1)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (u, v, w) in enumerate(edges):
        a, b = root(place[u]), root(place[v])
        left[i], right[i], height[i] = a, b, w
        parent[a] = parent[b] = n + i
        count[n + i] = count[a] + count[b]
    top = 2 * n - 2
    birth, above, children, gone = {0: 0.0}, {0: None}, {0: []}, {0: []}  # of condensed clusters

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += (left[y - n], right[y - n])
        return out

    todo, made, owner = [(top, 0)], 1, {}
    while todo:
        x, c = todo.pop()
        if x < n:
            gone[c].append((x, np.inf))
            continue
        a, b = left[x - n], right[x - n]
        lam = 1 / height[x - n] if height[x - n] > 0 else np.inf
        big = [y for y in (a, b) if count[y] >= size]
        if len(big) == 2:
            for y in sorted(big, key=lambda y: -count[y]):
                birth[made], above[made], children[made], gone[made] = lam, c, [], []
                children[c].append(made)
                owner[made] = lam
                todo.append((y, made))
                made += 1
        else:
            for y in (a, b):
                if y in big:
                    todo.append((y, c))
                else:
                    gone[c] += [(p, lam) for p in leaves(y)]
    inside: dict[int, int] = {}
    for c in sorted(birth, reverse=True):  # children have larger numbers
        inside[c] = len(gone[c]) + sum(inside[k] for k in children[c])
    cap = max([1 / h for h in height if h > 0], default=1.0)
    value = {}
    for c in birth:
        stay = sum(min(lam, cap) - birth[c] for _, lam in gone[c])
        value[c] = stay + sum(inside[k] * (min(birth[k], cap) - birth[c]) for k in children[c])
    chosen: dict[int, bool] = {}
    best: dict[int, float] = {}
    for c in sorted(birth, reverse=True):  # children have larger numbers
        below = sum(best[k] for k in children[c])
        if c != 0 and (not children[c] or value[c] >= below):
            chosen[c], best[c] = True, value[c]
        else:
            chosen[c], best[c] = False, below
    label = np.full(n, -1)
    done = 0
    stack = [(0, -1)]
    found = []
    while stack:
        c, name = stack.pop()
        if name < 0 and chosen[c]:
            name = done
            done += 1
        if name >= 0:
            found += [(p, name) for p, _ in gone[c]]
        stack += [(k, name) for k in children[c]]
    for p, name in found:
        label[p] = name
    first = np.full(done, np.iinfo(np.int64).max)
    np.minimum.at(first, label[label >= 0], ids[label >= 0])
    rank = np.empty(done, np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(done)
    return np.where(label >= 0, rank[np.maximum(label, 0)] if done else -1, -1)


def hdbscan(min_cluster_size: int = 50, min_samples: int | None = None) -> FitPredict:
    """Hierarchical density clusters, chosen by excess of mass; clusters are numbered by their smallest row_id.

    Distances stay distributed; the n - 1 edges of the tree are condensed on the driver, for up to TREE_ROWS rows.
    """

    def fit_predict(points: DataFrame) -> DataFrame:
        n = points.count()
        if n > TREE_ROWS:
            raise ValueError(f"the merge tree is condensed on the driver for at most {TREE_ROWS} rows; cluster a sample and propagate")
        edges = sorted(_tree(points, min(min_samples or min_cluster_size, n)), key=lambda e: (e[2], e[0], e[1]))
        ids = np.array([r["row_id"] for r in points.select("row_id").orderBy("row_id").collect()], np.int64)
        label = _condense(edges, ids, min_cluster_size) if len(ids) > 1 else np.full(len(ids), -1)
        return cut(points.sparkSession.createDataFrame(pd.DataFrame({"row_id": ids, "label": label}), "row_id long, label int"), "labels")

    return fit_predict
