"""Hierarchies on the given embeddings against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrum.operators import density, hierarchical, metrics, pairwise, stability
from clustrum.plans import queries as q


@pytest.fixture(scope="module")
def embedded(spark, tables):
    rows = q.points(spark, tables).orderBy("row_id").collect()
    return [r["row_id"] for r in rows], np.array([r["features"] for r in rows], float)


def plain_merges(x, linkage):
    """(height, members) of each merge, with the distance of two clusters computed from their members' own each time."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = {i: frozenset([i]) for i in range(len(x))}
    # of two clusters: the sum, the largest and the smallest distance of their members; of one: its mean
    held = {"average": d.copy(), "complete": d.copy(), "single": d.copy()}.get(linkage)
    mean, size, alive, out = x.copy(), np.ones(len(x)), np.ones(len(x), bool), []
    for _ in range(len(x) - 1):
        if linkage == "ward":
            gap = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2)) if not out else gap  # noqa: F821
            now = gap * np.sqrt(2 * size[:, None] * size[None] / (size[:, None] + size[None]))
        else:
            now = held / (size[:, None] * size[None]) if linkage == "average" else held.copy()
        now[~alive] = np.inf
        now[:, ~alive] = np.inf
        np.fill_diagonal(now, np.inf)
        a, b = divmod(int(now.argmin()), len(x))
        groups[a] = groups[a] | groups.pop(b)
        out.append((float(now[a, b]), groups[a]))
        if linkage == "ward":
            mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            gap[a] = gap[:, a] = np.sqrt(((mean - mean[a]) ** 2).sum(1))
        else:
            held[a] = {"average": np.add, "complete": np.maximum, "single": np.minimum}[linkage](held[a], held[b])
            held[:, a] = held[a]
        size[a] += size[b]
        alive[b] = False
    return out


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_dendrogram_and_its_cuts(spark, embedded, linkage):
    ids, x = embedded
    points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id long, features array<double>")
    want = plain_merges(x, linkage)
    members, got = {i: frozenset([i]) for i in range(len(x))}, []
    for r in hierarchical.dendrogram(points, linkage).orderBy("step").collect():
        members[len(x) + r["step"]] = members[r["left"]] | members[r["right"]]
        assert r["size"] == len(members[len(x) + r["step"]])
        got.append((r["height"], members[len(x) + r["step"]]))
    assert np.allclose([h for h, _ in got], [h for h, _ in want], atol=1e-9) and {m for _, m in got} == {m for _, m in want}
    left = {frozenset([i]) for i in range(len(x))}
    for _, m in want[: len(x) - 4]:
        left = {g for g in left if not g <= m} | {m}
    cut = {}
    for r in hierarchical.agglomerative(4, linkage)(points).collect():
        cut.setdefault(r["label"], set()).add(ids.index(r["row_id"]))
    assert {frozenset(v) for v in cut.values()} == left and [min(cut[k]) for k in sorted(cut)] == sorted(min(v) for v in cut.values())


def test_ward_in_rounds_is_the_chain(spark, embedded):
    """Mutually nearest clusters merged round by round: the tree and the labels that the chain finds."""
    ids, x = embedded
    ids, x = ids[:160], np.vstack([x[:158, :6], x[:2, :6]])  # two rows stand twice
    points = spark.createDataFrame([(i * 3 - 7, v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id long, features array<double>")
    trees = []
    for limit in (10_000, 5):
        rows = hierarchical.dendrogram(points, "ward", limit).orderBy("step").collect()
        members = {i: frozenset([i]) for i in range(len(x))}
        for r in rows:
            members[len(x) + r["step"]] = members[r["left"]] | members[r["right"]]
            assert r["size"] == len(members[len(x) + r["step"]])
        trees.append(({m for k, m in members.items() if k >= len(x)}, [r["height"] for r in rows]))
    assert trees[0][0] == trees[1][0] and np.allclose(trees[0][1], trees[1][1], atol=1e-7)
    labels = [{r["row_id"]: r["label"] for r in hierarchical.agglomerative(4, "ward", limit)(points).collect()} for limit in (10_000, 5)]
    assert labels[0] == labels[1]
    assert hierarchical.ward_merges(points.limit(1)).count() == hierarchical.ward_merges(points.limit(0)).count() == 0


def plain_hdbscan(ids, x, size, samples):
    """Excess of mass from the top: the heaviest edge of a cluster's tree is taken out again and again."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, samples - 1]
    w = np.round(np.maximum(np.maximum(d, core[:, None]), core[None]), 12)
    edges, name = [], list(range(len(x)))
    for h, a, b in sorted((w[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        if name[a] != name[b]:
            old, new = name[b], name[a]
            name = [new if v == old else v for v in name]
            edges.append((h, a, b))
    clusters = []  # birth, points that leave with their lambda, children

    def side(start, own):
        seen, todo = {start}, [start]
        near: dict = {}
        for _, a, b in own:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        while todo:
            for v in near.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    def grow(points, own, birth):
        me = len(clusters)
        clusters.append((birth, [], []))
        while True:
            if not own:
                clusters[me][1].extend((p, np.inf) for p in points)
                return me
            h, a, b = own[-1]
            own, lam = own[:-1], 1 / h if h > 0 else np.inf
            left = side(a, own)
            right = points - left
            big = [s for s in (left, right) if len(s) >= size]
            inner = lambda s: [e for e in own if e[1] in s]  # noqa: E731, B023
            if len(big) == 2:
                clusters[me][2].extend(grow(s, inner(s), lam) for s in big)
                return me
            for s in (left, right):
                if len(s) < size:
                    clusters[me][1].extend((p, lam) for p in s)
            if not big:
                return me
            points, own = big[0], inner(big[0])

    grow(set(range(len(x))), edges, 0.0)
    every = lambda c: {p for p, _ in clusters[c][1]} | set().union(*(every(k) for k in clusters[c][2]))
    cap = max(1 / h for h, _, _ in edges if h > 0)
    mass = lambda c: sum(min(l_, cap) - clusters[c][0] for _, l_ in clusters[c][1]) + sum(len(every(k)) * (min(clusters[k][0], cap) - clusters[c][0]) for k in clusters[c][2])

    def best(c):
        below = [best(k) for k in clusters[c][2]]
        total, chosen = sum(b[0] for b in below), [s for b in below for s in b[1]]
        return (mass(c), [every(c)]) if c and (not below or mass(c) >= total) else (total, chosen)

    label = dict.fromkeys(ids, -1)
    for k, s in enumerate(sorted(best(0)[1], key=lambda s: min(ids[p] for p in s))):
        label |= {ids[p]: k for p in s}
    return label


@pytest.mark.parametrize(("size", "samples"), [(5, 5), (10, 3)])
def test_hdbscan(spark, embedded, size, samples):
    ids, x = embedded
    rng = np.random.default_rng(size)
    for y in (x[:250], np.vstack([rng.normal(c, s, (40, 3)) for c, s in ((0, 0.3), (2, 0.5), (9, 1.0))])):
        own = ids[: len(y)]
        points = spark.createDataFrame([(i, v.tolist()) for i, v in zip(own, y, strict=True)], "row_id long, features array<double>")
        assert {r["row_id"]: r["label"] for r in density.hdbscan(size, samples)(points).collect()} == plain_hdbscan(own, y, size, samples)


@pytest.mark.parametrize("k", [2, 3, 30])
def test_consensus_without_a_set_is_the_refit(spark, k):
    """Agreement taken off the whole gives what the remaining sets give by themselves, noise and few tuples included."""
    rng = np.random.default_rng(k)
    truth = rng.integers(0, 3, 90)
    noisy = [np.where(rng.random(90) < 0.15, rng.integers(0, 3, 90), truth) for _ in range(3)]
    noisy.append(np.where(rng.random(90) < 0.1, -1, truth % 2))
    sets = [spark.createDataFrame([(i * 2, int(v)) for i, v in enumerate(x)], "row_id long, label int") for x in noisy]
    whole = hierarchical._Tuples(sets, "average")
    for i in range(4):
        want = {r["row_id"]: r["label"] for r in hierarchical.consensus(sets[:i] + sets[i + 1 :], k).collect()}
        got = {r["row_id"]: r["label"] for r in whole.consensus(k, i).collect()}
        same = {}
        assert len(want) == len(got) == 90 and all(same.setdefault(want[r], got[r]) == got[r] for r in want) and len(set(same.values())) == len(same)


def test_ward_of_copies(spark, monkeypatch):
    """Copies merge first at height 0, whatever their rounding; rounds on the cluster and on the driver make one tree."""
    rng = np.random.default_rng(3)
    x = np.tile(rng.normal(size=(30, 6)) + 10.1, (4, 1))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>").repartition(3)
    trees = []
    for last in (1000, 5):
        monkeypatch.setattr(hierarchical, "LAST_CLUSTERS", last)
        trees.append([tuple(r) for r in hierarchical.ward_merges(points).orderBy("step").collect()])
    assert trees[0] == trees[1] and len(trees[0]) == 119 and [t[3] for t in trees[0][:90]] == [0.0] * 90 and trees[0][-1][4] == 120
    want = hierarchical.chain_linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), "ward")
    assert np.allclose([t[3] for t in trees[0]], [h for _, _, h, _ in want], atol=1e-7)
    labels = {r["row_id"]: r["label"] for r in hierarchical.agglomerative(30, "ward", 50)(points).collect()}
    assert labels == {i: i % 30 for i in range(120)}


@pytest.mark.parametrize("kind", ["copies", "grid"])
def test_spanning_tree_of_copies_and_ties(spark, monkeypatch, kind):
    """Copies and equal weights: the rounds find the tree that the driver grows, with n - 1 edges."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3)) + (rng.integers(0, 3, 120) * 30)[:, None] + 1000.1
    x = np.tile(x[:40], (3, 1)) if kind == "copies" else np.round(x)
    points = spark.createDataFrame([(3 * i - 50, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    monkeypatch.setattr(density, "LISTED", 2)
    far, near = (sorted(map(tuple, density.minimum_spanning_tree(points, 4, n).collect())) for n in (0, 1000))
    assert far == near and len(far) == 119


def test_co_association_keeps_no_pairs(spark, monkeypatch):
    """Pairs come from tuples, whatever the lists that rows stand in; noisy rows of equal labels share a tuple."""
    monkeypatch.setattr(hierarchical, "CLASS_ROWS", 3)
    own = [[i % 3 for i in range(40)], [-1 if i % 5 == 0 else i % 2 for i in range(40)]]
    sets = [spark.createDataFrame(list(enumerate(x)), "row_id long, label int") for x in own]
    want = {(i, j): s for i in range(40) for j in range(40) if (s := 1.0 if i == j else sum(x[i] == x[j] != -1 for x in own) / 2)}
    got = [tuple(r) for r in hierarchical.co_association(sets).collect()]
    assert len(got) == len(want) and {(i, j): s for i, j, s in got} == want
    assert hierarchical.co_association_tuples(sets)[0].select("t").distinct().count() == 9


def test_near_rows_in_small_steps(monkeypatch):
    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(50, 3))
    table = lambda p: pa.table({f"{p}row_id": pa.array(range(50)), f"{p}features": pa.array(list(x), pa.list_(pa.float64()))})
    seen, plain = [], density.distances
    monkeypatch.setattr(density, "NEAR_ROWS", 7)
    monkeypatch.setattr(density, "distances", lambda a, b, same: seen.append(len(a)) or plain(a, b, same))
    near = density._near(table(""), table("r_"), 1.0)[2]
    assert max(seen) == 7 and (near == (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 1.0)).all()


def test_dbscan_meets_large_parts_in_tiles(spark, monkeypatch):
    """A crowded cell is few parts, so its rows are dealt few times; tiles of a part hang together as the whole part does."""
    from test_engine import brute_dbscan

    monkeypatch.setattr(density, "TILE_ROWS", 7)
    dealt, plain = [], density._meetings
    monkeypatch.setattr(density, "_meetings", lambda placed, sizes, *more: dealt.append(sizes.collect()) or plain(placed, sizes, *more))
    rng = np.random.default_rng(4)
    x = np.vstack([np.stack([np.arange(30) * 0.9, np.zeros(30)], 1), rng.normal(9, 0.4, (30, 2)), rng.uniform(-5, 30, (60, 2))])[rng.permutation(120)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    for eps in (1.0, 40.0):
        got = {r["row_id"]: r["label"] for r in density.dbscan(eps, 3)(df).collect()}
        assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, 3)
    monkeypatch.setattr(density, "TILE_ROWS", 4096)
    wide = spark.range(5_000).select(F.col("id").alias("row_id"), F.array(F.rand(1), F.rand(2)).alias("features"))
    density.dbscan(5.0, 3)(wide)
    assert max(r["parts"] for r in dealt[-1]) == 1 and max(r["own_parts"] for r in dealt[-1]) <= 2 * spark.sparkContext.defaultParallelism


def test_scan_scores_all_k_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.2, (20, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    passes, plain = [], metrics._scored_kinds
    monkeypatch.setattr(metrics, "_scored_kinds", lambda *a: passes.append(1) or plain(*a))
    model = lambda k: lambda p: p.select("row_id", F.least(F.floor(F.col("row_id") / 20), F.lit(k - 1)).cast("int").alias("label"))
    scan = {r["k"]: r for r in stability.scan_clusters(model, points, [2, 3, 1], n_iter=1, bic=lambda k, p: float(k)).collect()}
    assert len(passes) == 1 and scan[1]["silhouette"] is None
    for k in (2, 3):
        alone = metrics.internal_metrics(points, model(k)(points)).first()
        assert all(abs(scan[k][c] - alone[c]) < 1e-9 for c in ("silhouette", "davies_bouldin", "calinski_harabasz"))
        assert (scan[k]["bic"], scan[k]["stability_mean"]) == (k, 1.0)


@pytest.mark.parametrize("exclude", [False, True])
def test_nearest_over_tiles(monkeypatch, exclude):
    """Tiles, a falling bound and queries that are halved where many rows tie: all that may be among the k nearest is found."""
    monkeypatch.setattr(pairwise, "TILE", 16)
    monkeypatch.setattr(pairwise, "PAIRS_AT_ONCE", 300)
    rng = np.random.default_rng(3)
    y = np.vstack([rng.normal(size=(150, 4)) * np.linspace(9, 0.1, 150)[:, None], np.full((90, 4), 0.5)])  # each nearer than those before
    ids = rng.permutation(len(y))
    for k in (1, 5, 20, len(y)):
        q, f = pairwise.nearest(ids[140:200], y[140:200], ids, y, k, exclude)
        found = set(zip(q.tolist(), f.tolist(), strict=True))
        d = np.sqrt(((y[140:200, None] - y[None]) ** 2).sum(2))
        d[np.arange(60), np.arange(140, 200)] = np.inf if exclude else 0
        kth = np.sort(d, 1)[:, k - 1]
        assert {(i, j) for i, j in zip(*np.nonzero((d <= kth[:, None]) & np.isfinite(d)), strict=True)} <= found
        assert len(found) == len(q) and all(d[i, j] <= kth[i] + 1e-3 for i, j in found)


def test_lists_are_left_where_they_prune_nothing(spark, monkeypatch):
    """Rows of no clusters would visit all lists: they meet in blocks. Clustered rows are searched in lists; both exactly."""
    rng = np.random.default_rng(8)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    wide, tight = frame(rng.normal(size=(200, 40))), frame(np.vstack([rng.normal(50 * i, 0.1, (20, 2)) for i in range(10)]))
    rows = lambda p: sorted((r["row_id"], r["rank"], r["nbr_id"]) for r in pairwise.knn(p, p, 3).collect())
    want = [rows(p) for p in (wide, tight)]
    for name, value in (("BROADCAST_BYTES", 0), ("LIST_ROWS", 20), ("PIVOTS", 10)):
        monkeypatch.setattr(pairwise, name, value)
    used, plain = [], pairwise._PrunedJoin.search
    monkeypatch.setattr(pairwise._PrunedJoin, "search", lambda *a: used.append(1) or plain(*a))
    assert rows(wide) == want[0] and not used
    assert rows(tight) == want[1] and used


def test_ward_search_over_tiles():
    """A cluster's nearest is that of a plain search with its ties, whichever tiles hold it; clusters are prepared once."""
    rng = np.random.default_rng(1)
    x = np.hstack((rng.integers(0, 4, (1300, 5)).astype(float), rng.integers(1, 5, (1300, 1)).astype(float)))
    ids = rng.permutation(1300)
    assert hierarchical.turned_means(x)[0] is hierarchical.turned_means(x)[0]
    want = []
    for k in range(40):
        d = np.round(np.sqrt(((x[k, :-1] - x[:, :-1]) ** 2).sum(1)) * np.sqrt(2 * x[k, -1] * x[:, -1] / (x[k, -1] + x[:, -1])), 12)
        low, _, _, nbr = min((d[j], min(ids[k], i), max(ids[k], i), i) for j, i in enumerate(ids) if i != ids[k])
        want.append((ids[k], nbr, low))
    got = hierarchical._ward_block(ids[:40], x[:40], ids, x, None)
    assert list(zip(*(got.column(i).to_pylist() for i in range(3)), strict=True)) == want
