import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clustrum.functions import profile
from clustrum.operators import density, dimred, gmm, hierarchical, kmeans, metrics, pairwise, select, spectral, stability
from clustrum.operators.preprocess import STRATEGIES, Preprocessor, Strategy, fit_yeo_johnson
from clustrum.operators.schema import ColumnTypes, infer_column_types
from clustrum.plans import queries as q, workflow
from clustrum.sources import sinks, tables as sources
from clustrum.streaming import minibatch


def mixed(n=50):
    rng = np.random.default_rng(0)
    return pd.DataFrame({"Id": range(n), "cont_a": rng.normal(size=n), "cont_b": rng.exponential(size=n), "cat_a": rng.integers(0, 3, n), "cat_b": rng.choice(list("xyz"), n)})


def blob_rows(n=600, d=4, k=3, spread=0.6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, (k, d))
    label = np.arange(n) % k
    return centres[label] + rng.normal(scale=spread, size=(n, d)), label


@pytest.fixture(scope="module")
def blobs(spark):
    x, label = blob_rows()
    df = spark.createDataFrame([(i, list(map(float, r)), int(v)) for i, (r, v) in enumerate(zip(x, label, strict=True))], "row_id long, features array<double>, label int").persist()
    return df.select("row_id", "features"), df.select("row_id", "label"), x, label


def as_dict(df):
    return {r["row_id"]: r["label"] for r in df.collect()}


def ari(a, b):
    return metrics.adjusted_rand(a, b).first()["ari"]


def test_types(spark):
    t = infer_column_types(spark.createDataFrame(mixed()))
    assert (t.continuous, t.categorical, t.excluded) == (["cont_a", "cont_b"], ["cat_a", "cat_b"], ["Id"])
    lower = infer_column_types(spark.createDataFrame(pd.DataFrame({"id": range(100), "a": np.arange(100.0)})))
    assert (lower.continuous, lower.excluded) == (["a"], ["id"])
    cats = infer_column_types(spark.createDataFrame(pd.DataFrame({"a": ["x"] * 30 + ["y"] * 20, "b": [1, 2, 3, 1, 2] * 10})))
    assert cats.categorical == ["a", "b"] and not cats.continuous


@pytest.mark.parametrize("name", list(STRATEGIES))
def test_strategies_are_dense(spark, name):
    df = spark.createDataFrame(mixed())
    out = Preprocessor(infer_column_types(df), STRATEGIES[name]).fit(df).transform(df).toPandas()
    x = np.stack(out["features"])
    assert len(out) == 50 and np.isfinite(x).all() and list(out.columns) == ["Id", "features"]


def test_preprocessor_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2.0, None), (3, 10.0, "a"), (4, 3.0, "b")], "id long, x double, c string")
    types = ColumnTypes(["x"], ["c"], ["id"])
    rows = {r["id"]: r["features"] for r in Preprocessor(types, Strategy("none", "target_freq")).fit(df).transform(df).collect()}
    assert rows[1] == [3.0, 0.5] and rows[2] == [2.0, 0.25]
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, x double")
    out = Preprocessor(ColumnTypes(["x"], [], ["id"]), Strategy("robust")).fit(flat).transform(flat)
    assert all(r["features"] == [0.0] for r in out.collect())
    with pytest.raises(ValueError):
        Preprocessor(ColumnTypes([], [], []))
    with pytest.raises(ValueError):
        Strategy("cube")
    wide = spark.range(600).select("id", F.concat(F.lit("k"), F.col("id") % 300).alias("c"))
    coded = Preprocessor(ColumnTypes([], ["c"], ["id"]), Strategy("none", "ordinal")).fit(wide).transform(wide)
    names = sorted({f"k{i}" for i in range(300)})
    assert {(r["id"], r["features"][0]) for r in coded.collect()} == {(i, float(names.index(f"k{i % 300}"))) for i in range(600)}


@pytest.mark.parametrize("read", [0, 50, 10**6])
def test_quantiles_by_counting(spark, monkeypatch, read):
    """Brackets to the last value, to a few values, and read at once; ties, wide ranges, infinities, nulls, many ranks."""
    rng = np.random.default_rng(1)
    n = 997
    columns = {"x": np.round(rng.normal(size=n), 2), "y": rng.integers(0, 5, n).astype(float), "z": np.exp(rng.normal(size=n) * 200), "w": -np.exp(rng.normal(size=n)), "c": np.full(n, 3.0)}
    columns["v"] = np.where(np.arange(n) % 50 == 0, np.inf, np.where(np.arange(n) % 50 == 1, -np.inf, columns["x"]))
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumn("n", F.when(F.col("y") > 1, F.col("x"))).repartition(3)
    columns["n"] = columns["x"][columns["y"] > 1]
    typed = df.select(*columns)
    for slices in (4, 200):
        ranks = {c: list(range(0, len(v), 7)) + [len(v) - 1] * (len(v) % 7 != 1) for c, v in columns.items()}
        got = profile.select_ranks(typed, ranks, slices, read)
        for c, v in columns.items():
            assert [got[c][r] for r in ranks[c]] == np.sort(v)[ranks[c]].tolist(), c
    monkeypatch.setattr(profile, "ONE_PASS_ROWS", 10)
    shares = [0, 0.1, 0.5, 0.95, 1]
    found = profile.quantiles(df, ["x", "y", "n"], shares)
    assert all(np.allclose(found[c], np.quantile(columns[c], shares)) for c in "xyn")


def test_yeo_johnson_normalises(spark):
    x = np.random.default_rng(3).exponential(size=4000)
    lam = fit_yeo_johnson(spark.createDataFrame(pd.DataFrame({"x": x})), {"x": F.col("x")})["x"]
    assert -1.0 < lam < 0.2


def test_profile_edges(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert profile.histogram(empty, "a").count() == 0
    assert profile.correlation_summary(profile.correlations(empty.select("a"), ["a"])).first()["max_abs_r"] is None
    assert profile.describe(empty, ["a"]).first()["q50"] is None
    ties = spark.createDataFrame([(3, 0.5), (2, 0.5), (4, None)], "k int, s double")
    assert profile.first_best(ties, "k", "s").first()["k"] == 2
    steps = profile.running_total(spark.createDataFrame([(1, 0.5), (2, 0.46), (3, 0.04)], "i int, r double"), "i", "r", "c")
    assert profile.first_reaching(steps, "i", "c", 0.95).first()["i"] == 2


def test_knn_blocks_agree(blobs, monkeypatch):
    points, _, x, _ = blobs
    whole = {(r["row_id"], r["rank"]): r["nbr_id"] for r in pairwise.knn(points, points, 4).collect()}
    monkeypatch.setattr(pairwise, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 170)
    blocks = {(r["row_id"], r["rank"]): r["nbr_id"] for r in pairwise.knn(points, points, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert whole == blocks
    assert all(whole[i, 1] == i for i in range(600))
    assert [whole[0, r] for r in (2, 3, 4)] == np.argsort(d[0])[1:4].tolist()


def test_votes_and_noise(spark):
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 1, 2, 10, 11, 1.5])], "row_id long, features array<double>")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, -1)], "row_id long, label int")
    assert as_dict(pairwise.assign_noise_to_nearest(points, labels, 2))[5] == 0  # a tie goes to the smaller label
    none = labels.withColumn("label", F.lit(-1))
    assert set(as_dict(pairwise.assign_noise_to_nearest(points, none)).values()) == {-1}
    assert as_dict(pairwise.noise_as_own_cluster(labels))[5] == 2


def test_metrics_on_blobs(blobs):
    points, labels, _, _ = blobs
    m = metrics.internal_metrics(points, labels).first()
    assert m["silhouette"] > 0.5 and m["davies_bouldin"] < 1 and m["calinski_harabasz"] > 100
    one = metrics.internal_metrics(points, labels.withColumn("label", F.lit(0)), bic=3.0).first()
    assert one["silhouette"] is None and one["bic"] == 3.0
    assert ari(labels, labels.withColumn("label", 2 - F.col("label"))) == 1.0


def test_equal_points_and_singletons(spark):
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0, 5, 5, 9])], "row_id long, features array<double>")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "row_id long, label int")
    found = {r["row_id"]: r["silhouette"] for r in metrics.silhouette_samples(metrics.labelled(points, labels)).collect()}
    assert found[0] == 1.0 and found[4] == 0.0


def test_kmeans_scan_and_stability(blobs):
    points, labels, _, _ = blobs
    assert ari(kmeans.kmeans(3, n_init=2)(points), labels) == 1.0
    scan = stability.scan_clusters(lambda k: kmeans.kmeans(k, n_init=1, max_iter=20), points, [2, 3, 4], n_iter=2)
    assert [r["k"] for r in scan.orderBy("k").collect()] == [2, 3, 4]
    assert select.best_k(scan) == 3
    report = stability.stability(kmeans.kmeans(3, n_init=1), points, n_iter=2)
    assert report.n_iter == 2 and report.mean > 0.8 and len(report.to_dict()["per_iter"]) == 2
    assert stability.sample_size(5, 0.5) == 2


def test_minibatch_batch_and_stream(spark, blobs, tmp_path):
    points, labels, x, _ = blobs
    assert ari(kmeans.minibatch_kmeans(3, batch_size=200, n_init=5)(points), labels) > 0.5
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    model = minibatch.start_model(x[:3].tolist())
    minibatch.follow(spark.readStream.schema(points.schema).parquet(str(tmp_path / "in")), model, str(tmp_path / "check")).awaitTermination(120)
    assert model.counts.sum() == 600 and ari(model.predict(points), labels) == 1.0


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_gmm(blobs, kind):
    points, labels, _, _ = blobs
    model, n, _ = gmm.fit_gmm(points, 3, kind, n_init=1)
    assert n == 600 and ari(gmm.predict(points, model), labels) == 1.0
    assert gmm.bic(model, n, kind) < gmm.gmm_bic(kind, n_init=1)(2, points)


def test_bayesian_gmm_and_digamma(blobs):
    points, labels, _, _ = blobs
    found = gmm.bayesian_gmm(6, max_iter=30)(points)
    assert found.select("label").distinct().count() <= 6 and ari(found, labels) > 0.6
    assert math.isclose(gmm.digamma(np.array([1.0]))[0], -0.5772156649, abs_tol=1e-7)


def test_density(spark, blobs):
    points, labels, _, _ = blobs
    found = density.dbscan(1.5, 5)(points)
    assert ari(found.where("label >= 0"), labels) > 0.99
    x, _ = blob_rows(120)
    small = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "row_id long, features array<double>")
    truth = spark.createDataFrame([(i, i % 3) for i in range(120)], "row_id long, label int")
    assert ari(density.hdbscan(10, 5)(small), truth) > 0.9
    near, far = (sorted(map(tuple, density.minimum_spanning_tree(small, 5, n).collect())) for n in (1000, 0))
    assert [e[:2] for e in near] == [e[:2] for e in far] and len(near) == 119


def test_hierarchies_and_spectral(blobs):
    points, labels, x, _ = blobs
    for linkage in ("ward", "complete", "average"):
        assert ari(hierarchical.agglomerative(3, linkage)(points), labels) == 1.0
    assert ari(hierarchical.agglomerative(3, "ward", 150)(points), labels) == 1.0
    tree = hierarchical.dendrogram(points, "ward", 100).orderBy("step").collect()
    assert len(tree) == 99 and tree[-1]["size"] == 100 and all(a["height"] <= b["height"] for a, b in zip(tree, tree[1:], strict=False))
    assert ari(spectral.spectral(3)(points), labels) > 0.95
    with pytest.raises(ValueError):
        hierarchical.agglomerative_cuts(points, [2], "centroid")


def naive_average(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage_against_naive():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    label = hierarchical.cut_tree(hierarchical.chain_linkage(d, "average"), 40, 5)
    assert {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label)} == naive_average(d, 5)


def test_consensus(spark, blobs):
    _, labels, _, _ = blobs
    other = labels.withColumn("label", F.when(F.col("row_id") % 50 == 0, -1).otherwise((F.col("label") + 1) % 3))
    sets = [labels, other, labels.withColumn("label", F.when(F.col("row_id") % 7 == 0, 0).otherwise(F.col("label")))]
    assert ari(hierarchical.consensus(sets, 3), labels) > 0.95
    assert hierarchical.consensus_k(sets) == 3
    assert hierarchical.leave_one_out(sets, 3).count() == 3
    tiny = [spark.createDataFrame([(0, 0), (1, 0), (2, -1), (3, -1)], "row_id long, label int")]
    shares = {(r["row_id"], r["nbr_id"]): r["share"] for r in hierarchical.co_association(tiny).collect()}
    assert shares == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (0, 1): 1.0, (1, 0): 1.0}
    with pytest.raises(ValueError):
        hierarchical.consensus(sets, 3, "ward")
    with pytest.raises(ValueError):
        hierarchical.label_table([])
    with pytest.raises(ValueError):
        hierarchical.label_table([labels, labels.where("row_id > 3")])


def test_reduction(blobs):
    points, labels, x, _ = blobs
    pca = dimred.fit_pca(points)
    z = np.stack(pca.transform(points, 2).orderBy("row_id").toPandas()["z"])
    assert abs(z.mean(0)).max() < 1e-9
    value = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(pca.variance, value) and dimred.components_for(points, 1.0) == 4
    layout = dimred.as_points(dimred.umap(points, 2, 10, epochs=60, max_rows=200))
    assert layout.count() == 200
    assert metrics.internal_metrics(layout, labels).first()["silhouette"] > 0.4


def test_layout_of_all_rows(spark, blobs):
    points, labels, x, _ = blobs
    whole = dimred.as_points(dimred.umap_all(points, 2, 10, epochs=60, max_rows=200))
    assert whole.count() == whole.select("row_id").distinct().count() == len(x)
    assert metrics.internal_metrics(whole, labels).first()["silhouette"] > 0.4
    fitted = {r["row_id"]: r["z"] for r in dimred.umap(points, 2, 10, epochs=60, max_rows=200).collect()}
    placed = {r["row_id"]: r["features"] for r in whole.collect()}
    features = {r["row_id"]: np.array(r["features"]) for r in points.collect()}
    other = min(set(placed) - set(fitted))
    near = sorted((np.linalg.norm(features[other] - features[i]), i) for i in fitted)[:10]
    want = sum(np.array(fitted[i]) / d for d, i in near) / sum(1 / d for d, _ in near)
    assert all(placed[i] == z for i, z in fitted.items()) and np.allclose(placed[other], want)
    # a row that equals a laid-out one, with an id that the sample puts last, stands where that one stands
    last, one = max(range(10**6, 10**6 + 1000), key=lambda i: (i * 2654435761 + 42 * 40503) % 2**32), min(fitted)
    twin = points.select("row_id", "features").union(spark.createDataFrame([(last, features[one].tolist())], "row_id long, features array<double>"))
    both = {r["row_id"]: r["z"] for r in dimred.umap_all(twin, 2, 10, epochs=60, max_rows=200).collect()}
    assert len(both) == len(x) + 1 and np.allclose(both[last], fitted[one], atol=1e-4)


def test_layout_query_returns_all_rows(spark, blobs, monkeypatch):
    points, _, x, _ = blobs
    monkeypatch.setattr(q, "points", lambda *_: points)
    for f in vars(dimred).values():
        if dimred.LAYOUT_ROWS in (getattr(f, "__defaults__", None) or ()):
            monkeypatch.setattr(f, "__defaults__", tuple(200 if v == dimred.LAYOUT_ROWS else v for v in f.__defaults__))
    assert q.QUERIES["umap_layout"](spark, "").count() == len(x)


def test_ranking(spark):
    ranked = select.rank_candidates(q.runs(spark))
    first = [r["notebook"][:2] for r in ranked.limit(6).collect()]
    assert first == ["07", "03", "06", "08", "05", "04"]
    assert math.isclose(ranked.first()["combined_score"], 1.7275710517796297, rel_tol=1e-12)
    assert select.pick_individual(ranked).first()["notebook"].startswith("07") and select.pick_consensus(ranked).first()["notebook"].startswith("08")
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None)], "k string, x double").withColumn("z", select.z_score("x"))
    assert {r["k"]: r["z"] for r in flat.collect()} == {"a": 0.0, "b": 0.0, "c": None}
    assert select.pick_with_fallback(spark.createDataFrame([(30, None)], "k int, s double"), "k", "s", 30) == 30
    assert select.elbow(spark.createDataFrame([(3, 1.0), (2, 2.0)], "k int, v double"), "v").first()["k"] == 2


def test_sources_and_sinks(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, label int")
    sinks.write_labels(labels, str(tmp_path / "l"))
    assert as_dict(sources.read_labels(spark, str(tmp_path / "l"), labels)) == {1: 0, 2: 1}
    with pytest.raises(ValueError):
        sources.read_labels(spark, str(tmp_path / "l"), labels.where("row_id = 1"))
    with pytest.raises(FileNotFoundError):
        sources.read_raw(spark, str(tmp_path))
    ids = labels.select(F.col("row_id").alias("Id"))
    sinks.write_submission(ids, labels, str(tmp_path / "sub.csv"))
    assert sources.read_table(spark, str(tmp_path / "sub.csv")).collect() == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        sinks.submission(ids, labels.where("row_id = 1"))
    report = stability.StabilityReport(float("nan"), 0.1, 1, 0.8, [0.5])
    payload = {"notebook": "x", "best_model": {"algorithm": "KMeans", "internal_metrics": {"silhouette": np.float64(0.5), "bic": float("inf")}, "stability": {"mean_ari": report.mean, "per_iter": np.array([1.0])}}, 3: tmp_path}
    path = sinks.write_result(tmp_path / "runs/x", payload)
    got = json.loads(open(path).read())
    assert got["best_model"]["internal_metrics"]["bic"] is None and got["3"] == str(tmp_path) and got["timestamp"].endswith("+00:00")
    sinks.write_result(tmp_path / "runs/y", {"notebook": "y", "timestamp": "t"})
    runs = {r["notebook"]: r for r in sources.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert runs["x"]["silhouette"] == 0.5 and runs["y"]["algorithm"] is None
    assert sinks.to_jsonable(report)["mean"] is None
    assert json.loads(sinks.jsonable_rows(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()["document"]) == {"a": None, "b": 1}


def test_settings(monkeypatch):
    monkeypatch.setenv("GRID", "50,100")
    assert sources.setting("GRID", [30], int) == [50, 100] and sources.setting("K_MAX", 30, int) == 30


def test_labels_do_not_depend_on_row_order(blobs):
    points, _, _, _ = blobs
    again = points.orderBy(F.desc("row_id")).repartition(7)
    assert as_dict(density.dbscan(1.5)(points)) == as_dict(density.dbscan(1.5)(again))
    assert as_dict(hierarchical.agglomerative(3)(points)) == as_dict(hierarchical.agglomerative(3)(again))


def test_workflow(spark, blobs, monkeypatch):
    points, labels, _, _ = blobs
    scan = workflow.linkage_scan(points, [2, 3, 4], ("average", "ward"), 200, n_iter=1)
    assert scan.count() == 6 and workflow.pick_linkage(scan).first()["k"] == 3
    some = stability.sample_rows(points, 90)
    sweep = workflow.density_sweep(some, (8,))
    assert sweep.first()["n_clusters"] == 3 and workflow.pick_cluster_size(sweep, (8,)) == 8
    clean = workflow.density_labels(some, 8)
    assert clean.where("label = -1").count() == 0 and ari(clean, labels) > 0.95
    with pytest.raises(ValueError):
        workflow.density_labels(some, 8, "drop")
    spaces = workflow.embed_and_cluster(points, 3, ((2, 10),), 200)
    assert spaces.count() == 4 and spaces.first()["silhouette"] > 0.4
    found, score, left_out = workflow.agree(points, [labels, labels.withColumn("label", (F.col("label") + 1) % 3)])
    assert ari(found, labels) == 1.0 and score.first()["silhouette"] > 0.5 and left_out.count() == 2
    best = workflow.compare_strategies(spark.createDataFrame(mixed()), "Id", 2, 1, ("standard+onehot", "robust+freq"))
    assert best.count() == 2
    assert workflow.final_selection(q.runs(spark))[1].count() == 1
    curves = workflow.bic_curves(points, [2, 3], ("diag",), 1)
    assert select.pick_bic(curves).first()["k"] == 3


def test_consensus_of_many_tuples(spark, monkeypatch):
    """Beyond TREE_ROWS the rest joins the cluster that it agrees with most; noise doesn't stop it."""
    n = 600
    one = spark.createDataFrame([(i, -1 if i % 10 == 0 else i % 3) for i in range(n)], "row_id long, label int")
    two = spark.createDataFrame([(i, 5 + i % 3) for i in range(n)], "row_id long, label int")
    three = spark.createDataFrame([(i, i % 3 if i % 7 else -1) for i in range(n)], "row_id long, label int")
    whole = {r["row_id"]: r["label"] for r in hierarchical.consensus([one, two, three], 3).collect()}
    monkeypatch.setattr(hierarchical, "TREE_ROWS", 20)
    some = {r["row_id"]: r["label"] for r in hierarchical.consensus([one, two, three], 3).collect()}
    assert len(some) == n and all(len({x[i] for i in range(r, n, 3)}) == 1 for x in (whole, some) for r in range(3)) and len(set(some.values())) == 3


def test_numbered(spark):
    from clustrum.functions.scratch import numbered

    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 700)
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(x)], "x long, i long").repartition(7)
    got = numbered(df, "x", "i").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(700)) and [(r["x"], r["i"]) for r in got] == sorted((int(v), i) for i, v in enumerate(x))
    assert numbered(df.limit(0), "x").count() == 0


def test_silhouettes_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist(), int(v)) for i, v in enumerate(rng.integers(0, 4, 200))] + [(200, [9.0, 9.0, 9.0], 7)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label int")
    whole = {r["row_id"]: r["silhouette"] for r in metrics.silhouette_samples(df).collect()}
    monkeypatch.setattr(pairwise, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(pairwise, "BLOCK_ROWS", 60)
    parts = {r["row_id"]: r["silhouette"] for r in metrics.silhouette_samples(df).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[i] - parts[i]) < 1e-9 for i in whole) and whole[200] == 0


def brute_scores(x, m):
    """Normal scores with the grid's places in whole numbers: Fraction ranks, ties averaged over their stretch."""
    from fractions import Fraction
    from statistics import NormalDist

    ordered, n = sorted(x), len(x)
    grid = []
    for j in range(m):
        place = Fraction(j * (n - 1), max(m - 1, 1))
        low = int(place)
        grid.append(ordered[low] + (ordered[min(low + 1, n - 1)] - ordered[low]) * float(place - low))
    r = np.arange(m) / max(m - 1, 1)
    u = [0.5 * (np.interp(v, grid, r) - np.interp(-v, -np.array(grid)[::-1], -r[::-1])) for v in x]
    return [NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in u]


@pytest.mark.parametrize("n", [150, 1001, 2])
def test_quantile_map_of_ties_at_every_size(spark, n):
    """As many grid points as rows, nearly so, and more rows: a tied block keeps both its edges."""
    x = [float((i * 7919) % n % 25) for i in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v double")
    model = Preprocessor(ColumnTypes(["v"], [], ["id"]), STRATEGIES["quantile+ordinal"]).fit(df)
    got = {r["id"]: r["features"][0] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(n)], brute_scores(x, min(1000, n)), atol=1e-6)


def test_fractions_of_large_columns(spark, monkeypatch):
    x = [float(i % 13) for i in range(400)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    places = [(j, 399) for j in range(400)]
    monkeypatch.setattr(profile, "ONE_PASS_ROWS", 10)
    assert profile.quantiles(df, ["v"], places)["v"] == sorted(x)


@pytest.mark.parametrize("read", [20_000, 3])
def test_exact_sample_of_any_ids(spark, monkeypatch, read):
    """Ids of all 64 bits, equal keys, negative ids: the rows that a sort by key and id would take, without a sort."""
    monkeypatch.setattr(stability, "READ_KEYS", read)
    ids = [0, 1, 2, 2**31, 4_000_000_000, 2**63 - 1, -(2**63), -1, *(k << 32 for k in range(1, 90)), *range(10**12, 10**12 + 300)]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long")

    def place(i, seed):
        u = i % 2**64
        low, high = u % 2**32, (u >> 32 & 0xFFFF) * 2246822519 + (u >> 48) * 3266489917
        return (low * 2654435761 + high + seed * 40503) % 2**32, i

    for n, seeds in ((1, [5]), (120, [42, 43, 44]), (len(ids) - 1, [7]), (len(ids), [7]), (0, [7])):
        for seed, some in zip(seeds, stability.sample_seeds(df, n, seeds), strict=True):
            assert sorted(r["row_id"] for r in some.collect()) == sorted(sorted(ids, key=lambda i: place(i, seed))[:n])  # noqa: B023
    plan = stability.sample_rows(df, 50)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_density_curve(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, 4000), rng.normal(6, 0.5, 1000)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    rows = profile.density(df, "v").orderBy("point").collect()
    at = np.array([r["x"] for r in rows])
    h = x.std(ddof=1) * len(x) ** -0.2
    want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.abs(np.array([r["density"] for r in rows]) - want).max() < 1e-4
    assert profile.density(df.where("v = 0"), "v").count() == profile.density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").count() == 0


def brute_dbscan(x, eps, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core, low = d.sum(1) >= min_samples, np.arange(len(x))
    while True:
        new = np.array([low[d[i] & core].min() if core[i] else low[i] for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    names = {c: k for k, c in enumerate(sorted(set(low[core].tolist())))}
    return [names[low[i]] if core[i] else min((names[low[j]] for j in np.flatnonzero(d[i] & core)), default=-1) for i in range(len(x))]


@pytest.mark.parametrize(("part", "side", "d"), [(4096, 2.0, 2), (7, 1.0, 3), (20, 6.0, 1)])
def test_dbscan_by_cells_against_all_pairs(spark, monkeypatch, part, side, d):
    """Chains over many cells, a crowded cell in parts, repeated points, border rows between two clusters, noise."""
    monkeypatch.setattr(density, "PART_ROWS", part)
    monkeypatch.setattr(density, "CELL_SIDE", side)
    rng = np.random.default_rng(part)
    chain = np.stack([np.arange(40) * 0.9, *[np.zeros(40)] * (d - 1)], 1)
    x = np.vstack([chain, rng.normal([20] * d, 0.3, (40, d)), rng.uniform(-30, 60, (40, d)), np.full((6, d), -9.0)])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    got = {r["row_id"]: r["label"] for r in density.dbscan(1.0, 3)(df).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, 1.0, 3)
    assert density.dbscan(1.0)(df.limit(0)).count() == 0
    assert {r["label"] for r in density.dbscan(0.0, 6)(df).collect()} == {0, -1}


@pytest.mark.parametrize(("exclude", "k"), [(False, 4), (True, 5), (False, 500)])
def test_pruned_neighbours_are_exact(spark, monkeypatch, exclude, k):
    """Lists around pivots, crowded and empty ones, repeated rows that tie, fewer rows than neighbours asked for."""
    rng = np.random.default_rng(k)
    x = np.vstack([rng.normal(c, 0.3, (50, 3)) for c in ([0, 0, 0], [9, 0, 0], [0, 9, 9], [30, 30, 30])] + [np.full((8, 3), 4.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    some = df.where("row_id % 3 = 0")
    whole = {(r["row_id"], r["rank"]): (r["nbr_id"], round(r["dist"], 8)) for r in pairwise.knn(some, df, k, exclude).collect()}
    for name, value in (("BROADCAST_BYTES", 0), ("LIST_ROWS", 10), ("PIVOTS", 12)):
        monkeypatch.setattr(pairwise, name, value)
    assert {(r["row_id"], r["rank"]): (r["nbr_id"], round(r["dist"], 8)) for r in pairwise.knn(some, df, k, exclude).collect()} == whole
    if k == 4:
        seen = pairwise.list_visits(some, df, k).first()
        assert seen["skipped"] > 0.5 * seen["lists"] * seen["queries"]


def test_silhouettes_of_copies_and_several_sets(spark, monkeypatch):
    """Copies are counted once with their number; sets that lack rows, and many labels, get the values of a plain sum."""
    rng = np.random.default_rng(5)
    x = np.tile(rng.normal(size=(40, 3)), (3, 1))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    first, second = {i: i % 40 % 4 for i in range(120)}, {i: i % 5 for i in range(120) if i % 7}
    sets = [spark.createDataFrame(sorted(s.items()), "row_id long, label int") for s in (first, second)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def plain(s, i):
        mean = {v: d[i, [j for j in s if s[j] == v and j != i]].mean() for v in set(s.values())}
        a, b = mean[s[i]], min(m for v, m in mean.items() if v != s[i])
        return (b - a) / max(a, b)

    for limit, columns in ((1 << 26, 256), (0, 256), (0, 2)):
        monkeypatch.setattr(pairwise, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(metrics, "MEMBER_COLUMNS", columns)
        got = metrics.silhouettes(points, sets).collect()
        assert len(got) == 120
        for r in got:
            assert math.isclose(r["s0"], plain(first, r["row_id"]), abs_tol=1e-6)
            assert r["s1"] is None if r["row_id"] not in second else math.isclose(r["s1"], plain(second, r["row_id"]), abs_tol=1e-6)


def test_planted_linkage_scan_scores_all_rows(spark, tmp_path, monkeypatch):
    from clustrum.plans import proofs

    rows = [(i, [math.sin(i * (j + 1)) / 4 for j in range(8)], i % 10) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(hierarchical, "TREE_ROWS", 100)
    p = proofs.planted(spark, str(tmp_path))
    want = metrics.internal_metrics(p, p.select("row_id", (F.col("row_id") % 4).cast("int").alias("label"))).first()
    found = proofs.planted_linkage_scan(spark, str(tmp_path)).collect()
    assert len(found) == 3 and all(r["k"] == 4 and r["silhouette"] == round(want["silhouette"], 6) for r in found)


def test_silhouettes_of_many_labels_meet_prepared_rows(spark, monkeypatch):
    # fit rows are turned once for all blocks of queries; sums by the order of labels are those by a matrix of members
    y = np.random.default_rng(3).normal(size=(50, 3))
    assert pairwise.turned(y)[0] is pairwise.turned(y)[0]
    rows = spark.createDataFrame([(i, list(map(float, y[i % 50]))) for i in range(60)], "row_id long, features array<double>")
    sets = [rows.select("row_id", F.col("row_id").cast("int").alias("label")), rows.where("row_id % 5 > 0").select("row_id", (F.col("row_id") % 3).cast("int").alias("label"))]
    want = sorted(metrics.silhouettes(rows, sets).collect())
    means = [metrics.internal_metrics(rows, s).first()["silhouette"] for s in sets]
    monkeypatch.setattr(metrics, "MEMBER_CELLS", 0)
    got = sorted(metrics.silhouettes(rows, sets).collect())
    assert [r[:2] + r[3:4] for r in got] == [r[:2] + r[3:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in ((g["s0"], w["s0"]), (g["s1"], w["s1"])))
    assert means[0] is None and math.isclose(means[1], metrics.silhouette(metrics.labelled(rows, sets[1])).first()[0], abs_tol=1e-9)
