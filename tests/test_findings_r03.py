"""Searches, ratios and sums that round 3's findings changed, against plain comparisons of all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from clustrum.operators import density, metrics, pairwise


def frame(spark, x, label=None):
    rows = [(i, v.tolist()) if label is None else (i, v.tolist(), int(label[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>" + (", label int" if label is not None else ""))


def test_many_clusters_meet_in_blocks(spark):
    """ratios of all pairs of clusters, equal centres among them, without one task's join of all pairs."""
    rng = np.random.default_rng(6)
    label = rng.permutation(np.repeat(np.arange(60), 4))
    x = rng.normal(size=(240, 3)) + rng.normal(size=(60, 3))[label]
    for equal in (False, True):
        if equal:
            x[label == 1] = x[label == 0]
        centre = np.array([x[label == k].mean(0) for k in range(60)])
        s = np.array([np.sqrt(((x[label == k] - centre[k]) ** 2).sum(1)).mean() for k in range(60)])
        d = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
        with np.errstate(divide="ignore"):
            r = np.where(np.eye(60, dtype=bool), -1, (s[:, None] + s[None]) / d)
        out = metrics.davies_bouldin(frame(spark, x, label))
        assert "NestedLoop" not in out._jdf.queryExecution().toString()
        assert out.first()[0] == (np.inf if equal else pytest.approx(r.max(1).mean(), rel=1e-12))


def test_scores_leave_tasks_without_totals(spark, monkeypatch):
    """where all rows are broadcast no array of a total for each cluster is shuffled; scores are those of the other way."""
    rng = np.random.default_rng(7)
    label = rng.integers(0, 9, 90)
    rows = frame(spark, rng.normal(size=(90, 3)) + label[:, None], label)
    score = lambda: {r["row_id"]: r["silhouette"] for r in metrics.silhouette_samples(rows).collect()}
    at_once, seen = score(), []
    plain = metrics.block_join
    monkeypatch.setattr(metrics, "block_join", lambda q, f, b, schema, **k: seen.append(schema) or plain(q, f, b, schema, **k))
    score()
    assert seen == ["row_id long, s0 double"]
    monkeypatch.setattr(pairwise, "BROADCAST_BYTES", 0)
    in_parts = score()
    assert seen[-1] == "row_id long, total array<double>" and all(abs(at_once[i] - in_parts[i]) < 1e-9 for i in at_once)


@pytest.mark.parametrize("axes", [2, 6, 20])
def test_boxes_rule_tiles_out(monkeypatch, axes):
    """nearest rows and lightest edges out of components, of rows in many tiles; boxes spare most of them."""
    monkeypatch.setattr(pairwise, "TILE", 16)
    monkeypatch.setattr(density, "TILE", 16)
    rng = np.random.default_rng(axes)
    part = np.arange(900) % 3
    x = rng.normal(size=(900, axes)) + 12 * np.eye(3, axes)[part] if axes > 2 else rng.normal(size=(900, 2)) + 9 * part[:, None]
    ids, fit_ids, y = np.arange(900)[:300], rng.permutation(900), None
    y = x[fit_ids]
    d = np.sqrt(((x[:300, None] - y[None]) ** 2).sum(2))
    q, f = pairwise.nearest(ids, x[:300], fit_ids, y, 7, False)
    found, kth = set(zip(q.tolist(), f.tolist(), strict=True)), np.sort(d, 1)[:, 6]
    assert {(i, j) for i, j in zip(*np.nonzero(d <= kth[:, None]), strict=True)} <= found and len(found) < 300 * 9
    core = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 4]
    of = np.where(np.arange(900) < 30, np.arange(900), 30 + part)  # components of one row, and three of many
    w = np.round(np.maximum(np.maximum(d, core[:300, None]), core[fit_ids][None]), 12)
    w[of[:300, None] == of[fit_ids][None]] = np.inf
    for best in (np.full(900, np.inf), np.full(900, 2.0)):
        got = density._lightest_out(ids, np.c_[x, core][:300], fit_ids, np.c_[y, core[fit_ids]], of[:300], lambda at: of[fit_ids[at]], best, object())
        edges = {r["c"]: (r["w"], r["u"], r["v"]) for r in pa.Table.from_batches([got]).to_pylist()}
        for c in np.unique(of[:300]):
            i, j = np.nonzero((of[:300, None] == c) & np.isfinite(w))
            want = min(zip(w[i, j].tolist(), np.minimum(i, fit_ids[j]).tolist(), np.maximum(i, fit_ids[j]).tolist(), strict=True))
            assert edges.get(c) == want if want[0] <= best[0] else c not in edges


def test_boxes_spare_work(monkeypatch):
    """a search of rows in clusters meets a small share of all pairs."""
    rng, met = np.random.default_rng(1), []
    y = np.ascontiguousarray(rng.normal(size=(40_000, 3)) + 20 * (np.arange(40_000) % 4)[:, None])
    plain = pairwise.Tiles.table

    class Counted(np.ndarray):
        def __rmatmul__(self, x):
            met.append(len(x) * self.shape[1])
            return x @ np.asarray(self)

        __array_priority__ = 99

    Counted.__array_ufunc__ = None
    monkeypatch.setattr(pairwise.Tiles, "table", lambda self, kind: plain(self, kind).view(Counted))
    q, _ = pairwise.nearest(np.arange(2000), y[:2000], np.arange(40_000), y, 10, False)
    assert len(q) >= 20_000 and 0 < sum(met) < 0.1 * 2000 * 40_000


@pytest.mark.parametrize("axes", [1, 3])
def test_silhouettes_along_lines(spark, monkeypatch, axes):
    """rows that differ in one axis on few lines: the same silhouettes, without meeting all pairs."""
    rng = np.random.default_rng(axes)
    x = np.c_[rng.normal(size=400) * 3, rng.integers(0, 3, 400) / 7.0, rng.integers(0, 2, 400) * 1.0][:, :axes]
    x[350:] = x[:50]
    label = rng.integers(0, 3, 400) + (x[:, 0] > 0)
    label[:2] = 9, -1
    points = frame(spark, x)
    sets = [frame(spark, x, v).select("row_id", "label").where("label <> -1") for v in (label, label % 2)]
    score = lambda: {r["row_id"]: (r["s0"], r["s1"]) for r in metrics.silhouettes(points, sets).collect()}
    want = score()
    monkeypatch.setattr(metrics, "LINE_ROWS", 0)
    monkeypatch.setattr(metrics, "PIECE_ROWS", 100)
    monkeypatch.setattr(metrics, "block_join", None)
    got = score()
    assert want.keys() == got.keys() and got[1][0] is None
    assert all(a == b if None in (a, b) else abs(a - b) < 1e-10 for i in want for a, b in zip(want[i], got[i], strict=True))


def test_passages_within_blocks(spark):
    """what pages repeat from the middle of a block on is boilerplate too, whatever words stand before it."""
    page_text = pytest.importorskip("clustrum.llm.page_text")
    tail = "sign up for our letter and read all the news first"
    own = ["apples ripen in the warm sun of late autumn", "ships cross a grey sea by night and fog", "trains leave town at noon for far away places"]
    rows = [(i, f"http://h.x/{i}", f"<p>{own[i]}</p><div>{name} please {tail}</div>") for i, name in enumerate(("Anna", "Bert", "Carl"))]
    rows += [(9, "http://other.x/", f"<p>Dora please {tail}</p>"), (10, "http://h.x/10", "<article>Emil please stays here</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages).collect()}
    assert [got[i] for i in range(3)] == own and got[9] == f"Dora please {tail}" and got[10] == "Emil please stays here"


def test_words_against_all_pairs(spark, monkeypatch):
    """the passages of all words, in few and in many ranges."""
    page_text = pytest.importorskip("clustrum.llm.page_text")
    rng = np.random.default_rng(11)
    streams = [[str(w) for w in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(14)]
    hosts = [("http://a.b/", "http://c.d/")[i % 2] for i in range(14)]
    rows = [(i, i, hosts[i] + str(i), f"<p>{' '.join(s)}</p>") for i, s in enumerate(streams)]
    want = {}
    for i, s in enumerate(streams):
        for a in range(len(s)):
            best = 0
            for j, t in enumerate(streams):
                if j != i and hosts[i] == hosts[j]:
                    for b in range(len(t)):
                        n = 0
                        while n < page_text.WORDS and a + n < len(s) and b + n < len(t) and s[a + n] == t[b + n]:
                            n += 1
                        best = max(best, n)
            if best >= page_text.LONG:
                want[i, a] = best
    for each in (page_text.RANGE, 20):
        monkeypatch.setattr(page_text, "RANGE", each)
        pages = spark.createDataFrame(rows, "page long, tie long, url string, html string")
        assert {(r["page"], r["word"]): r["extent"] for r in page_text.passages(pages).collect()} == want
