"""Product codes against plain integer arithmetic, and the bounds of the VA-file."""

import hashlib

import numpy as np
import pytest

from clustrum.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, Error double"


def brute(rows, parts=8, k=16, rounds=6):
    kept = [(i, [int(np.floor(4096 * float(np.float32(c)))) for c in x], lab) for i, x, lab in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    m = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * m : (p + 1) * m]
    first = [v for _, v, _ in sorted(kept)[:k]]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(cut(v, p), e), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[[] for _ in range(len(first))] for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                chosen[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[p][n] for n, own in enumerate(chosen[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), lab) for i, v, lab in kept]
    total: dict = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted((i, c, e, total[lab], digest) for i, c, e, lab in out)


def codes(spark, rows):
    got = vc.compress(spark.createDataFrame([(*r, "clash", 0.0) for r in rows], SCHEMA))
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())


@pytest.mark.parametrize(("n", "d"), [(120, 16), (9, 8), (1, 24)])
def test_codes_against_plain_integers(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.2, (n, d)).astype(np.float32).tolist()
    rows = [(int(i) * 3 - 5, v, None if i % 4 == 0 else int(i) % 3) for i, v in enumerate(x)]
    rows[n // 2] = (rows[n // 2][0], rows[0][1], 1)  # a repeated vector, so entries and distances tie
    assert codes(spark, rows) == brute(rows)


def test_vectors_that_take_no_part(spark):
    good = [(i, [0.25 * i] * 8, i) for i in range(3)]
    bad = [(10, None, 1), (11, [], 1), (12, [None] * 8, 1), (13, [float("nan")] * 8, 1), (14, [float("inf")] * 8, 1), (15, [1.0] * 16, 1), (16, [1.0] * 7, 1), (17, [3e38] * 8, 1)]
    assert codes(spark, good + bad) == brute(good)
    assert codes(spark, []) == codes(spark, bad[:4]) == []


def test_repeated_and_missing_ids_are_rows(spark):
    rows = [(4, [1.0] * 8, None), (4, [2.0] * 8, None), (None, [1.0] * 8, 3)]
    got = vc.compress(spark.createDataFrame([(*r, "", 0.0) for r in rows], SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got) == [("4", "00" * 8, 0), ("4", "01" * 8, 0), ("None", "00" * 8, 0)]


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_cells_bound_every_distance(bits):
    rng = np.random.default_rng(bits)
    entries, x = rng.integers(-900, 900, (16, 5)), rng.integers(-1500, 1500, (400, 5))
    entries[7] = entries[3]
    cells = vc.Cells(entries, bits)
    true = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    below, above = cells.bounds(x)
    assert (below <= true).all() and (true <= above).all()
    near, d = cells.nearest(x)
    assert (near == true.argmin(1)).all() and (d == true.min(1)).all()
    if bits == 4:
        assert (below <= above.min(1, keepdims=True)).sum() < 0.3 * below.size  # most entries are never refined


def test_decoded_vectors_are_near(spark, tables):
    from pyspark.sql import functions as F

    vectors = spark.read.parquet(f"{tables}/embeddings.parquet")
    ints = vc.integers(vectors)
    books = vc.fit(ints)
    got = {r["id"]: r["codes"] for r in vc.encode(ints, books).collect()}
    x = {r["vec_id"]: r["embedding"] for r in vectors.where(F.col("vec_id") < 100).collect()}
    ids = sorted(set(x) & set(got))
    near = books.decode(np.array([got[i] for i in ids]))
    assert np.square(near - np.array([x[i] for i in ids])).sum(1).mean() < 0.8


def test_query_and_sql_agree(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tables}/embeddings.parquet'")
    assert sorted(con.sql(vc.SQL).fetchall()) == sorted(tuple(r) for r in vc.op13_vector_codes(spark, tables).collect())
