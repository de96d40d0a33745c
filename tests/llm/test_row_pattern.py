"""Row patterns against a search row by row, over blocks of any size."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clustrum.llm import carries
from clustrum.llm import row_pattern as rp

SCHEMA = "click_id long, ts timestamp, client_id long, kind string, value double, `i` string, Carry int"
MICROS = 1_000_000


def brute(rows, gap=rp.GAP_MICROS):
    """Matches by trying each start and each row after it, as a backtracking search does."""
    by: dict = {}
    for r in set(rows):
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[2], []).append(r)
    out = []
    for client, own in by.items():
        own.sort(key=lambda r: (r[1], r[0] is not None, r[0]))
        cents = [None if r[4] is None else int((100 * r[4] + 0.5) // 1) for r in own]
        near = lambda j: own[j][1] - own[j - 1][1] <= gap  # noqa: B023, E731

        def letter(j):
            if cents[j] is None or cents[j - 1] is None or not near(j) or own[j][3] in (None, "error"):  # noqa: B023
                return None
            return "D" if cents[j] < cents[j - 1] else "U" if cents[j] > cents[j - 1] else None  # noqa: B023

        s, no = 0, 0
        while s < len(own):
            labels, j = "A", s + 1
            while cents[s] is not None and j < len(own):
                if own[j][3] == "purchase" and cents[j] is not None and cents[j] >= cents[s] and near(j):
                    labels += "P"
                    break
                if (x := letter(j)) is None:
                    break
                labels += x
                j += 1
            if labels[-1] != "P":
                s += 1
                continue
            no += 1
            out.append((client, no, own[s][0], own[j][0], j - s + 1, sum(cents[s : j + 1]), hashlib.sha256(labels.encode()).hexdigest()))
            s = j + 1
    return sorted(out, key=str)


def table(spark, rows):
    df = spark.createDataFrame([(*r[:1], r[1], *r[2:], "x", 1) for r in rows], SCHEMA.replace("ts timestamp", "ts long"))
    return df.withColumn("ts", F.timestamp_micros("ts"))


def matches(spark, rows):
    got = rp.match_rows(table(spark, rows), "client_id", "ts", "click_id", "value", rp.click_letter())
    return sorted((tuple(r) for r in got.collect()), key=str)


def clicks(seed, n, clients, gap=240, odd=0.1, kinds=("view", "click", "purchase", "purchase", "error", None)):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice((0, 1, gap, 3 * gap)) * MICROS
        value = None if rng.random() < odd / 3 else rng.choice((float(rng.randint(-3, 9)), rng.uniform(-2, 90), 5.005))
        kind = rng.choice(kinds[:4] if rng.random() > odd else kinds)
        out.append((i, at, 7 if rng.random() < 0.4 else rng.randrange(clients), kind, value))
        if rng.random() < 0.05:
            out.append(out[-1])
    return out


@pytest.mark.parametrize(("block", "fan"), [(10**6, 1024), (40, 1024), (25, 3)])
def test_matches_against_a_search_row_by_row(spark, monkeypatch, block, fan):
    monkeypatch.setattr(rp, "BLOCK_ROWS", block)
    monkeypatch.setattr(carries, "FAN", fan)
    rows = clicks(block, 240, 3) + [(None, 5 * MICROS, 1, "view", 1.0), (9_000, None, 1, "purchase", 9.0), (9_001, 5, None, "purchase", 9.0)]
    assert matches(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [10**6, 12])
def test_chains_longer_than_a_block(spark, monkeypatch, block):
    """One key, hardly a break: the open match, and goals of all sizes, pass through many blocks."""
    monkeypatch.setattr(rp, "BLOCK_ROWS", block)
    rng = random.Random(3)
    steady = [(i, i * 60 * MICROS, 1, rng.choice(("view", "view", "view", "purchase")), float(rng.randrange(10**6))) for i in range(120)]
    falling = [(i, i * 60 * MICROS, 2, "purchase" if i % 9 == 5 else "view", 1000.0 - i) for i in range(100)] + [(100, 6000 * MICROS, 2, "purchase", 990.0)]
    equal = [(i, i * 60 * MICROS, 3, "purchase", 4.0) for i in range(25)]
    rows = steady + falling + equal
    assert matches(spark, rows) == brute(rows)


def test_edges(spark):
    assert matches(spark, []) == []
    gap = rp.GAP_MICROS
    rows = [(1, 0, 1, "view", 2.0), (2, gap, 1, "purchase", 2.0), (3, 0, 2, "view", 2.0), (4, gap + 1, 2, "purchase", 2.0), (5, 0, 3, None, -1.0), (6, 1, 3, "purchase", -1.0)]
    rows += [(7, 0, 4, "view", float("nan")), (8, 1, 4, "purchase", float("inf")), (9, 2, 4, "view", 1e300), (10, 3, 4, "purchase", 1.0), (11, 4, 4, "purchase", 1.0)]
    got = matches(spark, rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, 2), (3, 5, 6), (4, 10, 11)]
    assert got[0][4:6] == (2, 400)


def test_query_and_sql_agree(spark, tables):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view clicks as select * from '{tables}/clicks.parquet'")
    assert sorted(con.sql(rp.SQL).fetchall()) == sorted(tuple(r) for r in rp.op12_row_pattern(spark, tables).collect())
