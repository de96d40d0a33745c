"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from clustrum.plans import proofs  # noqa: F401
from clustrum.plans import queries as q

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"create view {t} as select * from read_parquet('{tables}/{t}.parquet')")
    return c


def plain(rows):
    def one(v):
        v = v.item() if hasattr(v, "item") else v
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, duck, tables, name):
    df = q.QUERIES[name](spark, tables)
    order = sorted(df.columns)
    got = duck.execute(q.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == order
    want = [tuple(r[columns.index(c)] for c in order) for r in got.fetchall()]
    assert plain(tuple(r[c] for c in order) for r in df.collect()) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
