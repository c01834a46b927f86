"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pitwright import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, int):
        return v
    return str(v)[:19].removesuffix(" 00:00:00")


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rounded = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda row: str([rounded(v) for v in row]))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = rows_of(names, found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b or (isinstance(a, float) and isinstance(b, float | int) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (name, g, w)


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n.startswith("s_")))
def test_no_strategy_is_idle(spark, name):
    """On a panel that is long enough for every lookback."""
    assert not catalog.QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns
    catalog.QUERIES[name](spark, SF).collect()
