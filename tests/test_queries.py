"""Every registered signal query against its SQL on the same tables; the rest must give rows."""

import math
import os

import duckdb
import pytest

from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def close(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=3e-5)) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    want = con.sql(SQL[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(rows, key=str)
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert len(got) == len(expected)
    assert got == expected or all(close(a, b) for a, b in zip(got, expected, strict=True))


def test_names_agree():
    assert set(SQL) <= set(catalog.queries())
