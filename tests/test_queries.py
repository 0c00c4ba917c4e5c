"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

import weftline.queries  # noqa: F401
from weftline.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [q.name for q in QUERIES.values() if q.sql])
def test_same_rows(name, spark, sf, duck):
    q = QUERIES[name]
    df = q.build(spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = duck.execute(q.sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(row[k] for k in at)) for row in found.fetchall())
