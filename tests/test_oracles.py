"""Every query that has SQL gives the same rows and types as DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sluicework.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    at = [names.index(c) for c in columns]
    want = sorted(repr([r[k] for k in at]) for r in result.fetchall())
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got == want
