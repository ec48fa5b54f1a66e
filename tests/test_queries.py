"""Every query with SQL against DuckDB over the same tables."""

import datetime
import math
import os

import duckdb
import pytest

import tallymart.plans  # noqa: F401
from tallymart.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, datetime.date) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLE_SQL[name])
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert sorted(df.columns) == sorted(expected.columns)
    assert {c: TYPES.get(t) for c, t in df.dtypes} == types
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    """Queries that SQL can't express are run whole; what they give is tested beside their operators."""
    df = QUERIES[name](spark, sf_dir)
    assert all(set(r.asDict()) == set(df.columns) for r in df.collect())
