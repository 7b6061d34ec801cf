"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

import __spark_entry__
from veridal.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same_as_sql(spark, sf_dir, duck, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    want = duck.sql(sql)
    assert names == sorted(want.columns)
    kinds, found = dict(df.dtypes), dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[kinds[c]] for c in names} == {c: found[c] for c in names}
    at = [want.columns.index(c) for c in names]
    a = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    same_as_sql(spark, sf_dir, duck, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_registered_names_are_served():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
