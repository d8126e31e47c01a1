"""Every domain query against its SQL, on the small tables."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from tapeglass.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data_dir, name):
    found = QUERIES[name](spark, data_dir)
    columns = sorted(found.columns)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = Counter(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
