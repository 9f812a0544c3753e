"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
import os

import pytest

import __spark_entry__

from .conftest import DATA

duckdb = pytest.importorskip("duckdb")
SMALL = f"{DATA}/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, decimal.Decimal | int | float):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else str(v)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = tables.execute(SQL[name])
    theirs = [x[0] for x in got.description]
    assert sorted(theirs) == columns
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_a_schema(spark):
    assert __spark_entry__.entry(spark).columns
