"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import decimal
import math

import duckdb
import pytest

from lethe import queries as library
from lethe.queries.base import TABLES

DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query(spark, duck, name):
    df = library.queries()[name](spark, DIR)
    got = df.toArrow().to_pylist()
    want = duck.sql(library.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(str([norm(r[c]) for c in columns]) for r in got) == sorted(str([norm(r[c]) for c in columns]) for r in rows)
