"""Every query of the library against its SQL on DuckDB."""

import collections
import datetime
import decimal
import math
import os

import duckdb
import pytest

from bytebasin import catalog


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert sum(got.values()) > 0
        return
    found = duck.sql(catalog.ORACLES[name])
    names = list(found.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = collections.Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
