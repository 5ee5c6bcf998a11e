"""Queries of this subpackage that SQL can express, on DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from bytebasin.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    found = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    names = list(found.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in found.fetchall())
