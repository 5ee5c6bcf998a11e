"""Stored sets: containers written and read, lookups that open no more than they need."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from bytebasin.sources import store


def scan(df):
    """The scan of a plan that has run: files and rows that it gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    metrics = leaf.metrics()
    return leaf.toString(), metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored") / "packed")
    rng = random.Random(0)
    rows = [(i, f"n{i * 37 % 1000:04}", i % 8, rng.randbytes(20)) for i in range(0, 1000)]
    store.write_packed(spark.createDataFrame(rows, "idx long, name string, shard int, data binary"), folder)
    return folder, {(n, s): (i, d) for i, n, s, d in rows}


def test_a_lookup_opens_its_shard(spark, stored):
    folder, rows = stored
    (name, shard), (idx, data) = next(iter(rows.items()))
    found = store.lookup(spark.read.parquet(folder), name, shard)
    text, files, given = scan(found)
    assert "PartitionFilters: [isnotnull(shard" in text and "EqualTo(name" in text
    assert files == 1 and given <= len(rows) // 8
    assert [(r.idx, bytes(r.data)) for r in found.collect()] == [(idx, data)]


def test_keys_that_are_not_there_are_told_by_the_filter(spark, stored):
    """A key between the least and the greatest one of a row group, but in none: no row is given out."""
    folder, _ = stored
    _, files, given = scan(spark.read.parquet(folder).where(F.col("name") == "n0500x"))
    assert files >= 8 and given == 0


def test_many_keys(spark, stored):
    folder, rows = stored
    wanted = [k for k in rows if k[1] in (2, 5)][:40]
    keys = spark.createDataFrame([*wanted, ("n0001", 99), ("nobody", 2), (None, None)], "name string, shard int")
    found = store.lookup_many(spark.read.parquet(folder), keys)
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*shard[^\n]*IN", plan) and re.search(r"PushedFilters: \[[^\n]*In\(name", plan), plan
    assert {(r["name"], r.shard): (r.idx, bytes(r.data)) for r in found.collect()} == {k: rows[k] for k in wanted}


def test_many_keys_beyond_the_bounds(spark, stored, monkeypatch):
    folder, rows = stored
    monkeypatch.setattr(store, "FEW_SHARDS", 2)
    monkeypatch.setattr(store, "FEW_KEYS", 10)
    keys = spark.createDataFrame(list(rows), "name string, shard int")
    assert store.lookup_many(spark.read.parquet(folder), keys).count() == len(rows)
    assert store.lookup_many(spark.read.parquet(folder), keys.limit(0)).count() == 0


@pytest.mark.parametrize("page", [1, 512])
def test_containers_and_back(spark, tmp_path, page):
    rng = random.Random(3)
    rows = [(i, f"s{i}", i // 7, rng.randbytes(rng.choice([0, 1, 511, 512, 513, 4000])), i % 3 == 0, i if i % 2 else None, "f" if i % 5 == 0 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, name string, shard int, data binary, label boolean, ts long, family string")
    store.write_containers(df, str(tmp_path / "c"), page, F.col("shard") % 2 == 0)
    sizes = {f: os.path.getsize(tmp_path / "c/data" / f) for f in os.listdir(tmp_path / "c/data") if not f.startswith(".")}
    assert len(sizes) == 6 and sizes["data-1.bin"] == sum(-(-len(r[3]) // page) * page for r in rows if r[2] == 1)
    got = {r.idx: (r["name"], r.shard, bytes(r.data), r.label, r.ts, r.family) for r in store.read_packed(spark, str(tmp_path / "c")).collect()}
    assert got == {i: (n, s, d, x, t, f or "") for i, n, s, d, x, t, f in rows}
    with pytest.raises(Exception, match="exists"):
        store.write_containers(df, str(tmp_path / "c"), page)


def test_transforms_with_a_reject_channel(spark):
    def fn(name, data):
        if data is None:
            return None
        return name, 100 // len(data), data[::-1]

    df = spark.createDataFrame([("a", b"xy"), ("b", b""), ("c", None), (None, b"q"), ("a", b"xy")], "name string, data binary").repartition(3)
    rows = sorted(((r.id, r.share, r.back and bytes(r.back), r["sample"], r.reject_reason) for r in store.transformed(df, fn, "id string, share long, back binary").collect()), key=repr)
    error = "error: ZeroDivisionError: integer division or modulo by zero"
    assert rows == sorted([("a", 50, b"yx", "a", None)] * 2 + [(None, None, None, "b", error), (None, None, None, "c", "skipped"), (None, 100, b"q", None, None)], key=repr)
    assert store.map_blobs(df.where("name <> 'b'"), fn, "id string, share long, back binary").count() == 2
    with pytest.raises(Exception, match="ZeroDivisionError.*sample b"):
        store.map_blobs(df, fn, "id string, share long, back binary").collect()
    assert store.transformed(df.limit(0), fn, "id string, share long, back binary").count() == 0


def test_small_shards_have_small_filters(spark, tmp_path):
    rows = spark.range(600).selectExpr("id AS name", "id AS idx", "id % 3 AS shard")
    store.write_packed(rows, str(tmp_path / "set"))
    files = list((tmp_path / "set").rglob("*.parquet"))
    assert files and max(f.stat().st_size for f in files) < 100_000
    assert store.lookup(spark.read.parquet(str(tmp_path / "set")), 7, 1).first()["idx"] == 7


def test_a_large_shard_is_written_by_several_tasks(spark, tmp_path):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 8).selectExpr("id AS name", "xxhash64(id) AS value", "id % 2 AS shard")
        store.write_regions(rows, str(tmp_path / "set"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "set" / "shard=0").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "set")).count() == 60_000
