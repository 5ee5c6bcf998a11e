"""Whole jobs on executables assembled by hand."""

import hashlib

import numpy as np
import pytest
from test_sources import executable

from bytebasin.plans import preparation as pr


@pytest.fixture(scope="module")
def blobs(spark):
    data = [executable(sections=((0x60000020, 64 + 8 * i), (0xC0000040, 32)), overlay=b"tail" * i) for i in range(9)] + [b"not one"]
    return spark.createDataFrame([(hashlib.sha256(d).hexdigest(), d, i % 2) for i, d in enumerate(data)], "name string, data binary, label int")


def tokens(row):
    return [np.frombuffer(t, "<u2").tolist() for t in row.tokens]


def test_preprocess_and_batch(spark, blobs, tmp_path):
    status = pr.preprocess(blobs.selectExpr("name AS sha", "label"), blobs, str(tmp_path / "p"), 1150, 4).collect()
    assert sum(r.samples for r in status) == 10 and all(r.missing == r.unexpected == r.wrong_label == r.oversized == r.wrong_digest == r.stray_regions == 0 for r in status)
    assert {r.shard for r in status} == {0, 1, 2}
    rows = pr.training_batches(spark, str(tmp_path / "p"), "MIDDLE", 4, multiple=16).collect()
    of = {(r.batch, r.label): r for r in rows}
    data = {r["name"]: bytes(r.data)[:1150] for r in blobs.collect()}
    whole = [r for r in rows if r.label == "UNKNOWN"]
    assert len(whole) == 1 and bytes(t - 1 for t in tokens(whole[0])[0][:7]) == b"not one"
    for r in rows:
        assert r.length % 16 == 0 and all(len(t) == r.length for t in tokens(r))
        for name, n, t in zip(r.names, r.lengths, tokens(r)):
            assert bytes(x - 1 for x in t[:n]) in data[name] and all(x == 0 for x in t[n:])
    assert {x for _, x in of} >= {"HEADERS", "CODE", "DATA", "OVERLAY"}


def test_acquire_and_split(spark, blobs, tmp_path):
    members = blobs.select("data").union(blobs.select("data"))
    times = blobs.limit(3).selectExpr("name", "CAST(label * 1000000000000 + 5 AS BIGINT) AS ts")
    got = pr.acquire(members, times, 10**9, True).collect()
    assert len(got) == 10 and all(r.label == 1 and r.ts in (5, -1) for r in got)
    report = pr.split_by_class(blobs, (0.6, 0.2, 0.2), str(tmp_path / "s"), 3).first()
    assert (report.expected_removed, report.actual_removed) == (0, 0)
    rows = spark.read.parquet(str(tmp_path / "s"))
    assert {r.split: r.n for r in rows.groupBy("split").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {"tr": 6, "vl": 2, "ts": 2}
    with pytest.raises(Exception, match="exists"):
        pr.split_by_class(blobs, (0.6, 0.2, 0.2), str(tmp_path / "s"), 3)
