"""Ranges of files: prefixes, samples of containers, members of archives; no more is read than asked for."""

import bz2  # noqa: F401  the archive library needs it for one of the methods
import os
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytebasin.sources import ranged, store


def zstd(data):
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as z:
        z.write(data)
    return sink.getvalue().to_pybytes()


def sparse(path, size, parts):
    with open(path, "wb") as f:
        f.truncate(size)
        for at, data in parts.items():
            f.seek(at)
            f.write(data)


def test_a_container_beyond_two_gigabytes(spark, tmp_path):
    """Samples are cut at any place, and little more than their own bytes is read."""
    rng = random.Random(0)
    parts = {3_100_000_000: rng.randbytes(5000), 3_100_006_000: rng.randbytes(900), 2_200_000_000: rng.randbytes(70_000), 4096: b"first"}
    sparse(tmp_path / "box 1.bin", 3_200_000_000, parts)
    rows = [(str(tmp_path / "box 1.bin"), at, len(d), f"s{at}") for at, d in parts.items()] + [
        (str(tmp_path / "box 1.bin"), 3_199_999_999, 2, "over"), (str(tmp_path / "box 1.bin"), -1, 2, "before"), (str(tmp_path / "box 1.bin"), 0, 3_000_000_000, "huge"),
        (str(tmp_path / "box 1.bin"), 10, 0, "none"), (str(tmp_path / "gone"), 0, 1, "gone"), (None, 0, 1, "null"), (str(tmp_path / "box 1.bin"), None, 1, "nowhere"),
    ]
    read = spark.sparkContext.accumulator(0)
    got = {r.tag: (None if r.data is None else bytes(r.data), r.reject_reason) for r in ranged.cut(spark.createDataFrame(rows, "path string, offset long, size long, tag string"), read=read).collect()}
    assert {k: v[0] for k, v in got.items() if v[1] is None} == {f"s{at}": d for at, d in parts.items()} | {"none": b""}
    assert {k: v[1].split(":")[0] for k, v in got.items() if v[1]} == dict.fromkeys(["over", "before", "huge", "nowhere"], "range") | dict.fromkeys(["gone", "null"], "file")
    asked = sum(map(len, parts.values()))
    assert asked <= read.value <= asked + ranged.GAP
    prefix = spark.sparkContext.accumulator(0)
    assert [(r.size, r.length) for r in ranged.read_prefixes(spark, str(tmp_path), 100, "*.bin", prefix).collect()] == [(100, 3_200_000_000)]
    assert prefix.value == 100
    assert [r.size for r in store.read_blobs(spark, str(tmp_path), 64, "*.bin").collect()] == [64]


@pytest.mark.parametrize("run, rows", [(1000, 3), (1 << 23, 256)])
def test_compressed_containers_are_streamed(spark, tmp_path, monkeypatch, run, rows):
    rng = random.Random(1)
    data = rng.randbytes(300_000)
    (tmp_path / "z").write_bytes(zstd(data))
    monkeypatch.setattr(ranged, "RUN", run)
    monkeypatch.setattr(ranged, "BATCH_ROWS", rows)
    spans = [(rng.randrange(300_000), rng.choice([0, 1, 10, 5000])) for _ in range(200)] + [(0, 300_000), (299_999, 2), (400_000, 1), (5, -1)]
    df = spark.createDataFrame([(str(tmp_path / "z"), o, n) for o, n in spans], "path string, offset long, size long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.offset, r["size"]): r.data for r in ranged.cut(df, inflated=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(o, n): data[o : o + n] if n >= 0 and o + n <= len(data) else None for o, n in spans}
    assert {k: None if v is None else bytes(v) for k, v in got.items()} == want


def test_neighbours_are_read_together():
    runs = list(ranged._runs([0, 10, 10, 200_000, 200_500], [10, 5, 90, 400, 8 << 20], 0, 5))
    assert runs == [(0, 3, 0, 100), (3, 4, 200_000, 400), (4, 5, 200_500, 8 << 20)]


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    """Archives of every kind, and what their members hold."""
    folder, rng, want = tmp_path_factory.mktemp("zips"), random.Random(2), {}
    for a, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)):
        with zipfile.ZipFile(folder / f"a {a}.zip", "w", method) as z:
            z.writestr("d/", b"")
            z.writestr("empty", b"")
            for k in range(12):
                data = b"MZ" + rng.randbytes(50) * rng.choice([1, 40]) if k else b"MZ" + bytes(6_000_000)
                z.writestr(f"d/é{k}.exe", data)
                want[f"a {a}.zip", f"d/é{k}.exe"] = data
            z.writestr("x.PDB", b"MZ")
            z.writestr("other", b"\x7fELF")
            want |= {(f"a {a}.zip", "x.PDB"): b"MZ", (f"a {a}.zip", "other"): b"\x7fELF"}
    (folder / "no.zip").write_bytes(b"no archive at all")
    broken = bytearray((folder / "a 0.zip").read_bytes())
    broken[broken.find(b"MZ", broken.find("d/é5".encode())) + 1] ^= 1
    (folder / "broken.zip").write_bytes(broken)
    return folder, want


def test_archives_by_member(spark, archives):
    folder, want = archives
    rows = store.archive_members(spark, str(folder)).collect()
    got = {(os.path.basename(r.archive), r["name"]): bytes(r.data) for r in rows if r.reject_reason is None}
    assert {k: v for k, v in got.items() if k[0] != "broken.zip"} == want
    bad = {(os.path.basename(r.archive), r["name"]): r.reject_reason for r in rows if r.reject_reason}
    assert set(bad) == {("no.zip", None), ("broken.zip", "d/é5.exe")} and "checksum" in bad["broken.zip", "d/é5.exe"]
    heads = store.read_archives(spark, str(folder), max_length=10).collect()
    assert {(os.path.basename(r.archive), r["name"]): bytes(r.data) for r in heads if "broken" not in r.archive} == {k: v[:10] for k, v in want.items() if k[1].endswith(".exe")}


def test_an_archive_is_dealt_over_tasks(spark, archives):
    folder, want = archives
    found = store.archive_members(spark, str(folder)).where("archive LIKE '%a 1.zip'").withColumn("task", F.spark_partition_id())
    counts = {r.task: r["n"] for r in found.groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert len(counts) > 1 and sum(counts.values()) == sum(k[0] == "a 1.zip" for k in want)


def test_packed_set_with_faults(spark, tmp_path):
    for d in ("size", "meta", "data"):
        (tmp_path / d).mkdir()
    box = b"hello".ljust(4096, b"\0") + b"world"
    (tmp_path / "data/data-0.bin").write_bytes(box)
    (tmp_path / "data/data-1.zst").write_bytes(zstd(box))
    rows = [(0, "a", 0, 0, 5), (1, "b", 0, 4096, 5), (2, "c", 0, 4096, 6), (3, "d", 1, 4096, 5), (4, "e", 1, 4000, 500), (5, "f", 7, 0, 1)]
    (tmp_path / "size/size.csv").write_text("idx,name,shard,offset,size\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    (tmp_path / "meta/meta.csv").write_text("idx,name,shard,timestamp,malware,family\n" + "".join(f"{i},{n},{s},-1,1,\n" for i, n, s, _, _ in rows))
    got = {r["name"]: (r.data and bytes(r.data), r.reject_reason) for r in store.packed_ranges(spark, str(tmp_path)).collect()}
    assert [got[n][0] for n in "abcdef"] == [b"hello", b"world", None, b"world", None, None] and [bool(got[n][1]) for n in "abcdef"] == [False, False, True, False, True, True]
    with pytest.raises(Exception, match="range: beyond the file: c|range: beyond the file: e|file: TypeError: f"):
        store.read_packed(spark, str(tmp_path)).collect()
