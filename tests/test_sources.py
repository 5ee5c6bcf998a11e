"""Files: blobs, archives, packed sets, run logs; executables assembled by hand; streams against batches."""

import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytebasin.operators import integrity as ig
from bytebasin.operators import layout as lo
from bytebasin.sources import store
from bytebasin.streaming import streams


def executable(sections=((0x60000020, 0x200), (0xC0000040, 0x100)), overlay=b"OVERLAY", clr=False):
    """Inert bytes in the layout of an executable: headers, sections of zeros, and a tail."""
    e, opt = 0x80, 0xE0
    raw = 0x400
    head = bytearray(raw)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, e)
    head[e : e + 4] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", head, e + 4, 0x14C, len(sections), 1234567, 0, 0, opt, 0)
    struct.pack_into("<H", head, e + 24, 0x10B)
    struct.pack_into("<I", head, e + 84, raw)
    struct.pack_into("<I", head, e + 24 + 92, 16)
    body = bytearray()
    for i, (flags, size) in enumerate(sections):
        at = e + 24 + opt + 40 * i
        struct.pack_into("<IIII", head, at + 8, size, 0x1000 * (i + 1), size, raw + len(body))
        struct.pack_into("<I", head, at + 36, flags)
        body += bytes(size)
    dirs = e + 24 + 96
    struct.pack_into("<II", head, dirs + 8 * 1, 0x1010, 0x20)
    struct.pack_into("<II", head, dirs + 8 * 4, raw + len(body), len(overlay))
    if clr:
        struct.pack_into("<II", head, dirs + 8 * 14, 0x1000, 72)
        struct.pack_into("<II", body, 8, 0x2000, 0x10)
    return bytes(head + body + overlay)


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [("plain", executable()), ("net", executable(clr=True)), ("none", executable(sections=(), overlay=b"x" * 50)), ("text", b"MZ no header"), ("empty", b""), ("other", b"\x7fELF")]
    return spark.createDataFrame(rows, "name string, data binary")


def test_headers_and_sections(blobs):
    heads = {r["name"]: r for r in lo.headers(blobs).collect()}
    assert heads.keys() == {"plain", "net", "none"} and heads["plain"].timestamp == 1234567 and heads["plain"].machine == 0x14C
    secs = {(r["name"], r.sec_no): (r.vaddr, r.raw_off, r.raw_size, r.flags) for r in lo.sections(blobs).collect()}
    assert secs["plain", 0] == (0x1000, 0x400, 0x200, 0x60000020) and secs["plain", 1] == (0x2000, 0x600, 0x100, 0xC0000040)


def test_structures(blobs):
    rows = lo.structures(blobs).collect()
    sizes = {r["name"]: len(r.data) for r in blobs.collect()}
    assert all(0 <= r.start < r.end <= sizes[r["name"]] for r in rows)
    of = {}
    for r in rows:
        of.setdefault((r["name"], r.level, r.label), []).append((r.start, r.end))
    end = sizes["plain"]
    assert of["plain", "MIDDLE", "OVERLAY"] == [(end - 7, end)] and of["plain", "MIDDLE", "CODE"] == [(0x400, 0x600)] and of["plain", "MIDDLE", "DATA"] == [(0x600, 0x700)]
    assert of["plain", "FINE", "WDATA"] == [(0x600, 0x700)] and of["plain", "FINE", "IDATA"] == [(0x410, 0x430)] and of["plain", "FINE", "OTHERDIR"] == [(end - 7, end)]
    assert of["net", "ROUGH", "DNETSEC"] == [(0x400, 0x600), (0x600, 0x700)] and ("net", "ROUGH", "OTHRSEC") not in of
    assert of["plain", "FINE", "DOS_STUB"] == [(64, 128)] and of["plain", "FINE", "SECTN_TABLE"] == [(0x80 + 24 + 0xE0, 0x80 + 24 + 0xE0 + 80)]
    assert of["plain", None, "MEM_EXECUTE"] == [(0x400, 0x600)] and of["none", "MIDDLE", "OVERLAY"] == [(0, sizes["none"])]


def test_quarantine(blobs):
    good, bad = lo.quarantine(blobs)
    assert good.count() == 3 and {r["name"]: r.reject_reason for r in bad.collect()} == {"text": "no header", "empty": "empty", "other": "no magic"}


def test_section_classes(spark):
    df = spark.createDataFrame([(lo.EXECUTE,), (lo.READ,), (lo.WRITE,), (lo.READ | lo.EXECUTE,), (lo.READ | lo.WRITE,)], "flags long")
    got = [(r.a, r.b) for r in df.select(lo.section_class(F.col("flags")).alias("a"), lo.section_class_rw(F.col("flags")).alias("b")).collect()]
    assert got == [("CODE", "RCODE"), ("DATA", "RDATA"), ("OTHER", "OTHER"), ("CODE", "RCODE"), ("DATA", "WDATA")]


def test_blobs_archives_and_index(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.bin").write_bytes(b"MZ12345")
    (tmp_path / "a/y.bin").write_bytes(b"")
    got = {r["name"]: bytes(r.data) for r in store.read_blobs(spark, str(tmp_path), 4, "*.bin").collect()}
    assert got == {"x.bin": b"MZ12"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, data in (("d/", b""), ("d/one.exe", b"MZaa"), ("d/one.pdb", b"MZaa"), ("empty", b""), ("elf", b"\x7fELF")):
            z.writestr(name, data)
    assert [r["name"] for r in store.read_archives(spark, str(tmp_path)).collect()] == ["d/one.exe"]
    rows = spark.createDataFrame([("b" * 64, 1), ("a" * 64, 0)], "sha string, label int")
    store.write_index(rows, str(tmp_path / "index"))
    assert [tuple(r) for r in store.read_index(spark, str(tmp_path / "index")).collect()] == [("a" * 64, 0), ("b" * 64, 1)]
    store.write_index(rows.union(rows), str(tmp_path / "twice"))
    with pytest.raises(Exception, match="repeated"):
        store.read_index(spark, str(tmp_path / "twice")).collect()


def test_packed_set(spark, tmp_path):
    for d in ("size", "meta", "data"):
        (tmp_path / "old" / d).mkdir(parents=True)
    one, two = b"hello", b"MZ" * 30
    box = one.ljust(4096, b"\0") + two.ljust(4096, b"\0")
    (tmp_path / "old/data/data-0.bin").write_bytes(box)
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as z:
        z.write(box)
    (tmp_path / "old/data/data-1.bin").write_bytes(sink.getvalue().to_pybytes())
    rows = [(0, "a", 0, 0, 5), (1, "b", 0, 4096, 60), (2, "c", 1, 0, 5), (3, "d", 1, 4096, 60)]
    (tmp_path / "old/size/size.csv").write_text("idx,name,shard,offset,size\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    (tmp_path / "old/meta/meta.csv").write_text("idx,name,shard,timestamp,malware,family\n" + "".join(f"{i},{n},{s},{-1 if i else 9},{1 if i % 2 else -1},{'f' if i else ''}\n" for i, n, s, _, _ in rows))
    got = {r["name"]: r for r in store.read_packed(spark, str(tmp_path / "old")).collect()}
    assert [bytes(got[n].data) for n in "abcd"] == [one, two, one, two] and got["a"].ts == 9 and got["b"].ts is None and got["a"].family == "" and got["b"].label and not got["c"].label
    packed = store.read_packed(spark, str(tmp_path / "old"))
    store.write_packed(packed, str(tmp_path / "new"))
    again = spark.read.parquet(str(tmp_path / "new"))
    assert bytes(store.lookup(again, "d", 1).first().data) == two
    with pytest.raises(KeyError):
        store.lookup(again, "d", 0)
    with pytest.raises(Exception, match="exists"):
        store.write_packed(packed, str(tmp_path / "new"))
    assert ig.check_dataset(packed, packed).isEmpty()


def test_runlog_and_udfs(spark, tmp_path):
    store.append_runlog(spark.createDataFrame([(1, 2.0**31)], "epoch long, tr_gpu_mem double"), str(tmp_path / "log"))
    store.append_runlog(spark.createDataFrame([(2, 0.5)], "epoch long, vl_loss double"), str(tmp_path / "log"))
    rows = {r.epoch: r for r in store.read_runlog(spark, str(tmp_path / "log")).collect()}
    assert rows[1].tr_gpu_mem == 2.0 and rows[2].tr_gpu_mem is None and rows[2].vl_loss == 0.5
    blobs = spark.createDataFrame([("a", b"xyz"), ("b", b"")], "name string, data binary")
    got = store.map_blobs(blobs, lambda n, d: (n, d[::-1], len(d)) if d else None, "name string, data binary, n long").collect()
    assert [(r["name"], bytes(r.data), r.n) for r in got] == [("a", b"zyx", 3)]


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / f"in/{i}.bin").write_bytes(b"same" if i < 2 else bytes([i]) * i)
    stream = streams.unique_names(streams.fingerprinted(streams.blob_stream(spark, str(tmp_path / "in"), "*.bin", 2), 3))
    drain(stream.writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "c")).start())
    rows = spark.table("ingested").collect()
    assert len(rows) == 4 and all(len(r.data) <= 3 for r in rows)


def test_packing_stream(spark, tmp_path):
    stream = streams.table_stream(spark, str(write_parts(spark, tmp_path)), 1)
    query = stream.writeStream.foreachBatch(streams.packer(str(tmp_path / "out"), 4)).option("checkpointLocation", str(tmp_path / "c")).start()
    drain(query)
    rows = spark.read.option("basePath", str(tmp_path / "out")).parquet(f"{tmp_path}/out/batch=*").collect()
    assert sorted(r.idx for r in rows) == list(range(15)) and all(r.shard == r.idx // 4 for r in rows)


def write_parts(spark, tmp_path):
    for k in range(3):
        spark.range(5 * k, 5 * k + 5).select(F.col("id").alias("name")).coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
    return tmp_path / "parts"


def test_metrics_stream_is_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = streams.windowed_metrics(streams.table_stream(spark, str(tmp_path / "events"), 1), "1 hour", "365 days")
    drain(stream.writeStream.format("memory").queryName("metrics").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start())
    got = {(r.event_type, r.start): r.n for r in spark.table("metrics").collect()}
    assert got == {(r.event_type, r.start): r.n for r in streams.windowed_metrics(events, "1 hour").collect()}


def test_early_stop_stream(spark, tmp_path):
    values = [0.5, 0.6, 0.6005, 0.6, 0.7, 0.1, 0.1, 0.1]
    for k in range(4):
        spark.createDataFrame([(r, 2 * k + j + 1, values[2 * k + j] if r else float(k)) for r in (0, 1) for j in (0, 1)], "run long, step long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    stream = streams.early_stops(streams.table_stream(spark, str(tmp_path / "v"), 10), 2)
    drain(stream.writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    assert [tuple(r) for r in spark.table("stops").collect()] == [(1, 8)]
