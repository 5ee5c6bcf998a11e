"""Executables as tables against a plain reader, on files put together at random; the plan is one pass."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from bytebasin.operators import layout as lo


def executable(rng):
    """Inert bytes in the layout of an executable, with gaps, overlaps, wild sizes and cut ends."""
    e = rng.choice([0x40, 0x80, 0x81, 0xF0])
    plus = rng.random() < 0.4
    at = 108 if plus else 92
    n_dirs, n_sec = rng.choice([0, 5, 15, 16, 20]), rng.randint(0, 6)
    opt = at + 4 + 8 * n_dirs + rng.choice([0, 8])
    raw = 0x400
    head = bytearray(max(raw, e + 24 + opt + 40 * n_sec))
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 0x3C, e)
    head[e : e + 4] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", head, e + 4, rng.choice([0x14C, 0x8664]), n_sec, rng.randrange(2**32), 0, 0, opt, 0)
    struct.pack_into("<H", head, e + 24, 0x20B if plus else 0x10B)
    struct.pack_into("<I", head, e + 84, rng.choice([0, 0x200, raw, 10**9]))
    struct.pack_into("<I", head, e + 24 + at, n_dirs)
    body, sections = bytearray(), []
    for i in range(n_sec):
        size = rng.choice([0, 1, 64, 300])
        body += bytes(rng.choice([0, 0, 17]))
        off = rng.choice([raw + len(body), raw + len(body), 0, raw])
        vaddr = rng.choice([0x1000 * (i + 1), 0x1000 * i])
        flags = rng.choice([0x20000000, 0x40000000, 0xC0000040, 0xE0000020, 0x80000000, 0x02000040])
        struct.pack_into("<IIII", head, e + 24 + opt + 40 * i + 8, rng.choice([size, 0x1000]), vaddr, size, off)
        struct.pack_into("<I", head, e + 24 + opt + 40 * i + 36, flags)
        sections.append(vaddr)
        body += bytes(rng.randrange(256) for _ in range(size))
    tail = bytes(rng.choice([0, 0, 9, 200]))
    for k in range(min(16, n_dirs)):
        if rng.random() < 0.5:
            base = rng.choice(sections or [0x1000]) + rng.choice([0, 0, 0x10, 0x5000])
            struct.pack_into("<II", head, e + 24 + at + 4 + 8 * k, base if k != 4 else raw + len(body), rng.choice([0, 8, 72, 5000]))
    if sections and len(body) > 80 and rng.random() < 0.7:
        for o in (8, 24, 64):
            struct.pack_into("<II", body, o, rng.choice(sections), rng.choice([0, 16]))
    data = bytes(head + body) + tail
    return data[: rng.choice([len(data)] * 4 + [len(data) // 2])]


def plain(data):
    """Header fields, sections, directories and structure rows; None where there is no executable."""
    def number(at, width=4, of=data):
        part = of[at : at + width]
        return int.from_bytes(part, "little") if len(part) == width else None

    size = len(data)
    e = number(0x3C)
    if data[:2] != b"MZ" or e is None or data[e : e + 4] != b"PE\0\0":
        return None
    plus, n, opt = number(e + 24, 2) == 0x20B, number(e + 6, 2), number(e + 20, 2)
    head = (size, e, number(e + 4, 2), n, number(e + 8), opt, number(e + 84), plus)
    table, at = e + 24 + (opt or 0), e + 24 + (108 if plus else 92)
    sections = []
    for i in range(n or 0):
        b = table + 40 * i
        if b + 40 <= size:
            sections.append(dict(no=i, vsize=number(b + 8), vaddr=number(b + 12), raw_size=number(b + 16), raw_off=number(b + 20), flags=number(b + 36)))

    def place(rva):
        return next((rva - s["vaddr"] + s["raw_off"] for s in sections if s["vaddr"] <= rva < s["vaddr"] + s["vsize"]), None)

    def cut(a, z):
        a, z = max(0, a), min(size, z)
        return (a, z) if z > a else None

    dirs, clr = [], None
    for k in range(min(16, number(at) or 0)):
        rva, length = number(at + 4 + 8 * k), number(at + 8 + 8 * k)
        if rva and length and (start := rva if k == 4 else place(rva)) is not None:
            if k == 14:
                clr = (start, start + length)
            if r := cut(start, start + length):
                dirs.append((k, *r))
    spans = []
    if clr:
        spans.append(clr)
        inner = data[clr[0] : clr[0] + 72].ljust(72, b"\0")
        for o in (8, 24, 32, 40, 48, 56, 64):
            rva, length = number(o, of=inner), number(o + 4, of=inner)
            if rva and length and place(rva) is not None:
                spans.append((place(rva), place(rva) + length))
    for s in sections:
        s["managed"] = s["raw_size"] != 0 and any(s["raw_off"] < z and a < s["raw_off"] + s["raw_size"] for a, z in spans)
    rows = []
    heads = [("HEADERS", 0, head[6]), ("DOS_HEADER", 0, 64), ("DOS_STUB", 64, e), ("COFF_HEADER", e + 4, e + 24), ("OPTN_HEADER", e + 24, table), ("SECTN_TABLE", table, table + 40 * (n or 0))]
    heads = [(x, *r) for x, a, z in heads if z is not None and (r := cut(a, z))]
    raw = [(s, *r) for s in sections if s["raw_size"] and (r := cut(s["raw_off"], s["raw_off"] + s["raw_size"]))]
    last = max([s["raw_off"] + s["raw_size"] for s in sections if s["raw_size"] and s["raw_off"]], default=0)
    tail = [r] if (r := cut(last, size)) else []
    taken = sorted([h[1:] for h in heads if h[0] == "HEADERS"] + [r[1:] for r in raw] + tail + [d[1:] for d in dirs])
    covered = bytearray(size)
    for a, z in taken:
        covered[a:z] = b"\1" * (z - a)
    rest, i = [], 0
    while i < size:
        if not covered[i]:
            j = i
            while j < size and not covered[j]:
                j += 1
            rest.append((i, j))
            i = j
        else:
            i += 1
    fine = {0: "EDATA", 1: "IDATA", 2: "RESOURCE", 5: "RELOC", 6: "DEBUG", 9: "TLS", 10: "LOADCFG", 13: "DELAYIMP", 14: "CLR"}
    for level in ("COARSE", "ROUGH", "MIDDLE", "FINE"):
        rows += [(level, *h) for h in heads if (h[0] == "HEADERS") == (level != "FINE")]
        rows += [(level, "OVERLAY", *r) for r in tail] + [(level, "OTHER", *r) for r in rest]
        rows += [(level, fine.get(k, "OTHERDIR") if level == "FINE" else "DIRECTORY", a, z) for k, a, z in dirs]
        for s, a, z in raw:
            kind = "CODE" if s["flags"] & 0x20000000 else "DATA" if s["flags"] & 0x40000000 else None
            net = "DNET" if s["managed"] else ""
            label = {"COARSE": "SECTION", "ROUGH": "DNETSEC" if net else "OTHRSEC", "MIDDLE": kind and net + kind, "FINE": kind and ("W" if s["flags"] & 0x80000000 else "R") + net + kind}[level]
            rows += [(level, label, a, z)] if label else []
    rows += [(None, f, a, z) for s, a, z in raw for f, m in lo.FLAGS.items() if s["flags"] & m]
    return head, sections, dirs, sorted(rows, key=repr)


@pytest.fixture(scope="module")
def files():
    rng = random.Random(17)
    made = {f"x{i}": executable(rng) for i in range(150)}
    wild = bytearray(executable(random.Random(1)))
    struct.pack_into("<I", wild, 0x3C, 0xFFFFFFF0)
    return made | {"wild": bytes(wild), "none": b"MZ", "empty": b"", "text": b"hello", "elf": b"\x7fELF" + bytes(100), "null": None}


@pytest.fixture(scope="module")
def blobs(spark, files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blobs") / "files")
    spark.createDataFrame(list(files.items()), "name string, data binary").write.parquet(path)
    return spark.read.parquet(path)


def test_against_a_plain_reader(blobs, files):
    want = {n: p for n, d in files.items() if d is not None and (p := plain(d))}
    assert 100 < len(want) < len(files)
    assert {r["name"]: tuple(r)[1:] for r in lo.headers(blobs).collect()} == {n: p[0] for n, p in want.items()}
    got = {}
    for r in lo.sections(blobs).collect():
        got.setdefault(r["name"], []).append(dict(no=r.sec_no, vsize=r.vsize, vaddr=r.vaddr, raw_size=r.raw_size, raw_off=r.raw_off, flags=r["flags"], managed=r.managed))
    assert got == {n: p[1] for n, p in want.items() if p[1]}
    got = {}
    for r in lo.directories(blobs).collect():
        got.setdefault(r["name"], []).append((r.dir, r.start, r.end))
    assert got == {n: p[2] for n, p in want.items() if p[2]}
    got = {}
    for r in lo.structures(blobs).collect():
        got.setdefault(r["name"], []).append((r.level, r.label, r.start, r.end))
    assert {n: sorted(x, key=repr) for n, x in got.items()} == {n: p[3] for n, p in want.items() if p[3]}
    labels = {r[1] for p in want.values() for r in p[3]}
    assert {"OTHER", "OVERLAY", "DNETSEC", "WDNETDATA", "OTHERDIR"} <= labels


def test_one_scan_and_no_exchange(blobs):
    """From the blobs to all labelled ranges: one read, no shuffle, no join."""
    plan = lo.structures(blobs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert not any(x in plan for x in ("Exchange", "Join", "Python"))


def test_quarantine(blobs, files):
    good, bad = lo.quarantine(blobs)
    assert {r["name"] for r in good.select("name").collect()} == {n for n, d in files.items() if d is not None and plain(d)}
    reasons = {r["name"]: r.reject_reason for r in bad.collect()}
    assert {k: reasons[k] for k in ("wild", "none", "empty", "text", "elf", "null")} == {"wild": "no header", "none": "no header", "empty": "empty", "text": "no magic", "elf": "no magic", "null": "empty"}
    assert "Join" not in good._jdf.queryExecution().executedPlan().toString()


def test_repeated_names_stay_apart(spark, files):
    rows = [("same", files["x0"]), ("same", files["x1"]), ("same", files["x0"])]
    df = spark.createDataFrame(rows, "name string, data binary")
    assert lo.headers(df).count() == sum(plain(d) is not None for _, d in rows)
    assert lo.structures(df.limit(0)).count() == 0 and lo.structures(df).where(F.col("level") == "COARSE").count() == sum(r[0] == "COARSE" for _, d in rows for r in plain(d)[3])


def test_files_are_put_together_by_many_tasks(spark, sf):
    from bytebasin.plans import layout_queries as lq

    blobs = lq.executables(spark, sf)
    in_tasks = blobs.groupBy(F.spark_partition_id()).count().collect()
    assert len(in_tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_headers_do_not_read_sections(spark):
    plan = lo.headers(spark.createDataFrame([(1, bytearray(b"MZ"))], "name long, data binary"))._jdf.queryExecution().optimizedPlan().toString()
    assert "managed" not in plan and "entries" not in plan
