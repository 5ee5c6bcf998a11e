"""Bitmaps by words, ranges of them, painted masks; rolling entropy in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytebasin.operators import bitmaps as bm
from bytebasin.operators import intervals as iv
from bytebasin.operators import signals as sg


def packed(bits):
    """Bits as {byte: value}, of those bytes that have any."""
    return {i: sum(int(b) << k for k, b in enumerate(bits[8 * i : 8 * i + 8])) for i in range(-(-len(bits) // 8))}


def by_name(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["name"], {})[r.byte] = r.bits
    return out


@pytest.fixture(scope="module")
def maps(spark):
    rng = random.Random(4)
    bits = {f"n{n}": [rng.random() < 0.5 for _ in range(n)] for n in (1, 8, 63, 64, 65, 200, 1000)}
    rows = [(n, i, b) for n, x in bits.items() for i, b in enumerate(x)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "name string, pos long, value boolean").repartition(3)
    return bits, df


def test_pack_and_select(spark, maps):
    bits, df = maps
    rng = random.Random(5)
    bitmap = bm.pack(df, ["name"])
    assert by_name(bitmap) == {n: packed(x) for n, x in bits.items()}
    chosen = {n: sorted(rng.sample(range(len(x)), (len(x) + 2) // 3)) for n, x in bits.items()}
    # positions that come twice count once, those that the bitmap hasn't don't count
    rows = [(n, p) for n, x in chosen.items() for p in [*x, x[0], 5000]]
    got = by_name(bm.select(bitmap, spark.createDataFrame(rows, "name string, pos long"), ["name"]))
    assert got == {n: packed([bits[n][p] for p in x]) for n, x in chosen.items()}


def test_select_ranges(spark, maps):
    bits, df = maps
    rng = random.Random(6)
    bitmap = bm.pack(df, ["name"])
    whole = {n: x + [False] * (-len(x) % 8) for n, x in bits.items()}
    ranges = {n: [tuple(sorted(rng.choices(range(len(x) + 20), k=2))) for _ in range(9)] + [(0, len(x)), (3, 3), (len(x) + 500, len(x) + 900), (-4, 2)] for n, x in whole.items()}
    rows = [(n, a, z, k) for n, x in ranges.items() for k, (a, z) in enumerate(x)]
    got = by_name(bm.select_ranges(bitmap, spark.createDataFrame(rows, "name string, start long, end long, k long"), ["name"], order="k"))
    want = {n: packed([b for a, z in x if a >= 0 for b in whole[n][a:z]]) for n, x in ranges.items()}
    assert got == {n: x for n, x in want.items() if x}
    assert bm.select_ranges(bitmap, spark.createDataFrame([], "name string, start long, end long"), ["name"]).count() == 0


def shuffled(spark, df):
    """Rows that the exchanges of a plan have written, from the leaves up."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        found, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found[::-1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_shuffled_are_words(spark):
    """6,400 positions in two tasks are 100 words, and so is a range as long."""
    positions = spark.range(0, 6400, 1, 2).select(F.lit("a").alias("name"), F.col("id").alias("pos"), (F.col("id") % 3 == 0).alias("value"))
    assert shuffled(spark, bm.pack(positions, ["name"])) == [100]
    assert max(shuffled(spark, bm.select(bm.pack(positions, ["name"]), positions.where("pos % 2 = 0"), ["name"]))) <= 100
    region = spark.createDataFrame([("a", 1, 0, 6400), ("a", 2, 64, 128)], "name string, mask long, start long, end long").repartition(2)
    assert max(shuffled(spark, iv.paint(region))) <= 101
    assert max(shuffled(spark, iv.paint_packed(region))) <= 101


def test_painting(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), 1 << rng.randrange(4), s, s + rng.choice([0, 1, 5, 63, 64, 65, 200])) for s in (rng.randrange(300) for _ in range(40))]
    df = spark.createDataFrame(rows, "name string, mask long, start long, end long")
    want = {}
    for n, m, s, e in rows:
        for p in range(s, e):
            want[n, p] = want.get((n, p), 0) | m
    assert {(r["name"], r.pos): r["mask"] for r in iv.paint(df).collect()} == want
    got = by_name(iv.paint_packed(df))
    assert {(n, 8 * b + k) for n, x in got.items() for b, v in x.items() for k in range(8) if v >> k & 1} == set(want)


@pytest.mark.parametrize("radius, stride", [(1, 1), (2, 3), (16, 1), (50, 7)])
def test_rolling_entropy_is_the_windows_own(monkeypatch, radius, stride):
    monkeypatch.setattr(sg, "ROLL", 256)
    rng = np.random.default_rng(radius)
    for n, top in ((2 * radius + 2, 3), (1000, 2), (3000, 256)):
        x = rng.integers(0, top, n).astype(np.uint8)
        got = np.concatenate(list(sg.entropies(x, radius, stride)))
        width = 2 * radius + 1
        want = []
        for a in range(0, n - width + 1, stride):
            c = np.unique(x[a : a + width], return_counts=True)[1] / width
            want.append(-(c * np.log2(c)).sum())
        assert got.shape == (len(want),) and np.allclose(got, want, atol=1e-9)


def test_rolling_entropy_holds_a_chunk():
    """Memory does not grow with the blob, and rounding does not add up along it."""
    rng = np.random.default_rng(1)

    def peak(n):
        x = rng.integers(0, 256, n).astype(np.uint8)
        tracemalloc.start()
        last = None
        for last in sg.entropies(x, 128, 1):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        c = np.unique(x[-257:], return_counts=True)[1] / 257
        assert abs(last[-1] + (c * np.log2(c)).sum()) < 1e-9
        return most

    small, large = peak(1 << 19), peak(1 << 22)
    assert large < 1.2 * small < 20 << 20
