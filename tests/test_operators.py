"""Exact cases, invariants and equivalences of the operators."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytebasin import catalog
from bytebasin.functions import scalars as sc
from bytebasin.operators import batching as bt
from bytebasin.operators import bitmaps as bm
from bytebasin.operators import intervals as iv
from bytebasin.operators import metrics as mt
from bytebasin.operators import ranking as rk
from bytebasin.operators import signals as sg
from bytebasin.operators import splits as sp
from bytebasin.operators import stats as st

def random_regions(rng, blobs=5, most=9, longest=40):
    """(name, label, ord, start, end), no two of a blob beginning alike."""
    rows = []
    for n in range(blobs):
        for i, s in enumerate(rng.sample(range(200), rng.randint(0, most))):
            rows.append((n, rng.choice("PQRS"), i, s, s + rng.randint(1, longest)))
    return rows


def as_regions(spark, rows):
    return spark.createDataFrame(rows, "name long, label string, ord long, start long, end long")


@pytest.mark.parametrize("most", [1, 2, 5, 20])
def test_collapse(spark, most):
    rows = random_regions(random.Random(most))
    brute = []
    for n in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == n), key=lambda r: r[3])
        kept = mine if len(mine) <= most else mine[: most - 1]
        brute += [(n, r[1], r[3], r[4]) for r in kept]
        if len(mine) > most:
            brute.append((n, "rest", mine[most - 1][3], mine[-1][4]))
    assert sorted(map(tuple, iv.collapse(as_regions(spark, rows), most, "rest").collect())) == sorted(brute)
    with pytest.raises(ValueError):
        iv.collapse(as_regions(spark, rows), 0)


def test_caps(spark):
    rows = random_regions(random.Random(3))
    got = sorted((r["name"], r.start, r.end) for r in iv.cap_lengths(as_regions(spark, rows), 13).collect())
    assert got == sorted((n, s, min(e, s + 13)) for n, _, _, s, e in rows)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            iv.cap_lengths(as_regions(spark, rows), bad)


def test_masks_agree(spark):
    rng = random.Random(4)
    rows = [(n, x, i, s := rng.randint(0, 60), s + rng.randint(0, 20)) for n in range(6) for i, x in enumerate(rng.choices("ABCDE", k=5))]
    regions = iv.structure_flags(spark.createDataFrame(rows, "name long, label string, ord long, start long, end long"), "ABCDE")
    painted = {(r.name, r.pos): r.mask for r in iv.paint(regions).collect()}
    by_segment = {(r.name, p): r.mask for r in iv.segments(regions.where("end > start")).collect() for p in range(r.start, r.end)}
    assert painted == by_segment
    packed = {(r.name, r.label, r.byte): r.bits for r in iv.paint_packed(regions, ["name", "label"]).collect()}
    brute = {}
    for n, x, _, s, e in rows:
        for p in range(s, e):
            brute[n, x, p // 8] = brute.get((n, x, p // 8), 0) | 1 << p % 8
    assert packed == brute


@pytest.mark.parametrize("longest", [20, 150, 5000])
def test_overlap_join_is_the_plain_join(spark, longest):
    rng = random.Random(longest)

    def some(n):
        return [(rng.randint(0, 3), s := rng.randint(0, 300), s + rng.choice([rng.randint(0, 20), rng.randint(0, longest)]), i) for i in range(n)]

    a, b = some(60), some(60)
    left, right = (spark.createDataFrame(x, "name long, start long, end long, id long") for x in (a, b))
    brute = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]}
    got = [(r.id, r.r_id) for r in iv.overlap_join(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == brute
    assert {r.id for r in iv.overlap_join(left, right, how="left_semi").collect()} == {x for x, _ in brute}
    points = spark.createDataFrame([(k, p) for k in range(4) for p in range(0, 500, 7)], "name long, pos long")
    found = sorted((r["name"], r.pos, r.id) for r in iv.point_join(points, right).collect())
    assert found == sorted((k, p, y[3]) for k in range(4) for p in range(0, 500, 7) for y in b if y[0] == k and y[1] <= p < y[2])


def test_dense_order(spark):
    df = spark.createDataFrame([([3, 1],), ([],), ([1, 2, 3, 4],)], "o array<long>")
    assert [r.d for r in df.select(iv.dense_order(F.col("o"), 3, "ignore").alias("d")).collect()] == [[3, 1, -1], [-1, -1, -1], [1, 2, 3]]
    assert [r.d for r in df.select(iv.packed_order(iv.dense_order(F.col("o"), 3, "keep")).alias("d")).collect()] == [[3, 1], [], [1, 2, 3, 4]]
    with pytest.raises(Exception, match="longer"):
        df.select(iv.dense_order(F.col("o"), 3)).collect()


def test_pad_lengths(spark):
    rng = random.Random(11)
    for _ in range(12):
        longest, least, multiple = rng.randint(1, 90), rng.choice([0, 33, 70]), rng.choice([1, 3, 8])
        bins = rng.choice([None, (30, 60, 100)])
        wanted = max(longest, least)
        brute = next(n for n in bins if n >= wanted) if bins else next(n for n in range(wanted, 2 * wanted + 8) if n % multiple == 0)
        assert spark.range(1).select(sc.pad_length(F.lit(longest), least, multiple, bins)).first()[0] == brute


def test_collate_shifts_and_pads(spark):
    rng = random.Random(12)
    rows = [(b, s, 100 * b + s, [rng.randint(0, 255) for _ in range(rng.randint(0, 9))]) for b in range(4) for s in range(rng.randint(1, 5))]
    blobs = spark.createDataFrame([(b, s, n, bytes(v)) for b, s, n, v in rows], "batch long, slot long, name long, data binary")
    got = {r.batch: r for r in bt.collate(blobs.withColumn("tokens", bt.tokens_of("data")).drop("data"), least=4, multiple=4).collect()}
    for b in range(4):
        mine = [r for r in rows if r[0] == b]
        length = max(4, -(-max(len(r[3]) for r in mine) // 4) * 4)
        assert got[b].length == length and got[b].names == [r[2] for r in mine] and got[b].lengths == [len(r[3]) for r in mine]
        assert [np.frombuffer(t, "<u2").tolist() for t in got[b].tokens] == [[x + 1 for x in r[3]] + [0] * (length - len(r[3])) for r in mine]


def test_entropy_windows(spark):
    rng = np.random.default_rng(2)
    blobs = [(i, rng.integers(0, 1 + i * 20, n, dtype=np.uint8).tobytes() if i else bytes(n)) for i, n in enumerate((15, 17, 64, 65, 257, 300))]
    samples = spark.createDataFrame([(i, b, len(b)) for i, b in blobs], "name long, data binary, size long")
    for radius, stride in ((1, 1), (3, 1), (3, 5), (16, 7), (31, 63)):
        got = {(r["name"], r["k"]): (r["start"], r["end"], r["entropy"]) for r in sg.window_entropy(samples, radius, stride).collect()}
        brute = {}
        for i, b in blobs:
            if len(b) <= 2 * radius + 1:
                continue
            for k in range(math.ceil((len(b) - 2 * radius) / stride)):
                w = b[k * stride : k * stride + 2 * radius + 1]
                counts = np.bincount(np.frombuffer(w, np.uint8))
                p = counts[counts > 0] / len(w)
                start = k * stride + radius
                brute[i, k] = (start, min(start + stride, len(b)), float(-(p * np.log2(p)).sum()))
        assert got.keys() == brute.keys()
        assert all(got[k][:2] == v[:2] and abs(got[k][2] - v[2]) < 1e-9 and -1e-9 <= v[2] <= 8 for k, v in brute.items())
        if stride == 1:
            rolled = {(r["name"], r["start"]): r["entropy"] for r in sg.rolling_entropy(samples, radius).collect()}
            assert rolled.keys() == {(i, s) for (i, _), (s, _, _) in brute.items()}
            assert all(abs(rolled[i, s] - h) < 1e-9 for (i, _), (s, _, h) in brute.items())
    for bad in ((0, 1), (1, 0), (1, 4)):
        with pytest.raises(ValueError):
            sg.window_entropy(samples, *bad)


def test_byte_maxima_are_those_of_the_signal(spark):
    rng = np.random.default_rng(7)
    blobs = [(i, rng.integers(0, 6, n, dtype=np.uint8).tobytes()) for i, n in enumerate((0, 1, 5, 8, 9, 100))]
    samples = spark.createDataFrame(blobs, "name long, data binary")
    signal = spark.createDataFrame([(i, p, v) for i, b in blobs for p, v in enumerate(b)], "name long, pos long, value long")
    assert sorted(map(tuple, sg.byte_patch_maxima(samples, 8).collect())) == sorted(map(tuple, sg.patch_maxima(signal, 8).collect()))
    assert sorted(map(tuple, sg.byte_patch_maxima(samples).drop("patch").collect())) == sorted(map(tuple, sg.maxima(signal).collect()))


@pytest.mark.parametrize("name", ["entropy_by_label", "patch_max", "sequence_max", "sliding_entropy_s64", "byte_histogram"])
def test_byte_queries_shuffle_no_bytes(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and ("Aggregate" not in plan or name == "entropy_by_label")


def test_maxima_take_the_first_place(spark):
    signal = spark.createDataFrame([(1, p, float(v)) for p, v in enumerate([1, 5, 5, 2, 7, 7, 0])], "name long, pos long, value double")
    assert sorted(tuple(r) for r in sg.patch_maxima(signal, 3).collect()) == [(1, 0, 5.0, 1), (1, 1, 7.0, 4), (1, 2, 0.0, 6)]
    assert tuple(sg.maxima(signal).first()) == (1, 7.0, 4)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 129])
def test_bitmaps(spark, n):
    rng = random.Random(n)
    bits = [rng.random() < 0.5 for _ in range(n)]
    flags = spark.createDataFrame([(1, i, b) for i, b in enumerate(bits)], "name long, pos long, value boolean")
    packed = bm.pack(flags, ["name"])
    assert sorted((r.pos, r.value) for r in bm.unpack(packed.withColumn("n", F.lit(n)), "n").collect()) == list(enumerate(bits))
    keep = sorted(rng.sample(range(n), (n + 1) // 2))
    chosen = spark.createDataFrame([(1, p) for p in keep], "name long, pos long")
    got = {r.byte: r.bits for r in bm.select(packed, chosen, ["name"]).collect()}
    brute = {}
    for i, p in enumerate(keep):
        brute[i // 8] = brute.get(i // 8, 0) | bits[p] << i % 8
    assert got == brute


def timed(spark, n=1000):
    rng = [(0, 400, 0.8), (400, 600, 0.5), (600, 1000, 0.2)]
    rows = [(i, i, int(i % 5 >= round(5 * share))) for lo, hi, share in rng for i in range(lo, hi)]
    return spark.createDataFrame(rows[:n], "idx long, ts long, label int")


SHARES = [(0.6, 0.2, 0.2), (0.33, 0.33, 0.33), (0.6, 0.2, 0.1), (0.5, 0.25, 0.25)]


@pytest.mark.parametrize("shares", SHARES)
def test_splits(spark, shares):
    df = timed(spark)
    counts = sp.largest_remainder(1000, shares)
    for split in (sp.random_split(df, shares, 5), sp.random_split(df, shares, None), sp.temporal_split(df, shares)):
        got = [(r.idx, r.split) for r in split.collect()]
        assert len({i for i, _ in got}) == len(got) and [sum(s == k for _, s in got) for k in range(3)] == counts
    t = {r.idx: r.split for r in sp.temporal_split(df, shares).collect()}
    assert sorted(t, key=lambda i: i) == sorted(t, key=lambda i: (t[i], i))
    assert sp.random_split(df, shares, 5).exceptAll(sp.random_split(df, shares, 5)).isEmpty()


def test_largest_remainder():
    assert sp.largest_remainder(10, (0.33, 0.33, 0.33)) == [4, 3, 3] and sp.largest_remainder(0, SHARES[0]) == [0, 0, 0]
    for bad in ((0.6, 0.6, 0), (-0.1, 0.5, 0.5)):
        with pytest.raises(ValueError):
            sp.largest_remainder(10, bad)


def test_stratified_keeps_ratios(spark):
    df = timed(spark)
    got = [(r.label, r.split) for r in sp.stratified_split(df, SHARES[0], seed=1).collect()]
    ratio = df.agg(F.avg("label")).first()[0]
    for k in range(3):
        labels = [x for x, s in got if s == k]
        assert abs(sum(labels) / len(labels) - ratio) < 0.01
    assert sp.class_quotas({0: 3, 1: 1}, [2, 2, 0], {0: 0.5, 1: 0.5}) == [(0, 0, 0, 1), (1, 0, 0, 1), (0, 1, 1, 3), (1, 1, 1, 1), (0, 2, 3, 3), (1, 2, 1, 1)]
    # ratios are weights of all classes
    assert sp.class_quotas({0: 100, 1: 100}, [60, 20, 20], {0: 3, 1: 1}) == sp.class_quotas({0: 100, 1: 100}, [60, 20, 20], {0: 0.75, 1: 0.25})
    assert sum(hi - lo for _, s, lo, hi in sp.class_quotas({0: 100, 1: 100}, [60, 20, 20], {0: 1, 1: 1}) if s == 0) == 60
    for bad in ({0: 1}, {0: -1, 1: 2}, {0: 0, 1: 0}, {0: 1, 1: 1, 2: 1}):
        with pytest.raises(ValueError):
            sp.class_quotas({0: 3, 1: 1}, [2, 2, 0], bad)


def test_rows_without_a_label_are_a_class(spark):
    rows = [(i, [None, 0, 1, 1][i % 4]) for i in range(200)]
    got = [(r.label, r.split) for r in sp.stratified_split(spark.createDataFrame(rows, "idx long, label int"), (0.5, 0.25, 0.25)).collect()]
    assert len(got) == 200 and [sum(x is None and s == k for x, s in got) for k in range(3)] == [25, 12, 13] or [sum(x is None and s == k for x, s in got) for k in range(3)] == [25, 13, 12]


def plain_balanced(labels, shares, weights, shift, step, penalty, tolerance):
    """(begin, p, q end, q, end) by trying all cuts, then all trims."""
    n, classes = len(labels), sorted(set(labels))
    tr, vl, ts = sp.largest_remainder(n, shares)
    target = [weights[c] / sum(weights.values()) for c in classes] if weights else None

    def dist(a, b):
        part = labels[a:b]
        return [part.count(c) / len(part) if part else 1 / len(classes) for c in classes]

    def apart(ds):
        pairs = [(d, target) for d in ds] if target else [(ds[i], ds[j]) for i in range(len(ds)) for j in range(i)]
        return [[abs(x - y) for x, y in zip(a, b)] for a, b in pairs]

    def rated(p, q):
        e = q + min(ts, n - q)
        found = apart([dist(0, p), dist(p, q), dist(q, e)])
        ok = tolerance is not None and all(max(d) <= tolerance for d in found)
        return not ok, round(sum(map(sum, found)) + penalty * (abs(p - tr) + abs(q - p - vl) + abs(e - q - ts)), 9), (p, q) != (tr, tr + vl), p, q, e

    p_lo = max(0, tr - shift)
    grid = [(tr, tr + vl)] + [(p, q) for p in range(p_lo, min(n, tr + shift) + 1, step) for q in range(max(p, p_lo, tr + vl - shift), min(n, tr + vl + shift) + 1, step)]
    off, _, _, p, q, e = min(rated(*c) for c in grid)
    if tolerance is not None and off:
        trims = [0, 0, 0]
        if target:
            cuts = [lambda t: (t, p), lambda t: (p, q - t), lambda t: (q, e - t)]
            lengths = [p, q - p, e - q]
            trims = [next((t for t in range(0, m + 1, step) if max(apart([dist(*c(t))])[0]) <= tolerance), 0) for c, m in zip(cuts, lengths)]
        if all(max(d) <= tolerance for d in apart([dist(trims[0], p), dist(p, q - trims[1]), dist(q, e - trims[2])])):
            return trims[0], p, q - trims[1], q, e - trims[2]
    return 0, p, q, q, e


@pytest.mark.parametrize("case", [
    (2, None, 0, 10, 0.05, None), (2, None, 40, 10, 0.001, None), (3, None, 30, 7, 0.0005, 0.3), (3, {0: 2, 1: 1, 2: 1}, 30, 10, 0.001, 0.25), (2, {0: 7, 1: 6}, 0, 5, 0.05, 0.1), (2, {0: 1, 1: 9}, 20, 5, 0.05, 0.01), (2, None, 300, 60, 0.0001, 0.05),
])
def test_balanced_split_is_the_plain_search(spark, case):
    k, weights, shift, step, penalty, tolerance = case
    rng = random.Random(str(case))
    labels = [min(k - 1, int(rng.random() * (1 + (k - 0.5) * i / 300))) for i in range(300)]
    df = spark.createDataFrame([(i, i, y) for i, y in enumerate(labels)], "idx long, ts long, label int")
    for shares in ((0.6, 0.2, 0.2), (0.5, 0.2, 0.1), (0.7, 0.0, 0.3)):
        begin, p, q_end, q, e = plain_balanced(labels, shares, weights, shift, step, penalty, tolerance)
        want = {i: s for s, (a, b) in enumerate([(begin, p), (p, q_end), (q, e)]) for i in range(a, b)}
        assert {r.idx: r.split for r in sp.balanced_split(df, shares, weights, shift, step, penalty, tolerance).collect()} == want, shares
    with pytest.raises(ValueError):
        sp.balanced_split(df, shares, max_shift=-1)


def test_empty_splits(spark):
    df = timed(spark, 0)
    assert all(s.count() == 0 for s in (sp.random_split(df, SHARES[0], 1), sp.temporal_split(df, SHARES[0]), sp.stratified_split(df, SHARES[0]), sp.balanced_split(df, SHARES[0])))


@pytest.mark.parametrize("n,per_shard", [(1, 1), (3, 2), (10, 5), (100, 7)])
def test_shards_by_count(spark, n, per_shard):
    rows = rk.shards_by_count(spark.range(n), per_shard, "id").collect()
    assert {r.id: r.shard for r in rows} == {i: i // per_shard for i in range(n)} and len({r.idx for r in rows}) == n


@pytest.mark.parametrize("budget,sizes", [(1024, "mixed"), (4096, "mixed"), (2**14, "mixed"), (2**16, "mixed"), (2**16, "alike"), (10**9, "mixed"), (2**14, "empty")])
def test_shards_by_bytes(spark, budget, sizes):
    rng = random.Random(budget)
    sizes = [{"mixed": rng.randint(0, 10000), "alike": 5000, "empty": rng.choice([0, 0, 0, 9000, 20000])}[sizes] for _ in range(300)]
    got = {r.idx: r.shard for r in rk.shards_by_bytes(spark.createDataFrame(list(enumerate(sizes)), "idx long, size long").repartition(3), budget).collect()}
    shard, held, brute = 0, None, {}
    for i, x in enumerate(sizes):
        padded = -(-x // 4096) * 4096
        if held is not None and held + padded > budget:
            shard, held = shard + 1, None
        held = (held or 0) + padded
        brute[i] = shard
    assert got == brute
    assert rk.shards_by_bytes(spark.createDataFrame([], "idx long, size long"), budget).count() == 0


def test_ranks_and_sums_take_one_shuffle_and_no_window_over_all(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.randint(0, 9), rng.random()) for i in range(200)], "i long, k long, x double").repartition(5)
    order = sorted(df.collect(), key=lambda r: (r.k, r.i))
    assert {r.i: r["rank"] for r in rk.global_rank(df, "k", "i").collect()} == {r.i: n for n, r in enumerate(order)}
    total, want = 0, {}
    for r in order:
        want[r.i] = total = total + r.x
    assert {r.i: r.sum_x for r in rk.running_sums(df, ["k", "i"], "x").collect()} == pytest.approx(want)
    plan = rk.global_rank(df, "k", "i")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_salting():
    assert bt.salt_plan({0: 8, 1: 4, 2: 4}, 16) == {0: (3, 4), 1: (7, 4), 2: (11, 4)}
    assert bt.salt_plan({5: 1, 9: 1, 2: 30}, 13) == {5: (5, 1), 9: (9, 1), 2: (10, 8)}
    plan = bt.salt_plan({i: 1 + 100 * (i == 3) for i in range(10)}, 40)
    assert sum(m for _, m in plan.values()) <= 30 and plan[3][1] >= 16 and all(m & (m - 1) == 0 for _, m in plan.values())
    for bad in ({0: 1, 1: 1}, 3), ({0: 1, 1: 1}, 1):
        with pytest.raises(ValueError):
            bt.salt_plan(*bad)


def test_salted_tokens(spark):
    rows = spark.createDataFrame([(t, p, r) for t in (0, 1, 7) for p in range(5) for r in range(2)], "token long, pos long, row long")
    got = {(r.token, r.pos, r.row): r.salted for r in bt.salted(rows, {0: (8, 4), 1: (1, 1)}, 3).collect()}
    assert got == {(t, p, r): 8 + (p + 3 * r) % 4 if t == 0 else t for t in (0, 1, 7) for p in range(5) for r in range(2)}


def scores(spark, rows):
    return spark.createDataFrame([(int(y), float(s)) for y, s in rows], "label int, score double")


@pytest.mark.parametrize("rows,roc,prc", [
    ([(1, 0.9), (1, 0.8), (0, 0.2)], 1.0, 1.0), ([(1, 0.5), (0, 0.5)], 0.5, 0.5), ([(1, 0.5), (1, 0.4)], 0.5, 1.0), ([(0, 0.5)], 0.5, 0.0), ([(0, 0.9), (1, 0.1)], 0.0, 0.5),
])
def test_areas(spark, rows, roc, prc):
    assert mt.auroc(scores(spark, rows)).first()[0] == pytest.approx(roc)
    assert mt.auprc(scores(spark, rows)).first()[0] == pytest.approx(prc)


def test_early_stop(spark):
    values = [0.5, 0.625, 0.6251, 0.6255, 0.6259, 0.6, 0.6, 0.6]
    log = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], "run long, step long, value double")
    assert mt.early_stop(log, 2, threshold=2**-10).first().stop == 5
    assert mt.early_stop(log, 2).first().stop == 8
    assert mt.early_stop(log.withColumn("value", -F.col("value")), 2, mode="min").first().stop == 8


def test_scalar_errors():
    with pytest.raises(ValueError):
        sc.patch_size(F.lit(1), 1, 1)
    with pytest.raises(ValueError):
        sc.pad_length(F.lit(1), multiple=0)


def test_fingerprint_tells_order(spark):
    a = spark.createDataFrame([(0, i, i) for i in range(3000)], "split int, rank long, idx long")
    b = a.withColumn("idx", F.when(F.col("rank") == 5, 6).when(F.col("rank") == 6, 5).otherwise(F.col("idx")))
    one, two, three = (st.ordered_fingerprint(x, "idx", "split").first().digest for x in (a, a.repartition(5), b))
    assert one == two != three


def test_fingerprint_has_two_levels(spark):
    rows = spark.createDataFrame([(0, i, 7 * i) for i in range(100)], "split int, rank long, idx long")  # more than squared buckets
    md5 = lambda parts: hashlib.md5(",".join(map(str, parts)).encode()).hexdigest()
    want = md5(md5(7 * i for i in range(lo, lo + 4)) for lo in range(0, 100, 4))
    assert st.ordered_fingerprint(rows, "idx", "split", bucket=4).collect() == [(0, want, 100)]


def test_tokens_of_a_batch_as_it_lies():
    import pyarrow as pa

    blobs = pa.array([b"zz", b"a\xff", None, b"", b"b"], pa.binary())
    assert bt.tokens_of.func(blobs.slice(1)).to_pylist() == [b"b\0\0\1", b"", b"", b"c\0"]
    assert bt.tokens_of.func(blobs.slice(5)).to_pylist() == []


def test_regions_take_more_tasks_for_more_rows(spark, sf, monkeypatch):
    from bytebasin.sources import tables as tb

    n = tb.read(spark, sf, "lineitem").count()
    monkeypatch.setattr(tb, "MOST_ROWS", n // 9)
    in_tasks = tb.regions(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(in_tasks) >= 9 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = catalog.QUERIES["segment_flags"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and all("REPARTITION_BY_NUM" in x for x in plan.split("\n") if "Exchange" in x)
