"""Fingerprints: collision rates against generalised Jaccard similarity, neighbours against a plain loop."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytebasin.llm import fingerprints as fp
from bytebasin.llm.common import ordered_ranges
from bytebasin.llm.queries import op7_fingerprints
from bytebasin.llm.words import words_of


def jaccard(a, b):
    wa, wb = ({w: 1 + math.log(n) for w, n in Counter(words_of(t)).items()} for t in (a, b))
    keys = wa.keys() | wb.keys()
    return sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)


def test_collisions_follow_similarity():
    sampler = fp.WeightedSampler(4096, 5000)
    pairs = [("a b c d", "a b c e"), ("a " * 30 + "b c", "a b c"), ("a a b", "b b a"), (" ".join(map(str, range(90))), " ".join(map(str, range(30, 120)))), ("x " * 9 + "y", "x " * 3 + "y y z")]
    for a, b in pairs:
        got = fp.likeness(sampler.signature(sampler.bag(a)), sampler.signature(sampler.bag(b)))
        assert abs(got - jaccard(a, b)) < 0.035, (a, b)


def test_cache_does_not_change_signatures():
    texts = [" ".join(f"w{(i * j) % 97}" for i in range(60)) for j in range(30)] + ["", "!?", "!"]
    small, large = fp.WeightedSampler(16, 40), fp.WeightedSampler(16, 10_000)
    for t in texts + texts:
        assert (small.signature(small.bag(t)) == large.signature(large.bag(t))).all()
    assert len({fp.fingerprint(large.signature(large.bag(t))) for t in ("", "!?", "!")}) == 3


def hashes(spark, docs):
    texts = spark.createDataFrame([(t or "",) for _, t in docs], "text string").distinct()
    return {r.text: r.of for r in texts.select("text", F.xxhash64("text").alias("of")).collect()}


def expected(docs, of, samples=fp.SAMPLES):
    sampler = fp.WeightedSampler(samples, 20_000)
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), -of[d[1] or ""]))
    out = []
    for i, (number, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        a, b, c = (sampler.signature(sampler.bag(t)) for t in (text, new, after))
        out.append((number, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.fingerprint(a), fp.fingerprint(b), float(np.mean(a == b)), float(np.mean(a == c))))
    return sorted(out, key=str)


@pytest.mark.parametrize("docs", [
    [(1, "only one")], [], [(5, "a b c d e f"), (5, "a b c d e f"), (5, "b"), (2, None), (9, ""), (None, "null id"), (None, None), (-3, "é😀" * 50)],
    [(i * 7 % 101, f"text {i} " * (i % 9)) for i in range(101)], [(7, "x"), (7, "y"), (7, "z")], [(None, "x"), (None, "y")],
    [(7 if i % 3 else 2**60 + i, f"text {i}") for i in range(90)] + [(None, f"none {i}") for i in range(40)] + [(1, f"one {i}") for i in range(20)],
])
def test_neighbours(spark, docs):
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, range int").repartition(3)
    got = sorted(map(tuple, fp.with_neighbour_likeness(frame).collect()), key=str)
    assert got == expected(docs, hashes(spark, docs))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op7_fingerprints(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == expected(docs, hashes(spark, docs))
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95


def test_column(spark):
    got = fp.with_fingerprints(spark.createDataFrame([("a b",), ("A, b!",), (None,), ("",)], "text string")).collect()
    assert got[0].fingerprint == got[1].fingerprint and got[2].fingerprint == got[3].fingerprint != got[0].fingerprint


def test_ranges_rise_and_split_many_rows_of_one_key(spark):
    rows = [(5 if i < 400 else None if i < 700 else i % 300, i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k long, i long").withColumn("tie", F.xxhash64("i"))
    found, n = ordered_ranges(frame, "k", "tie", 10)
    got = [(r.k, r.tie, r.range) for r in found.collect()]
    got.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ranges = [r for _, _, r in got]
    assert ranges == sorted(ranges) and 0 <= ranges[0] <= ranges[-1] < n
    assert max(ranges.count(r) for r in set(ranges)) <= 200
