"""Similarity classes against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytebasin.llm import ngram_join as nj
from bytebasin.llm.components import connected_components
from bytebasin.llm.queries import op2_ngram_join
from bytebasin.llm.words import words_of


def sets(text, n=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def expected(docs, threshold=0.8):
    nodes = {}
    for number, text in docs:
        if s := sets(text):
            nodes.setdefault(s, []).append(number)
    keys = list(nodes)
    index = {}
    for i, s in enumerate(keys):
        for g in s:
            index.setdefault(g, []).append(i)
    root, links = list(range(len(keys))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(keys):
        common = Counter(j for g in s for j in index[g] if j < i)
        for j, c in common.items():
            if c >= threshold * (len(s) + len(keys[j]) - c):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, s in enumerate(keys):
        for d in nodes[s]:
            r = find(i)
            least[r] = d if least.get(r) is None else (least[r] if d is None else min(d, least[r]))
    out = []
    for number, text in docs:
        s = sets(text)
        i = keys.index(s) if s else None
        out.append((number, least[find(i)] if s else number, links[i] if s else 0, len(nodes[s]) if s else 1))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, nj.similarity_classes(frame).collect()), key=str)


def near_copies(rng, groups, most, words=80):
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randint(0, words - 1)] = f"x{rng.randint(0, 9)}"
            docs.append(" ".join(copy))
    return docs


def test_groups_of_near_copies(spark):
    rng = random.Random(8)
    texts = near_copies(rng, 25, 8) + [None, "", "?!", "?", "one two", "One, two", "two one", "a b c d e", "a b c d e f"]
    docs = list(enumerate(texts)) + [(0, texts[0]), (0, texts[0]), (None, texts[1]), (None, "null only"), (3, "same id other text")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, node int, label int")
    assert got(frame) == expected(docs)
    assert nj.similarity_classes(frame.limit(0)).count() == 0


def test_large_group_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "SMALL", 3)
    monkeypatch.setattr(nj, "BLOCK", 16)
    rng = random.Random(9)
    docs = list(enumerate(near_copies(rng, 3, 1) + near_copies(rng, 1, 150) + near_copies(rng, 4, 20)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert got(frame) == expected(docs)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op2_ngram_join(spark, sf).collect()), key=str) == expected(docs)


def ranked(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.text): r.of for r in frame.select("doc_id", "text", F.xxhash64("text").alias("of")).collect()}


def one_of_each(spark, docs):
    """Rows that have to stay: of each class of all rows that have an id the first by id and hash, and all other rows."""
    of, named = ranked(spark, docs), {}
    classes = class_of([t for _, t in docs])
    out = []
    for number, text in docs:
        if number is None or not words_of(text):
            out.append((number, text))
        else:
            named.setdefault(classes[text], set()).add((number, of[number, text], text))
    return sorted(out + [(n, t) for n, _, t in map(min, named.values())], key=str)


def class_of(texts, threshold=0.8):
    """A representative for each text, alike within a class: all pairs are compared."""
    nodes = sorted({sets(t) for t in texts if words_of(t)}, key=sorted)
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i):
            c = len(a & nodes[j])
            if c >= threshold * (len(a) + len(nodes[j]) - c):
                root[find(i)] = find(j)
    at = {s: i for i, s in enumerate(nodes)}
    return {t: find(at[sets(t)]) for t in texts if words_of(t)}


def test_one_of_each_class(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(4, base), (2, base + " x"), (9, base), (7, "alone here with a few words"), (8, None), (8, None), (10, ""), (10, ""), (2, base + " x"), (None, base), (None, base), (None, None)]
    docs += [(1, "a text of its own"), (2, "another text under an id that goes"), (4, "yet another one"), (9, "yet another one")]
    frame = spark.createDataFrame([(*d, "o", 1) for d in docs], "doc_id long, text string, `of` string, label int")
    kept = nj.one_of_each_class(frame)
    assert kept.columns == frame.columns
    want = [(2, base + " x"), (7, docs[3][1]), (8, None), (8, None), (10, ""), (10, ""), (None, base), (None, base), (None, None), (1, docs[12][1]), (2, docs[13][1]), (4, docs[14][1])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str) == one_of_each(spark, docs)
    assert nj.one_of_each_class(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 256])
def test_one_of_each_class_at_random(spark, monkeypatch, block):
    """Large groups, chains of near copies whose ends are far apart, repeated and null ids."""
    monkeypatch.setattr(nj, "SMALL", 3)
    monkeypatch.setattr(nj, "BLOCK", block)
    rng = random.Random(block)
    texts = near_copies(rng, 3, 1) + near_copies(rng, 1, 90) + near_copies(rng, 6, 12) + [None, "", "?!"]
    chain = [f"w{rng.randint(0, 5000)}" for _ in range(90)]
    for i in range(40):
        chain[2 * i] = f"y{i}"
        texts.append(" ".join(chain))
    docs = [(rng.choice([None, *range(150)]), t) for t in texts for _ in range(rng.choice([1, 1, 2]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, nj.one_of_each_class(frame).collect()), key=str) == one_of_each(spark, docs)


def test_near_copy_without_an_id(spark):
    base = [f"w{i}" for i in range(80)]
    other = [*base[:40], "x", *base[41:]]
    docs = [(None, " ".join(base)), (None, " ".join(base)), (5, " ".join(other)), (None, "w1 w2 w3"), (None, " ".join(other + ["end"]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(frame) == expected(docs) and [r[1] for r in got(frame)].count(5) == 4


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        both = rng.integers(0, 2**63, 3000).astype(np.uint64)
        cut = int(3000 * (1 - share) / 2)
        a, b = np.unique(both[: 3000 - cut]), np.unique(both[cut:])
        true = (3000 - 2 * cut) / 3000
        assert abs((nj.minhash(a) == nj.minhash(b)).mean() - true) < 0.15


def test_pruning_keeps_what_the_posterior_allows():
    for n in (25, 50, 125):
        m = nj.least_matches(n)
        # numerically: the posterior's share at or above the threshold
        def share(k, n=n):
            grid = (np.arange(20000) + 0.5) / 20000
            d = np.exp(k * np.log(grid) + (n - k) * np.log(1 - grid) + math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n - k + 1))
            return d[grid >= nj.THRESHOLD].sum() / 20000

        assert share(m) >= nj.TOLERANCE * 0.9 and share(m - 1) < nj.TOLERANCE * 1.1


@pytest.mark.parametrize("edges,want", [
    ([], {}), ([(1, 2)], {1: 1, 2: 1}), ([(i, i + 1) for i in range(50)], {i: 0 for i in range(51)}),
    ([(5, 5), (9, 3), (3, 7), (20, 21), (9, 3)], {9: 3, 3: 3, 7: 3, 20: 20, 21: 20}),
])
def test_components(spark, edges, want):
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in found.collect()} == want


def test_many_different_near_copies_take_linear_work(spark, monkeypatch):
    """2,000 different near copies of one text, and a few farther ones: those near the least node never meet in pairs."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(2000)]
    # farther from the rest, linked with them all the same; one that is linked with none; an exact copy
    for i in range(2000, 2008):
        rows.append((i, " ".join([*base[:60], f"a{i}", *base[60:], f"own{i}"])))
    rows += [(3000, " ".join(base[:70])), (3001, rows[5][1])]
    dealt = []
    real = nj._compared

    def compared(blocks, threshold):
        dealt.append(blocks.count())
        return real(blocks, threshold)

    monkeypatch.setattr(nj, "BLOCK", 64)
    monkeypatch.setattr(nj, "_compared", compared)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in nj.similarity_classes(docs).collect()}
    sets = {i: set(nj.shingles(t).tolist()) for i, t in rows}
    nodes = {frozenset(s) for s in sets.values()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    for i in [0, 1, 5, 999, *range(1995, 2008), 3000, 3001]:
        assert got[i] == (3000 if i == 3000 else 0, sum(near(sets[i], s) for s in nodes) - 1, 2 if i in (5, 3001) else 1), i
    assert {c for c, *_ in got.values()} == {0, 3000}
    assert sum(dealt) <= 4 * len(rows)
