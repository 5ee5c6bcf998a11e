"""Ranked search against a plain scorer of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bytebasin.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score)."""
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n, total = len(held), sum(m for *_, m in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, tf, length in held:
            m = 25 + 75 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in words(text) if w in tf)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k, None if no_id else d, -s) for k, (s, no_id, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus(n, seed, vocabulary=60):
    rng = random.Random(seed)
    names = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    text = lambda m: " ".join(rng.choices(names, weights, k=m))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(n)]
    items = [(k, text(rng.choice([1, 3, 20, 40]))) for k in range(12)]
    return docs, items


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, ls.search(d, q, **how).collect()), key=repr)


@pytest.mark.parametrize("postings, mask_words, part", [(1 << 20, 1 << 22, 1 << 22), (300, 64, 150)])
def test_against_all_scores(spark, monkeypatch, postings, mask_words, part):
    monkeypatch.setattr(ls, "POSTINGS", postings)
    monkeypatch.setattr(ls, "MASK_WORDS", mask_words)
    monkeypatch.setattr(ls, "BLOCK_CHARS", part)
    docs, items = corpus(400, 3)
    # repeated rows, texts without words or none at all, a very long one, an item of more than 64 terms, ties
    docs += docs[:40] + [(None, docs[7][1]), (None, "W1 W2"), (900, None), (901, ""), (902, " .,"), (903, "W5 " * 30_000), (904, "only here"), (905, "only here"), (906, "ONLY HERE")]
    items += [(50, " ".join(f"w{k}" for k in range(200))), (51, None), (52, ""), (None, "w3 w4"), (53, "only"), (53, "here W1"), (0, "w2"), items[0], (54, "unheard of")]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, top=3) == plain(docs, items, top=3)


def test_empty_tables(spark):
    docs, items = corpus(20, 4)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [], []) == []


def test_groups_are_left_out_only_when_safe():
    """Masks are evaluated in descending order of what they can reach, and the rest is left alone."""
    rng = np.random.default_rng(0)
    n, n_terms = 3000, 30
    counts = rng.integers(0, 12, n)
    terms = np.concatenate([rng.choice(n_terms, c, replace=False) for c in counts])
    tf = rng.integers(1, 9, len(terms))
    lengths = np.maximum(1, np.bincount(np.repeat(np.arange(n), counts), tf, n).astype(np.int64))
    block = ls.Documents(lengths, counts, terms, tf, n_terms, n, int(lengths.sum()))
    gains = rng.integers(1, 4000, n_terms)
    full = np.zeros(n, np.int64)
    for t in range(n_terms):
        a, z = block.begin[t], block.begin[t + 1]
        full[block.doc[a:z]] += gains[t] * block.impact[a:z]
    seen = []

    class Watched(ls.Finds):
        def add(self, score, ids, known):
            seen.append(len(score))
            super().add(score, ids, known)

    finds = Watched(10)
    block.search(np.arange(n_terms), gains, np.arange(n), np.ones(n, bool), finds)
    best = np.lexsort((np.arange(n), -full))[:10]
    assert finds.id.tolist() == best.tolist() and finds.score.tolist() == full[best].tolist()
    assert sum(seen) < n


def test_query_against_plain(spark, sf):
    from bytebasin.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_lexical_search"](spark, sf).collect()), key=repr) == plain(docs, items)
