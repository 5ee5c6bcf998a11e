"""Toxicity: segments against a quadratic search, accuracy on the fold that was held out, planted words."""

import math
import random
import zlib
from collections import Counter

import pytest

from bytebasin.llm import toxicity as tx
from bytebasin.llm.queries import op3_toxicity


def brute_segments(values):
    """Maximal scoring segments as Ruzzo and Tompa define them: the best segment, then what is left on either side."""
    best = None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    s, e, _ = best
    return brute_segments(values[:s]) + [best] + [(a + e, b + e, c) for a, b, c in brute_segments(values[e:])]


def test_segments():
    rng = random.Random(3)
    model = tx.ToxicityModel({"bad\0": (3.0171, 9.0), "poor\0": (0.5533, 5.0), "good\0": (-1.2937, -5.0)})
    for _ in range(150):
        words = rng.choices(["bad", "poor", "good", "x", "y"], [2, 2, 2, 10, 10], k=rng.randint(0, 60))
        values = [{"bad": 3.0171, "poor": 0.5533, "good": -1.2937}.get(w, -tx.COST) for w in words]
        got = model.segments(words)
        assert sum(x for *_, x in got) == pytest.approx(sum(x for *_, x in brute_segments(values)))
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in brute_segments(values)]


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    rows = op3_toxicity(spark, big)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = rows.collect()
    assert len(got) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.93 and sum((s >= 0.5) == bool(y) for s, y in test) / len(test) > 0.97


def test_small_and_odd_tables(spark):
    texts = [f"word{i % 7} plain text of number {i}" + (" you rotten scoundrel" if i % 4 == 0 else "") for i in range(120)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate([*texts, None, "", "scoundrel " * 5000])], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(3, None), (None, 1), (1, 0), (1, 0), (5000, 1)], "doc_id long, toxic int")
    model = tx.fit_toxicity(docs, labels)
    got = {r.doc_id: r.toxicity for r in tx.with_toxicity(docs, model).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(120))
    assert got[120].score == got[121].score < 0.5 <= got[122].score and got[122].passages[0].start == 0
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        flat = tx.with_toxicity(docs, tx.fit_toxicity(docs, none)).select("toxicity.score").distinct().count()
        assert flat == 1
    assert tx.with_toxicity(docs.limit(0), model).count() == 0


def plain_model(rows):
    """Weights, lambda, K, and the evidence of a text, from training rows (label, text), step by step."""
    n = [sum(y == k for y, _ in rows) for k in (0, 1)]
    having = [Counter(f for y, t in rows if y == k for f in {f for w in tx.tokens_of(t) for f in tx.features_of(w)}) for k in (0, 1)]
    weights = {}
    for f in having[0] | having[1]:
        a, b = having[1][f], having[0][f]
        if a + b < 2:
            continue
        prior = tx.PRIOR * (a + b) / sum(n) + 0.01
        odds = math.log((a + prior) / (n[1] + tx.PRIOR - a - prior + 1)) - math.log((b + prior) / (n[0] + tx.PRIOR - b - prior + 1))
        z = odds / math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if abs(odds) >= tx.MIN_ODDS and (z >= tx.MIN_Z and a >= tx.MIN_SHARE * n[1] or z <= -tx.MIN_Z and b >= tx.MIN_SHARE * n[0]):
            weights[f] = (odds, z)

    def value(word):
        found = [weights[f] for f in tx.features_of(word) if f in weights]
        return max(found, key=lambda w: abs(w[1]))[0] if found else -tx.COST

    def scores(text):
        return [s for *_, s in brute_segments([value(w) for w in tx.tokens_of(text)])]

    clean = [t for y, t in rows if not y]
    words = [w for t in clean for w in tx.tokens_of(t)]
    seen = Counter(v for v in map(value, words) if v != -tx.COST)
    if not any(v > 0 for v in seen):
        seen[5.0] = 0
    p = {v: (c + 0.5) / (len(words) + 1) for v, c in seen.items()}
    rest = max(1e-9, 1 - sum(p.values()))
    low, high = 1e-6, 100.0
    for _ in range(200):
        middle = (low + high) / 2
        excess = sum(q * math.exp(min(500, middle * v)) for v, q in p.items()) + rest * math.exp(-middle * tx.COST) - 1
        low, high = (middle, high) if excess < 0 else (low, middle)
    rate = low
    scale = len(clean) / sum(max(1, len(tx.tokens_of(t))) * math.exp(-rate * max(scores(t), default=0.0)) for t in clean)

    def evidence(text):
        return math.log(1 + sum(math.exp(rate * s) / (scale * max(1, len(tx.tokens_of(text)))) for s in scores(text)))

    return weights, rate, scale, evidence


def test_model_is_the_plain_one(spark):
    rng = random.Random(4)
    common, bad = [f"w{i}" for i in range(40)], ["rotten", "scoundrel", "vile"]
    rows = []
    for i in range(240):
        words = rng.choices(common, k=rng.randint(3, 25))
        if i % 4 == 0 or i % 37 == 0:
            words[rng.randint(0, 2) : 2] = rng.choices(bad, k=rng.randint(1, 3))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = tx.fit_toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    training = [(y, t) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    weights, rate, scale, evidence = plain_model(training)
    assert model.weights.keys() == weights.keys() and weights
    assert all(model.weights[f] == pytest.approx(w) for f, w in weights.items())
    assert (model.rate, model.scale) == (pytest.approx(rate, rel=1e-4), pytest.approx(scale, rel=1e-3))
    got = {r.doc_id: r.toxicity for r in tx.with_toxicity(docs, model).collect()}
    for i, t, _ in rows:
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * evidence(t) + model.intercept))), abs=1e-3)
        assert all(p.expected <= tx.MAX_EXPECTED for p in got[i].passages)
