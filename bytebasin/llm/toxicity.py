"""Toxic passages as maximum-scoring segments of token log-odds.

Words and their beginnings get log-odds between toxic and other training documents under a Dirichlet prior; a word
scores as the feature of its own that stands out most, and costs a little if none does. A linear scan finds every maximal
segment of a document. Segment scores of documents that are not toxic follow an extreme-value law, whose parameters turn a score and a document's length into an expected
number of such segments by chance; a logistic curve turns a document's evidence into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import drop_folder, give_back, shared_folder
from bytebasin.llm.words import TABLE

#: Labelled documents that a model is fitted on at most, taken in the order of a hash of their ids.
MAX_TRAINING = 20_000
#: Strength of the prior in documents; least z and log-odds of a scoring feature; the least share of documents of its side
#: that have it, which bounds how many there are: 50 times the features of a document of mean length; what a word without
#: one costs.
PRIOR, MIN_Z, MIN_ODDS, MIN_SHARE, COST = 10.0, 3.0, 3.5, 0.02, 0.1
#: A segment is a passage if no more than so many as good ones are expected by chance in a document of its length.
MAX_EXPECTED = 0.05
#: Lengths of the beginnings of words that are features, beside whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words whose scores a worker keeps.
CACHE_WORDS = 100_000
#: Features that a task counts before it hands its counts on.
FLUSH = 100_000


def tokens_of(text: str | None) -> list[str]:
    """The words of ``words_of`` as strings, cut at white space beyond ASCII too."""
    return text.encode().translate(TABLE).decode().split() if text else []


def features_of(word: str) -> list[str]:
    """The word with an end mark, and its beginnings."""
    return [word + "\0", *[word[:n] for n in PREFIXES if n <= len(word)]]


class _Scores(dict):
    """Scores of words, found on first use and kept in bounds."""

    def __init__(self, weights: dict[str, tuple[float, float]]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = [self.weights[f] for f in features_of(word) if f in self.weights]
        score = max(found, key=lambda w: abs(w[1]))[0] if found else 0.0
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = score
        return score


@dataclass
class ToxicityModel:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # log-odds and z by feature
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # K of the extreme-value law
    slope: float = 1.0
    intercept: float = 0.0

    def __post_init__(self) -> None:
        self.scores = _Scores(self.weights)

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.rate, self.scale, self.slope, self.intercept)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first word, past the last, score) by Ruzzo and Tompa's scan."""
        values = np.fromiter(map(self.scores.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(values)
        if not len(at):
            return []
        # only scoring words matter: between two of them the running total falls by their distance times the cost
        gaps = np.diff(np.concatenate([[-1], at])) - 1
        found: list[tuple[int, int, float, float]] = []  # start, end, total before it, total after it
        total = 0.0
        for i, gap, value in zip(at.tolist(), gaps.tolist(), values[at].tolist()):
            total -= COST * gap
            if value < 0:
                total += value
                continue
            start, left = i, total
            total += value
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= left:
                    j -= 1
                if j < 0 or found[j][3] >= total:
                    break
                start, left = found[j][0], found[j][2]
                del found[j:]
            found.append((start, i + 1, left, total))
        return [(s, e, r - l) for s, e, l, r in found]

    def evidence(self, scores: list[float], n: int) -> float:
        """Log of one plus the sum, over segments, of one over the number expected by chance in ``n`` words."""
        total = 0.0
        for s in scores:
            total = np.logaddexp(total, self.rate * s - math.log(self.scale * max(1, n)))
        return float(total) if scores else 0.0

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.slope * evidence + self.intercept))))

    def score(self, text: str | None) -> float:
        words = tokens_of(text)
        return self.probability(self.evidence([s for _, _, s in self.segments(words)], len(words)))


def held_out(doc_id: str = "doc_id"):
    """Rows of the fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model from labelled documents outside the held-out fold, ``max_training`` of them at most.

    Null labels, ids and texts teach nothing; an id with both labels counts as toxic. The training texts, which
    ``max_training`` bounds, are written to the shared folder once. Features are counted by task and then by Spark; the
    driver gets the scoring ones and a few numbers for each training document. Without both labels the model scores
    every text alike.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label")).withColumn("hash", F.xxhash64("id"))
    n = known.count()
    if n > max_training:  # of hashes spread evenly so many are below the cut, and hardly more: few rows are sorted
        share = (max_training + 10 * math.sqrt(max_training)) / n
        known = known.where(F.col("hash") < F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
    known = known.orderBy("hash", "id").limit(max_training).select("id", "label")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    folder = shared_folder(spark, "toxicity")
    rows.join(F.broadcast(known), "id").select("label", "text").write.parquet(folder)  # at most max_training ids
    model = _fitted(spark.read.parquet(folder))
    drop_folder(spark, folder)
    return model


def _fitted(training: DataFrame) -> ToxicityModel:
    """The model of training rows (label, text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        having: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> Iterator[pd.DataFrame]:
            for y, counter in enumerate(having):
                n = np.fromiter(counter.values(), np.int64, len(counter))
                none = np.zeros_like(n)
                yield pd.DataFrame({"feature": pd.Series(list(counter), dtype=object), "toxic": n if y else none, "other": none if y else n})
                counter.clear()

        for batch in batches:
            for y, t in zip(batch["label"], batch["text"]):
                having[y].update({f for w in set(tokens_of(t)) for f in features_of(w)})
                having[y][""] += 1
                if len(having[y]) > FLUSH:
                    yield from counted()
        yield from counted()
        give_back()

    counts = training.mapInPandas(count, "feature string, toxic long, other long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = counts.where((F.col("toxic") + F.col("other") >= 2) | (F.col("feature") == "")).persist()
    sums = counts.where("feature = ''").first()
    n1, n0 = (sums["toxic"], sums["other"]) if sums else (0, 0)
    if not n1 or not n0:
        counts.unpersist()
        return ToxicityModel(intercept=-5.0 if not n1 else 0.0)
    prior = (F.col("toxic") + F.col("other")) * (PRIOR / (n1 + n0)) + 0.01
    odds = F.log((F.col("toxic") + prior) / (n1 + PRIOR - F.col("toxic") - prior + 1)) - F.log((F.col("other") + prior) / (n0 + PRIOR - F.col("other") - prior + 1))
    z = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("other") + prior))
    chosen = counts.where("feature <> ''").withColumn("odds", odds).withColumn("z", z).where(F.abs("odds") >= MIN_ODDS)
    chosen = chosen.where(((F.col("z") >= MIN_Z) & (F.col("toxic") >= MIN_SHARE * n1)) | ((F.col("z") <= -MIN_Z) & (F.col("other") >= MIN_SHARE * n0)))
    features = chosen.select("feature", "odds", "z").collect()
    counts.unpersist()
    model = ToxicityModel({r["feature"]: (float(r["odds"]), float(r["z"])) for r in features})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for y, t in zip(batch["label"], batch["text"]):
                words = tokens_of(t)
                seen = Counter(v for v in map(model.scores.__getitem__, words) if v) if not y else {}
                found.append((y, len(words), [s for _, _, s in model.segments(words)], list(seen), list(seen.values())))
            yield pd.DataFrame(found, columns=["label", "n", "scores", "values", "times"])

    # a row for each word value, and two numbers for each training text, are all that comes to the driver
    scanned = training.mapInPandas(scan, "label int, n long, scores array<double>, values array<double>, times array<long>").checkpoint()
    pairs = scanned.select(F.inline(F.arrays_zip("values", "times"))).groupBy("values").agg(F.sum("times").alias("times")).orderBy("values").collect()
    total = scanned.agg(F.sum(F.when(F.col("label") == 0, F.col("n")))).first()[0] or 0
    model.rate = _rate(np.array([r["values"] for r in pairs], float), np.array([r["times"] for r in pairs], float), total)
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    null = scanned.where("label = 0").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), "n") * F.exp(-model.rate * top)).alias("chance")).first()
    model.scale = null["n"] / null["chance"]  # the most likely K

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["label"]].assign(evidence=[model.evidence(list(s), n) for s, n in zip(batch["scores"], batch["n"])])

    weighed = scanned.select("label", "n", "scores").mapInPandas(weigh, "label int, evidence double").collect()
    model.slope, model.intercept = _logistic(np.array([r["evidence"] for r in weighed]), np.array([r["label"] for r in weighed], float))
    return model


def _rate(values: np.ndarray, tokens: np.ndarray, total: int) -> float:
    """The positive root of sum p * exp(rate * value) = 1 over the words of documents that are not toxic."""
    if not (values > 0).any():
        values, tokens = np.append(values, 5.0), np.append(tokens, 0.0)  # none seen by chance
    p = (tokens + 0.5) / (total + 1)
    rest = max(1e-9, 1 - p.sum())

    def excess(rate: float) -> float:
        return float((p * np.exp(np.minimum(rate * values, 500))).sum() + rest * math.exp(-rate * COST) - 1)

    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's steps, with a little ridge."""
    beta, design, ridge = np.zeros(2), np.column_stack([x, np.ones_like(x)]), np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with ``into``: ``score`` and ``passages`` (first and past-the-last word, score, chance expectation).

    Whole texts are scanned; passages are the segments of which ``MAX_EXPECTED`` at most are expected by chance, and the
    score comes from all. A null or empty text has no passage and the score of no evidence. A column named ``into``
    is replaced; others and repeated rows stay. No shuffle; the model that is sent has a bounded size.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<start: int, end: int, score: double, expected: double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for batch in batches:
            found = []
            for t in batch:
                words = tokens_of(t)
                n, segments = len(words), m.segments(words)
                expected = [(s, e, x, m.scale * n * math.exp(-m.rate * x)) for s, e, x in segments]
                passages = [{"start": s, "end": e, "score": x, "expected": k} for s, e, x, k in expected if k <= MAX_EXPECTED]
                found.append((m.probability(m.evidence([x for _, _, x in segments], n)), passages))
            yield pd.DataFrame(found, columns=["score", "passages"])
        m.scores.clear()  # the worker lives on after its task
        give_back()

    return docs.withColumn(into, scan(F.col(text)))
