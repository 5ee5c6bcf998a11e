"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by 1 + ln(count). Every sample draws gamma variables for each term from the term
alone, and takes the term of least value with the quantised log weight; two texts take the same pair with a probability
equal to their generalised Jaccard similarity, the sum of least weights over the sum of greatest weights.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import kept, ordered_ranges
from bytebasin.llm.words import words_of

SAMPLES = 64
#: Terms with their counts whose samples a worker keeps; 512 bytes each.
CACHE_ROWS = 200_000


def _uniform(keys: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys (rows) and streams (columns), by the splitmix mixer."""
    with np.errstate(over="ignore"):
        x = keys[:, None] + (stream + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class WeightedSampler:
    """Signatures of ``samples`` 16-bit numbers for bags of terms."""

    def __init__(self, samples: int = SAMPLES, cache_rows: int = CACHE_ROWS):
        self.samples, self.cache_rows = samples, cache_rows
        self.rows: dict[tuple[bytes, int], int] = {}
        self.value = np.empty((cache_rows, samples), np.float32)
        self.mark = np.empty((cache_rows, samples), np.uint16)

    def _draw(self, terms: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Values and marks of terms with counts: r and c are gamma(2, 1), b is uniform."""
        k = self.samples
        keys = np.array([xxhash.xxh3_64_intdigest(t) for t, _ in terms], np.uint64)
        u = _uniform(keys, np.arange(5 * k, dtype=np.uint64)).reshape(len(terms), 5, k)
        r = -np.log(u[:, 0] * u[:, 1])
        c = -np.log(u[:, 2] * u[:, 3])
        weight = np.log(1 + np.log([n for _, n in terms]))[:, None]
        level = np.floor(weight / r + u[:, 4])
        value = np.log(c) - r * (level - u[:, 4] + 1)
        with np.errstate(over="ignore"):
            mark = (keys[:, None] ^ level.astype(np.int64).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return value.astype(np.float32), (mark >> np.uint64(48)).astype(np.uint16)

    def bag(self, text: str) -> list[tuple[bytes, int]]:
        """Terms with counts; a text without words is one term of its own."""
        return list(Counter(words_of(text)).items()) or [(b"\0" + text.encode(), 1)]

    def signature(self, terms: list[tuple[bytes, int]]) -> np.ndarray:
        """The marks of the terms of least value, sample by sample; terms may be more than the cache holds."""
        best = mark = None
        for i in range(0, len(terms), self.cache_rows // 2):
            value, found = self._least(terms[i : i + self.cache_rows // 2])
            if best is None:
                best, mark = value, found
            else:
                less = (value < best) | ((value == best) & (found < mark))
                best, mark = np.where(less, value, best), np.where(less, found, mark)
        return mark

    def _least(self, terms: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
        at = [self.rows.get(t, -1) for t in terms]
        if missing := [i for i, x in enumerate(at) if x < 0]:
            if len(self.rows) + len(missing) > self.cache_rows:
                self.rows.clear()
                missing = range(len(terms))
            first = len(self.rows)
            value, mark = self._draw([terms[i] for i in missing])
            self.value[first : first + len(value)], self.mark[first : first + len(value)] = value, mark
            for x, i in enumerate(missing, first):
                self.rows[terms[i]] = at[i] = x
        at = np.sort(np.array(at))
        values, columns = self.value[at], np.arange(self.samples)
        least = values.min(axis=0)
        marks = np.where(values == least, self.mark[at], 0xFFFF).min(axis=0)  # ties: the smallest mark
        return least[columns], marks.astype(np.uint16)


def fingerprint(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def _sampler(samples: int) -> WeightedSampler:
    return kept(("sampler", samples), lambda: WeightedSampler(samples))


def with_fingerprints(docs: DataFrame, samples: int = SAMPLES, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text, as hex digits. A null text counts as empty; equal texts have
    equal fingerprints. A column named ``into`` is replaced; others and repeated rows stay. No shuffle.
    """

    @F.pandas_udf("string")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = _sampler(samples)
        for batch in batches:
            yield pd.Series([fingerprint(sampler.signature(sampler.bag(t))) for t in batch], dtype=object)

    return docs.withColumn(into, sign(F.coalesce(F.col(text), F.lit(""))))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_neighbour_likeness(docs: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document, in descending ``doc_id``.

    Columns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``. Rows of one id go by a hash of the text, falling like the ids; null ids come last; after the last
    document comes the first (one document alone follows itself). One shuffle, by ranges of (id, hash), so that many
    rows of one id are dealt too; the first row of a range also goes to the range before it, so that no task waits for
    another. A row for each range is broadcast. Ids must be whole numbers; any other is an error when rows are read.
    """
    spark = docs.sparkSession
    key = F.col("doc_id")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("tie"))
    rows, n = ordered_ranges(rows, "doc_id", "tie", max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # ranges count down with the id; rows without an id are in the last ones
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", "tie")).alias("head")).collect()
    heads = {r["range"]: (r["head"]["doc_id"], r["head"]["tie"]) for r in heads}
    keyed, unkeyed = (sorted((r for r, h in heads.items() if (h[0] is None) == none), reverse=True) for none in (False, True))
    order = [*keyed, *unkeyed]
    to = [(r, *heads[r], order[i - 1]) for i, r in enumerate(order)]  # the first range's head goes to the last one
    guests = F.broadcast(spark.createDataFrame(to, "at int, head long, head_tie long, before int"))  # a row for each range
    met = rows.join(guests, F.col("range") == F.col("at"))
    first = key.eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    dealt = met.select("doc_id", "text", "tie", F.inline(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.repartitionById(n, F.col("range"))
    dealt = dealt.sortWithinPartitions("guest", key.desc_nulls_last(), F.col("tie").desc(), "text")
    dealt = dealt.select(key.cast("string").alias("doc_id"), "text", "guest")  # an id with nulls must not pass through floats

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, before, done = _sampler(samples), None, False

        def signed(doc_id, text: str) -> tuple:
            return doc_id, text, sampler.signature(sampler.bag(text))

        def row(this: tuple, after: tuple) -> tuple:
            text = edited(this[1], after[1])
            sign = sampler.signature(sampler.bag(text))
            return this[0], len(this[1]), hashlib.sha256(text.encode()).hexdigest(), fingerprint(this[2]), fingerprint(sign), likeness(this[2], sign), likeness(this[2], after[2])

        for batch in batches:
            out = []
            for number, t, guest in zip(batch["doc_id"], batch["text"], batch["guest"]):
                if done:  # further guests: repeated rows of the head's id
                    break
                this = signed(number, t)
                if before is not None:
                    out.append(row(before, this))
                before, done = this, bool(guest)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(compare, schema).withColumn("doc_id", key.cast("long"))
