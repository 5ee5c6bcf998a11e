"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all test items as sequences of words. A document's words go through it one by one; the longest
match that ends at each word tells which item windows occur. Only stretches of words known to the items enter it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import ensure_checkpoints, give_back, kept, staged
from bytebasin.llm.words import word_spans, words_of

WINDOW = 10
#: Items' words in one automaton at most (but for a longer single item); further items go into further automata.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """All factors of several word sequences; states carry the sequences in which their window ends."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(item, [number(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: Items by the state of a window of theirs, and by the whole of an item shorter than a window.
        self.owners: dict[int, set[str]] = {}
        self.short: dict[tuple[int, int], set[str]] = {}
        for item, codes in coded:
            for end, (state, length) in enumerate(self.walk(codes), 1):
                if length >= window:
                    self.owners.setdefault(self._at(state, window), set()).add(item)
                elif end == len(codes) < window:
                    self.short.setdefault((self._at(state, end), end), set()).add(item)
        lengths = {n for _, n in self.short}
        self.short_lengths = sorted(lengths)
        self.least = min([window, *lengths])

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for exactly the strings of ``p`` and then ``c``: its target, or the part of it that is as long."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c)
        return state

    def _at(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and the length of the longest match that ends there."""
        state = length = 0
        for c in codes:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            yield state, length

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of all occurring windows, merged where they touch, and the items that own them."""
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]).astype(np.int8))).reshape(-1, 2)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for begin, stop in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():
            for end, (state, length) in enumerate(self.walk(codes[begin:stop].tolist()), begin + 1):
                widest = 0
                if length >= self.window:
                    widest = self.window
                    items |= self.owners[self._at(state, widest)]
                for n in self.short_lengths:
                    if n <= length and (owners := self.short.get((self._at(state, n), n))):
                        items |= owners
                        widest = max(widest, n)
                if widest:
                    start = end - widest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, end))
        return spans, items


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks whose words are counted first: the driver holds, and sends, one block at a time."""
    known = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // (2 * BLOCK_WORDS)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in known.where(block == b).collect()]


def _matcher(shipped: Broadcast, window: int, cut: tuple[int, float] | None = None):
    """A column function that matches texts against one block of items.

    With ``cut`` (least words of a stretch, most coverage) it also gives the text without its stretches: null where
    there is nothing to delete, and ``keep`` tells whether the rest is worth keeping.
    """
    key = uuid.uuid4().hex

    @F.pandas_udf("n_words long, spans array<struct<start: int, end: int>>, items array<string>, clean string, keep boolean")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = kept(("automaton", key), lambda: SuffixAutomaton([(item, words_of(text)) for item, text in shipped.value], window))
        for batch in batches:
            found = []
            for t in batch:
                words = words_of(t)
                spans, owners = automaton.hits(words)
                clean, keep = _cut(t, len(words), spans, *cut) if cut else (None, True)
                found.append((len(words), [{"start": s, "end": e} for s, e in spans], sorted(owners), clean, keep))
            yield pd.DataFrame(found, columns=["n_words", "spans", "items", "clean", "keep"])
        give_back()

    return match


def _cut(text: str | None, n_words: int, spans: list[tuple[int, int]], min_words: int, max_coverage: float) -> tuple[str | None, bool]:
    long = [(s, e) for s, e in spans if e - s >= min_words]
    return removed(text, long) if long else None, sum(e - s for s, e in long) <= n_words * max_coverage


def with_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "hits") -> DataFrame:
    """``docs`` with ``into``: ``n_words``, ``spans`` (first and past-the-last word of each hit stretch) and ``items``.

    A window is ``window`` consecutive words of an item, or a shorter item whole. Null and wordless texts have no words
    and no hits; null item ids or texts count for nothing; items of one id are one; without items nothing is hit. A
    column named ``into`` is replaced, others and repeated rows stay.

    A block of items of bounded size is broadcast to all documents, without a shuffle. For further blocks texts are read
    and matched once more each, so that a worker holds one block's automaton; what is kept of a pass are the hits of
    texts that have any, by a hash of the text of 128 bits. No text is written; documents meet the hits in the end.
    """
    ensure_checkpoints(docs.sparkSession)
    blocks = _blocks(items, item_id, item_text)
    first = next(blocks)
    found = docs.withColumn(into, _matcher(docs.sparkSession.sparkContext.broadcast(first), window)(F.col(text)))
    own = {c: F.col(f"{into}.{c}") for c in ("n_words", "spans", "items")}
    further = None
    for rows in blocks:
        mine = _matcher(docs.sparkSession.sparkContext.broadcast(rows), window)(F.col("t"))
        texts = docs.select(F.col(text).alias("t")).where("t IS NOT NULL")
        hit = staged(texts.withColumn("h", mine), h=F.col("h")).where(F.size("h.spans") > 0)
        keyed = hit.select(*[F.xxhash64(F.lit(k), "t").alias(f"k{k}") for k in (1, 2)], "h.spans", "h.items")
        part = keyed.groupBy("k1", "k2").agg(F.first("spans").alias("spans"), F.first("items").alias("items")).checkpoint()
        further = part if further is None else further.unionByName(part)
    if further is None:
        return found.withColumn(into, F.struct(*[c.alias(n) for n, c in own.items()]))
    more = further.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    # columns get numbers for a while, so that no name of theirs meets one in use here
    number = {c: f"__{i}" for i, c in enumerate(found.columns)}
    held = found.toDF(*number.values()).withColumns({f"k{k}": F.xxhash64(F.lit(k), F.col(number[text])) for k in (1, 2)})
    met = held.join(more, ["k1", "k2"], "left")
    mine = F.col(number[into])
    nothing = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)"), F.expr("CAST(array() AS ARRAY<STRING>)")
    spans = _merged(F.array_sort(F.concat(mine["spans"], F.coalesce("spans", nothing[0]))))
    merged = F.struct(mine["n_words"].alias("n_words"), spans.alias("spans"), F.array_sort(F.array_union(mine["items"], F.coalesce("items", nothing[1]))).alias("items"))
    return met.select(*[(merged if c == into else F.col(n)).alias(c) for c, n in number.items()])


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans of a sorted array as one each."""
    first = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, first, add)


def digests(docs: DataFrame, hits: str = "hits") -> DataFrame:
    """Columns n_words, n_hit, n_items, items_sha256, contaminated in place of ``hits``."""
    h = F.col(hits)
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return docs.withColumns({
        "n_words": h["n_words"], "n_hit": n_hit, "n_items": F.size(h["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort(h["items"]), ","), 256), "contaminated": n_hit > 0,
    }).drop(hits)


def removed(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    at, raw, kept, done = word_spans(text), text.encode(), [], 0
    for s, e in spans:
        kept.append(raw[done : at[s][0]])
        done = at[e - 1][1]
    return b"".join([*kept, raw[done:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, min_words: int = 1, max_coverage: float = 0.5, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without hit stretches of at least ``min_words`` words; documents hit beyond ``max_coverage`` of their
    words go whole. Documents without hits stay as they are, null, empty and wordless texts and repeated rows among
    them; columns stay, whatever their names. An empty table gives an empty table.

    A benchmark of one block is matched and cut in one pass; for a larger one the hits of all blocks are merged first.
    """
    ensure_checkpoints(docs.sparkSession)
    hits = "__hits"
    while hits in docs.columns:
        hits += "_"
    how = (min_words, max_coverage)
    blocks = _blocks(items, item_id, item_text)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        matched = docs.withColumn(hits, _matcher(docs.sparkSession.sparkContext.broadcast(first), window, how)(F.col(text)))
    else:
        all_hits = with_hits(docs, items, window, text, item_id, item_text, into=hits).checkpoint()

        @F.pandas_udf("clean string, keep boolean")
        def cut(texts: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
            rows = [_cut(t, n, [(s["start"], s["end"]) for s in spans], *how) for t, n, spans in zip(texts, found["n_words"], found["spans"])]
            return pd.DataFrame(rows, columns=["clean", "keep"])

        matched = all_hits.withColumn(hits, cut(F.col(text), F.col(hits)))
    # computed once: a filter on a function's result would have the function run again below it
    found = staged(matched, **{hits: F.col(hits)})
    return found.where(F.col(f"{hits}.keep")).withColumn(text, F.coalesce(f"{hits}.clean", text)).select(*docs.columns)
