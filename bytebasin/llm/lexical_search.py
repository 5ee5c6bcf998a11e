"""Ranked lexical search of a set of queries over all documents, grouping documents by the terms that they hold.

A task takes documents in blocks. For each item the presence bits of its terms are put together into a mask for every
document; documents of one mask are a group whose score can't pass the mask's maximum. Groups are evaluated by descending
maximum until what an item has found is safe. What the items have found in one block raises the bar for the next one.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytebasin.llm.common import ensure_checkpoints, give_back, kept
from bytebasin.llm.words import words_of

TOP = 10
#: Characters of items that the driver holds and sends to the tasks at a time, about.
BLOCK_CHARS = 4 << 20
#: Postings of documents that a task holds at a time, and 64-bit words of masks.
POSTINGS, MASK_WORDS = 1 << 20, 1 << 22
#: Lists into which an item's finds are dealt before they meet.
PARTS = 32


class Queries:
    """Items of one block: their distinct terms as codes, and how often each item says each of its own."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[str | None, np.ndarray, np.ndarray]] = []
        number = self.vocabulary.setdefault
        for item, text in items:
            said = Counter(number(w, len(self.vocabulary)) for w in words_of(text))
            self.items.append((item, np.array(list(said), np.int64), np.array(list(said.values()), np.int64)))


class Finds:
    """An item's best documents so far, best first."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def bar(self) -> int:
        """A score below this one is no find any more."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        at = np.flatnonzero(score >= self.bar)
        s, i, k = (np.concatenate(x) for x in ((self.score, score[at]), (self.id, ids[at]), (self.known, known[at])))
        first = np.lexsort((i, ~k, -s))[: self.top]
        self.score, self.id, self.known = s[first], i[first], k[first]


class Documents:
    """Postings of a block of documents by term, each with its share of a score."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_terms: int, n: int, total: int):
        most = int(lengths.max(initial=0))
        if 75 * most * n < 1 << 63:
            m = 25 + 75 * lengths * n // total
        else:
            m = np.array([25 + 75 * int(x) * n // total for x in lengths], np.int64)
        doc = np.repeat(np.arange(len(lengths)), counts)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.argsort(terms, kind="stable")
        self.n, self.doc, self.impact = len(lengths), doc[order], impact[order]
        self.begin = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, gains: np.ndarray, ids: np.ndarray, known: np.ndarray, finds: Finds) -> None:
        """Add to ``finds`` the documents of the best sums of gain times impact over ``terms``."""
        held = (self.begin[terms + 1] > self.begin[terms]) & (gains > 0)
        terms, gains = terms[held], gains[held]
        if not len(terms):
            return
        width = -(-len(terms) // 64)
        step = max(64, MASK_WORDS // width)
        for lo in range(0, self.n, step):
            self._search(terms, gains, lo, min(self.n, lo + step), width, ids, known, finds)

    def _search(self, terms: np.ndarray, gains: np.ndarray, lo: int, hi: int, width: int, ids: np.ndarray, known: np.ndarray, finds: Finds) -> None:
        lists = []
        for t in terms:
            a, z = self.begin[t], self.begin[t + 1]
            if hi - lo < self.n:
                a, z = a + np.searchsorted(self.doc[a:z], [lo, hi])
            lists.append((self.doc[a:z], self.impact[a:z]))
        masks = np.zeros((hi - lo, width), np.uint64)
        most = np.zeros(width * 64, np.int64)
        for t, (docs, impact) in enumerate(lists):
            if len(docs):
                masks[docs - lo, t // 64] |= np.uint64(1 << (t % 64))
                most[t] = gains[t] * impact.max()
        rows = np.flatnonzero(masks.any(axis=1)) if width > 1 else np.flatnonzero(masks[:, 0])
        if not len(rows):
            return
        own = np.ascontiguousarray(masks[rows])
        keys = own[:, 0] if width == 1 else own.view(f"V{8 * width}")[:, 0]
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        bounds = self._maxima(own[first], most)
        order = np.argsort(-bounds, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_group = np.argsort(place[group], kind="stable")
        ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
        bounds, done, take = bounds[order], 0, 16
        while done < len(bounds) and bounds[done] >= finds.bar:
            # masks of this round: those that may still hold a find, more of them from round to round
            upto = min(done + take, int(np.searchsorted(-bounds, -finds.bar, "right")))
            docs = np.sort(rows[by_group[ends[done - 1] if done else 0 : ends[upto - 1]]]) + lo
            score = np.zeros(len(docs), np.int64)
            for gain, (there, impact) in zip(gains, lists):
                if len(there):
                    at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
                    score += np.where(there[at] == docs, gain * impact[at], 0)
            finds.add(score, ids[docs], known[docs])
            done, take = upto, take * 2

    @staticmethod
    def _maxima(masks: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The greatest score of each mask: a table for every eight terms, looked up by the mask's bytes."""
        eights = np.ascontiguousarray(masks.astype("<u8")).view(np.uint8).reshape(len(masks), -1)
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        tables = most.reshape(-1, 8) @ bits.T
        out = np.zeros(len(masks), np.int64)
        for k in np.flatnonzero(most.reshape(-1, 8).any(axis=1)):
            out += tables[k][eights[:, k]]
        return out


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, str]]]:
    """Distinct items in blocks whose characters are counted first: the driver holds, and sends, one block at a time."""
    known = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_CHARS
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in known.where(block == b).collect()]


def _postings(docs: DataFrame, shipped: Broadcast) -> DataFrame:
    """(doc_id, n, terms, tfs): every document's length, and its counts of the items' terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept(("lexical", shipped.value["key"]), lambda: Queries(shipped.value["items"])).vocabulary
        known = vocabulary.keys()
        for batch in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                said = Counter(words)
                mine = said.keys() & known
                lengths.append(len(words))
                terms += map(vocabulary.__getitem__, mine)
                tfs += map(said.__getitem__, mine)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            arrays = [batch.column("doc_id"), pa.array(lengths, pa.int64()), *[pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])
        give_back()

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def _best(postings: DataFrame, shipped: Broadcast, weights: Broadcast, n: int, total: int, top: int) -> DataFrame:
    """(item_no, item, doc_id, score): the best documents of every item within each task's documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = kept(("lexical", shipped.value["key"]), lambda: Queries(shipped.value["items"]))
        finds = [Finds(top) for _ in queries.items]

        def block(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = rows.column("terms").combine_chunks()
            ids = rows.column("doc_id").combine_chunks()
            numbers = rows.column("n").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            docs = Documents(*numbers, len(queries.vocabulary), n, total)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            plain_ids = ids.fill_null(0).to_numpy()
            for (_, terms, times), found in zip(queries.items, finds):
                docs.search(terms, times * weights.value[terms], plain_ids, known, found)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= POSTINGS:
                block(held)
                held, size = [], 0
        if size:
            block(held)
        for lo in range(0, len(finds), 4096):
            part = finds[lo : lo + 4096]
            lengths = [len(f.score) for f in part]
            ids, known = np.concatenate([f.id for f in part]), np.concatenate([f.known for f in part])
            names = [queries.items[lo + k][0] for k, m in enumerate(lengths) for _ in range(m)]
            arrays = [pa.array(np.repeat(np.arange(lo, lo + len(part)), lengths)), pa.array(names, pa.string()), pa.array(ids, mask=~known), pa.array(np.concatenate([f.score for f in part]))]
            yield pa.RecordBatch.from_arrays(arrays, ["item_no", "item", "doc_id", "score"])

    return postings.mapInArrow(search, "item_no long, item string, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of highest score above 0 for every item, best first.

    Terms are the words of whole texts. N documents have L words together; a term in df of them weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))). A document of n words has m = 25 + 75 n N div L, and each of an item's words,
    repeats included, adds its weight times (10^9 tf) div (1000 tf + 8 m).

    Equal scores go by ascending id, which must be a whole number; rows without one come last among equals. Repeated
    documents are documents each. Items alike in id and text are one; texts of one id are items each, and an item
    without an id has its rows under null. Null, empty and wordless texts are found by nothing and find nothing. Empty
    tables give no rows. Other columns are not read.

    A block of items of bounded size is sent to all documents; further blocks are further passes. Texts are read once a
    pass, what they hold of the items' words is checkpointed. A task gives ``top`` rows an item at most.
    """
    ensure_checkpoints(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for b, rows in enumerate(_blocks(items, item_id, item_text)):
        queries = Queries(rows)
        shipped = context.broadcast({"key": uuid.uuid4().hex, "items": rows})
        postings = _postings(texts, shipped).checkpoint()
        n, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(queries.vocabulary), np.int64)
        # a row for each of the block's terms
        for term, holders in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():
            df[term] = holders
        weights = context.broadcast(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64))
        part = _best(postings.where("n > 0"), shipped, weights, n, total, top).withColumn("block", F.lit(b))
        found = part if found is None else found.unionByName(part)
    best_first = (F.desc("score"), F.asc_nulls_last("doc_id"))
    of_item = ("block", "item_no")
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*of_item, "part").orderBy(*best_first))).where(F.col("rank") <= top)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy(*of_item).orderBy(*best_first))).where(F.col("rank") <= top)
    return out.select(F.col("item").cast(items.schema[item_id].dataType).alias("item_id"), "rank", "doc_id", "score")
