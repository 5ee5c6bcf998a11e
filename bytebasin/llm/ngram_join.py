"""Similarity join of documents on word n-grams, with Bayesian pruning of candidates.

Texts with one set of n-grams are one node. MinHash bands give candidates; MinHash values are compared a few at a time
and a pair is dropped once the posterior probability that it reaches the threshold falls below a tolerance. What is left
falls into small components, within which all similarities are computed exactly from the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import ensure_checkpoints, give_back
from bytebasin.llm.components import connected_components
from bytebasin.llm.words import words_of

N, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 25, 5 in 100,000.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 25, 1e-6
#: Nodes up to which a band's bucket is written as pairs; larger ones are compared block by block within tasks.
SMALL, BLOCK = 24, 256

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all its words where they are fewer than n."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        grams = np.full(len(h) - size + 1, np.uint64(size))
        for i in range(size):
            grams = grams * _PRIME + h[i : len(h) - size + 1 + i]
        return np.unique(_mixed(grams))


def minhash(grams: np.ndarray) -> np.ndarray:
    """Least values of the n-grams under each hash, the upper 32 bits."""
    with np.errstate(over="ignore"):
        least = [(grams[i : i + 4096, None] * _MULTIPLIERS).min(axis=0) for i in range(0, len(grams), 4096)]
    return (np.minimum.reduce(least) >> np.uint64(32)).astype(np.uint32)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches of n values with which a pair stays.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1); that it reaches t has probability
    P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Indices of the rows of two signature matrices that no comparison drops."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i in range(0, a.shape[1], STEP):
        matches = matches + (a[left, i : i + STEP] == b[left, i : i + STEP]).sum(axis=1)
        stay = matches >= least_matches(min(i + STEP, a.shape[1]), threshold, tolerance)
        left, matches = left[stay], matches[stay]
    return left


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows, put together across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        both = pd.concat(held, ignore_index=True) if len(held) > 1 else batch.reset_index(drop=True)
        values = both[keys].to_numpy()
        cuts = (np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()
        for s, e in zip([0, *cuts[:-1]], cuts):
            yield both.iloc[s:e]
        held = [both.iloc[cuts[-1] if cuts else 0 :]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _roots(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least node it is connected with."""
    labels, linked = nodes.copy(), linked | np.eye(len(nodes), dtype=bool)
    while True:
        low = np.where(linked, labels[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (low == labels).all():
            return labels
        labels = low


def _in_block_pairs(rows: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with ``lo`` and ``hi``: nodes of a group of up to BLOCK meet once; larger groups are cut into blocks,
    and each pair of blocks meets in a place of its own.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("__blocks", blocks).withColumn("__mine", F.pmod(F.xxhash64("node", F.lit("block")), F.col("__blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("__blocks") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least(o, F.col("__mine")).alias("lo"), F.greatest(o, F.col("__mine")).alias("hi")))
    rows = rows.withColumn("__pair", F.explode(pairs)).withColumns({"lo": F.col("__pair.lo"), "hi": F.col("__pair.hi")})
    return rows.withColumnRenamed("__mine", "mine").drop("__pair", "__blocks")


def _around_pivot(rows: DataFrame, key: str, size: str, payload: str, near) -> DataFrame:
    """(key, size, node, payload, pivot, near): the nodes of groups of more than BLOCK against their group's least node.

    The least node is sent to every block of its group, so that this takes work in proportion to the nodes.
    ``near(pivot, payloads)`` tells which of a block's nodes are near it.
    """
    pivots = rows.groupBy(key).agg(F.min("node").alias("pivot"))
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    held = rows.join(pivots, key).withColumn("__blocks", blocks)
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("__blocks")).cast("int")
    mine = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("__blocks") - 1)).otherwise(F.array(own))
    dealt = _dealt(held.select(F.col(key).alias("key"), F.col(size).alias("size"), "node", F.col(payload).alias("payload"), "pivot", own.alias("own"), F.explode(mine).alias("block")), ["key", "block"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["key", "block"]):
            first = group["node"].to_numpy() == group["pivot"].to_numpy()
            close = near(group["payload"].iloc[int(np.argmax(first))], group["payload"])
            # the pivot has its row in its own block alone
            yield group.assign(near=close | first)[~first | (group["own"] == group["block"])].drop(columns=["own", "block"])
        give_back()

    return dealt.mapInPandas(compare, "key long, size long, node long, payload binary, pivot long, near boolean")


def _rest_pairs(rows: DataFrame) -> DataFrame:
    """Rows of ``_around_pivot`` with ``lo``, ``hi`` and ``mine``: each node that isn't near its pivot meets every other
    node of the group once. Near ones don't meet one another; a group of them alone has no row here."""
    counts = rows.groupBy("key").agg(F.count_if(~F.col("near")).alias("far"), F.count_if("near").alias("close")).where("far > 0")
    far, close = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("far", "close"))
    place = F.xxhash64("node", F.lit("rest"))
    mine = F.when(F.col("near"), F.col("__far") + F.pmod(place, F.col("__close"))).otherwise(F.pmod(place, F.col("__far"))).cast("int")
    met = rows.join(counts, "key").withColumns({"__far": far, "__close": close}).withColumn("mine", mine)
    upto = F.when(F.col("near"), F.col("__far")).otherwise(F.col("__far") + F.col("__close"))
    pairs = F.transform(F.sequence(F.lit(0), upto - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("lo"), F.greatest(o, F.col("mine")).alias("hi")))
    return met.withColumn("__pair", F.explode(pairs)).select("key", "node", "payload", "mine", "__pair.lo", "__pair.hi")


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "node")


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """(doc_id, of, node, signature, bands) of every document, ``of`` being a hash of the text; no node where a text has no words."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ROWS)], np.uint64)
        for batch in batches:
            out = []
            for t in batch["text"]:
                grams = shingles(t, n)
                if not len(grams):
                    out.append((None, None, None))
                    continue
                values = minhash(grams)
                with np.errstate(over="ignore"):
                    keys = _mixed((values.reshape(BANDS, ROWS).astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PRIME)
                node = np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64)
                out.append((node, (values & 0xFFFF).astype("<u2").tobytes(), keys.astype(np.int64)))
            found, signatures, bands = zip(*out) if out else ((), (), ())
            # an integer column with nulls must not pass through floats
            yield batch[["doc_id", "of"]].assign(node=pd.array(found, dtype="Int64"), signature=pd.Series(signatures, batch.index, dtype=object), bands=pd.Series(bands, batch.index, dtype=object))
        _WORDS.clear()  # the worker lives on after its task
        give_back()

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    found = rows.mapInPandas(sketch, "doc_id string, of long, node long, signature binary, bands array<long>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _likely_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose components hold every pair of nodes that shares a band and is not pruned."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(sizes, "band").checkpoint()
    # small buckets: all pairs, once each over all bands
    few = members.where(F.col("size") <= SMALL).groupBy("band").agg(F.array_sort(F.collect_list("node")).alias("in"))
    pairs = few.select(F.explode(F.flatten(F.transform("in", lambda a, i: F.transform(F.slice("in", i + 2, F.size("in")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b").distinct()
    signed = nodes.select("node", "signature")
    pairs = pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(signed.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")

    def matrix(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), "<u2").reshape(len(column), HASHES)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[["a", "b"]].iloc[surviving(matrix(batch["sa"]), matrix(batch["sb"]), threshold)]

    def prune_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["band", "lo", "hi"]):
            ids, signs = group["node"].to_numpy("i8"), matrix(group["signature"])
            linked = np.zeros((len(ids), len(ids)), bool)
            for i in range(len(ids) - 1):
                linked[i, i + 1 + surviving(np.broadcast_to(signs[i], (len(ids) - i - 1, HASHES)), signs[i + 1 :], threshold)] = True
            roots = _roots(linked | linked.T, ids)
            yield pd.DataFrame({"a": ids, "b": roots})[ids != roots]

    def survive(pivot: bytes, signatures: pd.Series) -> np.ndarray:
        found = np.zeros(len(signatures), bool)
        found[surviving(np.broadcast_to(np.frombuffer(pivot, "<u2"), (len(signatures), HASHES)), matrix(signatures), threshold)] = True
        return found

    several = members.where(F.col("size") > SMALL).join(signed, "node")
    blocks = _dealt(_in_block_pairs(several.where(F.col("size") <= BLOCK), "band", "size").select("band", "lo", "hi", "node", "signature"), ["band", "lo", "hi"]).mapInPandas(prune_blocks, "a long, b long")
    # in large buckets what stays with one node need not meet: its component holds all of them
    around = _around_pivot(several.where(F.col("size") > BLOCK), "band", "size", "signature", survive).checkpoint()
    rest = _rest_pairs(around).select(F.col("key").alias("band"), "lo", "hi", "node", F.col("payload").alias("signature"))
    far = _dealt(rest, ["band", "lo", "hi"]).mapInPandas(prune_blocks, "a long, b long")
    star = around.where("near AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return pairs.mapInPandas(prune, "a long, b long").union(blocks).union(far).union(star).distinct()


def _gram_sets(parts: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, label, grams) of the nodes of ``parts`` (node, label, rep), ``rep`` being (id, hash) of a row with its text."""
    wanted = parts.select("node", "label", F.col("rep.id").alias("rep_id"), F.col("rep.of").alias("rep_of"))
    rows = docs.withColumn("of", F.xxhash64("text"))
    texts = rows.join(wanted, (F.col("of") == F.col("rep_of")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch["text"]]
            same = [np.uint64(xxhash.xxh3_64_intdigest(g.tobytes())).astype(np.int64) == node for g, node in zip(sets, batch["node"])]
            out = batch[["node", "label"]].assign(grams=[g.tobytes() for g in sets])
            yield out[np.array(same, bool)]
        _WORDS.clear()
        give_back()

    sets = texts.select("node", "label", "text").mapInPandas(grams, "node long, label long, grams binary")
    # rows that repeat a representative's id and text meet here as one
    return sets.dropDuplicates(["node"])


def _compared(blocks: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) from the exact similarities within each block (label, lo, hi, mine, node, grams)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["label", "lo", "hi"]):
            ids, block = group["node"].to_numpy("i8"), group["mine"].to_numpy()
            linked = similar(list(group["grams"]), threshold)
            if group["lo"].iloc[0] != group["hi"].iloc[0]:  # pairs within a block meet elsewhere
                linked &= block[:, None] != block[None, :]
            counts = linked.sum(axis=1)
            yield pd.DataFrame({"node": ids, "root": _roots(linked, ids), "links": counts})[counts > 0]
        give_back()

    dealt = _dealt(blocks.select("label", "lo", "hi", "mine", "node", "grams"), ["label", "lo", "hi"])
    return dealt.mapInPandas(compare, "node long, root long, links long")


def _verified(parts: DataFrame, docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """(node, root, links) from the exact similarities of all pairs within each part.

    What similarity lacks to 1 is a metric: nodes that lack half of what a pair may lack to one node are all linked with
    one another. In a large part only those that lie farther from its least node are compared with the others.
    """
    sizes = parts.groupBy("label").agg(F.count("*").alias("size"))
    sets = _gram_sets(parts, docs, n).join(sizes, "label").checkpoint()
    close = 1 - (1 - threshold) / 2

    def near(pivot: bytes, others: pd.Series) -> np.ndarray:
        p, found = np.frombuffer(pivot, np.uint64), []
        for grams in others:
            x = np.frombuffer(grams, np.uint64)
            both = len(np.intersect1d(p, x, assume_unique=True))
            found.append(both >= close * (len(p) + len(x) - both) + 1e-9)
        return np.array(found, bool)

    few = _compared(_in_block_pairs(sets.where(F.col("size") <= BLOCK), "label", "size"), threshold)
    around = _around_pivot(sets.where(F.col("size") > BLOCK), "label", "size", "grams", near).checkpoint()
    ball = around.where("near").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    inside = around.where("near").join(ball, "key").select("node", F.col("pivot").alias("root"), (F.col("n") - 1).alias("links"))
    rest = _rest_pairs(around).select(F.col("key").alias("label"), "lo", "hi", "mine", "node", F.col("payload").alias("grams"))
    return few.unionByName(inside).unionByName(_compared(rest, threshold))


def _connected(parts: DataFrame, docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """(node, label) of the classes within each part, without counting links.

    First every block of a part is compared with itself and the part's least node, which takes work in proportion to
    the nodes. Where that leaves a part in one piece, no other pair can change it; only of the rest all pairs of blocks
    are compared.
    """
    sets = _gram_sets(parts, docs, n).checkpoint()
    sizes = sets.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("pivot"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    of = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
    alone = sets.join(sizes, "label").select("label", "node", "grams", F.explode(of).alias("lo"))
    near = _compared(alone.withColumns({"hi": F.col("lo"), "mine": F.col("lo")}), threshold).select(F.col("node").alias("a"), F.col("root").alias("b")).checkpoint()
    pieces = sets.select("node", "label").join(connected_components(near).withColumnRenamed("label", "piece"), "node", "left")
    pieces = pieces.withColumn("piece", F.coalesce("piece", "node")).checkpoint()
    open_parts = pieces.groupBy("label").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"), F.count("*").alias("size")).where((F.col("lo") != F.col("hi")) & (F.col("size") > BLOCK))
    rest = _in_block_pairs(sets.join(open_parts.select("label", "size"), "label"), "label", "size").where("lo <> hi")
    far = _compared(rest, threshold).select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected_components(near.union(far))


def similar(sets: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of n-gram sets have a Jaccard similarity of ``threshold`` or more, exactly; none with itself."""
    arrays = [np.frombuffer(s, np.uint64) for s in sets]
    lengths = np.array([len(a) for a in arrays])
    _, columns = np.unique(np.concatenate(arrays), return_inverse=True)
    rows = np.repeat(np.arange(len(arrays)), lengths)
    width = int(columns.max()) + 1 if len(columns) else 0
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    both = np.zeros((len(arrays),) * 2, np.float64)
    step = 8192
    for start in range(0, width, step):
        lo, hi = np.searchsorted(columns, [start, start + step])
        part = np.zeros((len(arrays), min(step, width - start)), np.float32)
        part[rows[lo:hi], columns[lo:hi] - start] = 1
        both += part @ part.T
    union = lengths[:, None] + lengths[None, :] - both
    linked = both >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _parts(found: DataFrame, docs: DataFrame, threshold: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes; the parts (node, label, rep) that hold every pair of nodes that may be similar; ids and texts of all rows."""
    rep = F.min(F.struct(F.col("doc_id").alias("id"), "of")).alias("rep")
    nodes = found.where("node IS NOT NULL").groupBy("node").agg(rep, F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.first("signature").alias("signature"), F.first("bands").alias("bands")).checkpoint()
    likely = connected_components(_likely_pairs(nodes, threshold))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return nodes, likely.join(nodes.select("node", "rep"), "node"), rows


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``doc_id``, ``class_id``, ``n_links``, ``n_copies``.

    Two texts are linked when the Jaccard similarity of their word n-gram sets is ``threshold`` or more. ``class_id`` is
    the least id of the documents connected by links, ``n_links`` how many other n-gram sets a document's own is linked
    to, ``n_copies`` how many rows have its very set, itself included. Copies are one node: they are counted, never
    paired. Null, empty and wordless texts have no links: each is a class by itself with one copy. Null ids are left out
    of the least id unless a class has no other; repeated rows are copies. Other columns are not read. Ids must be whole
    numbers; any other is an error when rows are read.
    """
    ensure_checkpoints(docs.sparkSession)
    found = sketches(docs, doc_id, text, n).checkpoint()
    nodes, parts, rows = _parts(found, docs, threshold, doc_id, text)
    exact = _verified(parts, rows, threshold, n).checkpoint()
    links = exact.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected_components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = nodes.select("node", "least", "n_copies").join(classes, "node", "left").join(links, "node", "left")
    labelled = labelled.select("node", "least", "n_copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    least = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    per_node = labelled.join(least, "label").select("node", "class_id", "n_links", "n_copies")
    joined = found.select("doc_id", "node").join(per_node, "node", "left")
    return joined.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
    )


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every class of ``similarity_classes``; columns stay.

    Of the rows of a class that have an id, the one of least id stays, and of one id the text of least hash; of rows
    alike in id and text one stays. A row goes by its id and text together: another text under the same id has its own
    class. Rows without an id stay, all of them, and so do rows without words, which are classes of their own, whatever
    repeats among them. An empty table gives an empty table. No links are counted. Ids must be whole numbers.
    """
    ensure_checkpoints(docs.sparkSession)
    found = sketches(docs, doc_id, text, n).checkpoint()
    nodes, parts, rows = _parts(found, docs, threshold, doc_id, text)
    classes = _connected(parts, rows, threshold, n).checkpoint()
    named = found.where("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "of", "node").join(classes, "node", "left")
    named = named.select(F.coalesce("label", "node").alias("label"), F.struct(F.col("doc_id").alias("id"), "of").alias("row"))
    first = named.groupBy("label").agg(F.min("row").alias("first")).select("first.*").checkpoint()
    wordless = found.where("node IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "of").distinct()
    stay = first.withColumn("wordless", F.lit(False)).unionByName(wordless.withColumn("wordless", F.lit(True)))
    # columns get numbers for a while, so that no name of theirs meets one in use here; whole rows are shuffled once
    number = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    held = docs.toDF(*number.values()).withColumns({"key": F.col(number[doc_id]).cast("long"), "hash": F.xxhash64(number[text])})
    chosen = held.join(stay, (F.col("key") == F.col("id")) & (F.col("hash") == F.col("of")))
    once = F.when(F.col("wordless"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    chosen = chosen.withColumn("once", once).dropDuplicates(["key", "hash", "once"])
    out = chosen.select(*number.values()).unionByName(held.where(F.col("key").isNull()).select(*number.values()))
    return out.toDF(*docs.columns)
