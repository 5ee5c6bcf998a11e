"""A Merkle manifest of a table: a leaf for each row, a tree for each value of a column, one root over the trees.

Rows lie in blocks of consecutive leaves, each block being one place of the exchange. A block hashes its own subtree;
then aligned groups of ``FANOUT`` blocks swap their subtrees' roots round by round, as in a butterfly network, and every
member hashes their common ancestor for itself. After the last round each block has all siblings on its way to the root:
there is no pass back down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import ensure_checkpoints, staged
from bytebasin.operators.ranking import global_rank

FANOUT = 8
#: Levels that a block hashes by itself: FANOUT ** LEVELS leaves.
LEVELS = 3
#: Trees up to which a row for each is broadcast; more are joined by shuffle.
FEW_TREES = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left: string, right: string>"


def digest(*values: Column) -> Column:
    """Hexadecimal SHA-256 of values one after another: ``-`` for a null, else its bytes' number, ``:`` and itself."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings on its path."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def siblings_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], whole: bool, fanout: int, levels: int) -> list[list[str]]:
    """Nodes of a block level by level; a block that is its whole tree ends with a single node."""
    found = [leaves]
    while len(found[-1]) > 1 if whole else len(found) <= levels:
        below = found[-1]
        found.append([_hash("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return found


def _join_trees(rows: DataFrame, trees: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(trees) if few else trees, "tree")


def _exchange(nodes: DataFrame, most: int, fanout: int) -> DataFrame:
    """``nodes`` (tree, part, parts, digest) with the digest of the tree's root and ``path``, the siblings up to it.

    Part p of a tree has parts p // w * w up to its w-th as its subtree in the round of width w. It swaps with those
    that have the same place in the other subtrees under one parent. The last subtree may be short: its parts then stand
    in for the places that it lacks. A part sends one row a round and gets at most ``fanout`` digests.
    """
    state = nodes.select("tree", "part", "parts", "digest", F.expr(f"CAST(array() AS ARRAY<{STEP}>)").alias("path"))
    width = 1
    while width < most:
        w = F.lit(width).cast("long")
        node, place = F.expr(f"part div {width}"), F.expr(f"part % {width}")
        nodes_now = F.expr(f"(parts + {width - 1}) div {width}")
        size = F.least(w, F.col("parts") - node * w)
        # places that a short last subtree lacks, unless it is alone under its parent
        stands_in = (size < w) & (node % fanout != 0) & (place + size < w)
        places = F.when(stands_in, F.sequence(place, F.when(stands_in, w - 1).otherwise(place), F.when(stands_in, size).otherwise(F.lit(1).cast("long")))).otherwise(F.array(place))
        sent = state.select("*", node.alias("node"), place.alias("own"), nodes_now.alias("nodes"), F.explode(places).alias("place"))
        real = F.col("own") == F.col("place")
        member = F.struct("node", "digest", real.alias("real"), "part", F.when(real, F.col("path")).alias("path"))
        groups = sent.groupBy("tree", "parts", "nodes", F.expr(f"node div {fanout}").alias("parent"), "place").agg(F.array_sort(F.collect_list(member)).alias("group"))
        swapped = groups.select("tree", "parts", "nodes", "group", F.explode(F.filter("group", lambda x: x["real"])).alias("me"))
        all_of, mine = F.col("group"), F.col("me.node")
        joined = {
            "left": F.array_join(F.transform(F.filter(all_of, lambda x: x["node"] < mine), lambda x: x["digest"]), ""),
            "right": F.array_join(F.transform(F.filter(all_of, lambda x: x["node"] > mine), lambda x: x["digest"]), ""),
        }
        above = F.sha2(F.concat("left", "me.digest", "right"), 256)
        grew = F.col("nodes") > 1  # a tree that has come to its root is left as it is
        state = swapped.withColumns(joined).select(
            "tree", F.col("me.part").alias("part"), "parts", F.when(grew, above).otherwise(F.col("me.digest")).alias("digest"),
            F.when(grew, F.concat("me.path", F.array(F.struct("left", "right")))).otherwise(F.col("me.path")).alias("path"),
        )
        width *= fanout
    return state


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", tree: str = "lang", keep: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, tree, position, leaf, path, subroot, root) of every row, and ``keep``'s columns of the rows.

    ``leaf`` is ``digest`` of ``fields``. In each tree, one for each value of ``tree``, leaves ascend by ``key``; while
    there are several nodes, every ``fanout`` consecutive ones become the digest of theirs put together, the last run
    being what is left. What remains is ``subroot``; subroots in the order of their trees give ``root`` likewise.
    ``path`` has the siblings to the left and to the right at every level from the leaf to the root.

    Rows without a key come first in their tree, the tree of null first of all; rows of one key are ordered by their
    leaf, and rows alike are leaves one after another. Null and empty fields have digests of their own. An empty table
    has no rows. Other columns are not read. Only digests, keys and ``keep`` are shuffled, never the fields.
    """
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    keep = keep or {}
    named = {"tree": F.concat(F.when(F.col(tree).isNull(), "0").otherwise("1"), F.coalesce(F.col(tree).cast("string"), F.lit(""))), "key": F.col(key), "leaf": digest(*[F.col(c) for c in fields])}
    held = [f"keep_{i}" for i in range(len(keep))]
    # hashed once: ranking by ranges reads its rows twice
    leaves = docs.select(*[c.alias(n) for n, c in (named | dict(zip(held, keep.values()))).items()]).checkpoint()
    ranked = global_rank(leaves, "tree", "key", "leaf", F.monotonically_increasing_id())
    trees = ranked.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("n")).checkpoint()
    few = trees.limit(FEW_TREES + 1).count() <= FEW_TREES
    per_block = fanout**levels
    placed = _join_trees(ranked, trees, few).withColumn("pos", F.col("rank") - F.col("first"))
    leaf = F.struct("pos", "key", "leaf", *held)
    blocks = placed.groupBy("tree", F.expr(f"pos div {per_block}").alias("part"), "n").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    blocks = blocks.withColumn("parts", F.expr(f"(n + {per_block - 1}) div {per_block}")).checkpoint()

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [_levels(x, parts == 1, fanout, levels)[-1][0] for x, parts in zip(b.column("leaves").to_pylist(), b.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("tree", "part", "parts")] + [pa.array(tops, pa.string())], ["tree", "part", "parts", "digest"])

    hashed = blocks.select("tree", "part", "parts", F.col("leaves.leaf").alias("leaves")).mapInArrow(roots, "tree string, part long, parts long, digest string").checkpoint()
    most = hashed.agg(F.max("parts")).first()[0] or 0
    paths = _exchange(hashed, most, fanout).checkpoint()
    tops = global_rank(paths.where("part = 0").select(F.col("tree").alias("of"), "digest"), "of").withColumnRenamed("rank", "part").checkpoint()
    n_trees = tops.count()
    upper = _exchange(tops.select(F.lit("").alias("tree"), "part", F.lit(n_trees).cast("long").alias("parts"), "digest"), n_trees, fanout)
    upper = tops.select("part", F.col("of").alias("tree")).join(upper.select("part", F.col("digest").alias("root"), F.col("path").alias("over")), "part").drop("part").checkpoint()
    paths = _join_trees(paths, upper, n_trees <= FEW_TREES)
    above = paths.select("tree", "part", F.col("digest").alias("subroot"), "root", F.concat("path", "over").alias("above"))
    columns = {"key": leaves.schema["key"].dataType, **{n: leaves.schema[n].dataType for n in held}}

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of every leaf with the siblings within its block and those above it."""
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                own = row["leaves"].values
                nodes = _levels(own.field("leaf").to_pylist(), row["parts"].as_py() == 1, fanout, levels)
                sides = []
                for below in nodes[: len(nodes) - 1]:
                    runs = [(below[i - i % fanout : i], below[i + 1 : i - i % fanout + fanout]) for i in range(len(below))]
                    sides.append([("".join(a), "".join(z)) for a, z in runs])
                over = [(s["left"], s["right"]) for s in row["above"].as_py()]
                steps = [s for i in range(len(own)) for s in (*[side[i // fanout**j] for j, side in enumerate(sides)], *over)]
                each = len(sides) + len(over)
                path = pa.ListArray.from_arrays(pa.array(range(0, (len(own) + 1) * each, each) if each else [0] * (len(own) + 1), pa.int32()), pa.StructArray.from_arrays([pa.array([s[x] for s in steps], pa.string()) for x in (0, 1)], ["left", "right"]))
                same = {c: pa.array([row[c].as_py()] * len(own), pa.string()) for c in ("tree", "subroot", "root")}
                out = {"key": own.field("key"), "tree": same["tree"], "position": own.field("pos"), "leaf": own.field("leaf"), "path": path, "subroot": same["subroot"], "root": same["root"]}
                yield pa.RecordBatch.from_pydict(out | {n: own.field(n) for n in held})

    joined = blocks.select("tree", "part", "parts", "leaves").join(above, ["tree", "part"])
    schema = f"key {columns['key'].simpleString()}, tree string, position long, leaf string, path array<{STEP}>, subroot string, root string" + "".join(f", {n} {columns[n].simpleString()}" for n in held)
    found = joined.mapInArrow(proofs, schema)
    named_tree = F.when(F.col("tree") != "0", F.expr("substring(tree, 2)")).cast(docs.schema[tree].dataType)
    return found.select(F.col("key").alias(key), named_tree.alias(tree), "position", "leaf", "path", "subroot", "root", *[F.col(n).alias(c) for n, c in zip(held, keep)])


def verified(rows: DataFrame, later: str, into: str = "folded_root") -> DataFrame:
    """Rows of a manifest with ``into``, the root folded from the leaf ``later`` and the original siblings, and
    ``verified``, whether that is the manifest's root."""
    out = staged(rows, **{into: folded(F.col(later), F.col("path")), "proof_sha256": siblings_digest(F.col("path"))})
    return out.withColumn("verified", F.col(into) == F.col("root"))
