"""Near copies among embeddings: small-world graphs by shard, every shard asked by every vector, links verified, components.

Equal vectors are one node. Each shard's task builds a graph and audits it: queries that lie at the threshold from known
vectors are sought with the graph and by brute force, and the beam is widened until the graph finds enough. Graphs are
files that all tasks share; a slice of the vectors asks one after another. A link found is verified in double precision;
a task hands on as many links as connect what it has found. A component's links are then counted exactly: at once where
all its members lie so near to their mean that each pair must be linked, else by comparing its members in blocks.
"""

from __future__ import annotations

import math
import posixpath
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from bytebasin.llm.common import drop_folder, ensure_checkpoints, give_back, shared_folder
from bytebasin.llm.components import connected_components
from bytebasin.llm.small_world import LINKS, SmallWorld

THRESHOLD = 0.95
#: Vectors in a shard at most, about; and shards over which fewer vectors are dealt, so that they are built side by side.
SHARD_ROWS, SHARDS, LEAST_ROWS = 1 << 16, 8, 1000
#: Vectors that ask the shards in one task, about; and slices over which fewer vectors are dealt.
SLICE, SLICES, LEAST_SLICE = 8192, 32, 1024
#: Beam at first; queries in an audit, and the share of their links that the graph must find.
BEAM, AUDITS, RECALL = 32, 256, 0.995
#: A beam full of links is widened up to this share of a shard; beyond it the shard is read through.
WIDEST = 1 / 8
#: Vectors of a component in one block.
BLOCK = 1024
#: What a similarity in single precision may lack.
SLACK = 1e-4
#: Numbers that vectors compared with a whole shard, or beams of a search, may take at a time.
NUMBERS = 1 << 22


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; they are scaled first, so that no square leaves the range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or infinite component, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _parts(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """``rows`` a few at a time, so that ``width`` numbers for each of them are bounded."""
    step = max(1, NUMBERS // max(1, width))
    for lo in range(0, len(rows), step):
        yield rows[lo : lo + step]


def audited_beam(world: SmallWorld, vectors: np.ndarray, threshold: float, seed: int = 11) -> tuple[int, float]:
    """The beam with which a shard's graph finds at least ``RECALL`` of the links that brute force finds, and its recall.

    Queries lie at the threshold from vectors of the shard, the hardest place from which these must be found. A query
    whose beam is full of links is left out: it is widened anyway.
    """
    rng = np.random.default_rng(seed)
    base = vectors[rng.choice(len(vectors), min(AUDITS, len(vectors)), replace=False)]
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    near = min(1.0, threshold + 1e-3)
    queries = units(near * base + math.sqrt(1 - near * near) * aside)
    links = np.vstack([part @ vectors.T >= threshold for part in _parts(queries, len(vectors))])
    beam = min(BEAM, len(vectors))
    while True:
        ids, sims = world.search(queries, beam)
        found = np.zeros_like(links)
        rows, at = np.nonzero((ids >= 0) & (sims >= threshold - SLACK))
        found[rows, ids[rows, at]] = True
        open_ = found.sum(axis=1) < beam
        wanted = links[open_].sum()
        recall = float((found & links)[open_].sum() / wanted) if wanted else 1.0
        if recall >= RECALL or beam >= len(vectors):
            return beam, recall
        beam = min(2 * beam, len(vectors))


def build_index(nodes: DataFrame, shards: int, folder: str, threshold: float = THRESHOLD) -> list[Row]:
    """(dim, shard, n, beam, recall, file) of nodes (node, dim, vector): a graph for each shard, written to ``folder``,
    and its audit.

    ``folder`` must be shared by the executors (any file system that Arrow opens). A task names its file after its own
    attempt, and the rows, of which the driver gets one a shard, name the files of the attempts that counted.
    """

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        ids = rows.column("node").to_numpy()
        order = np.argsort(ids)
        vectors = units(_matrix(rows.column("vector"), dim)[order])
        world = SmallWorld.built(vectors)
        beam, recall = audited_beam(world, vectors, threshold)
        levels = {f"graph{i}": g for i, g in enumerate(world.graph)} | {f"entries{i}": e for i, e in enumerate(world.entries)}
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        file = f"graph-{dim}-{shard}-{TaskContext.get().taskAttemptId()}.npz"
        with fs.open_output_stream(posixpath.join(base, file)) as out:
            np.savez(out, ids=ids[order], vectors=vectors, **levels)
        del world, vectors, levels
        give_back()
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "beam": pa.array([beam], pa.int32()), "recall": [recall], "file": [file]})

    shard = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    dealt = nodes.select("dim", shard.alias("shard"), "node", "vector")
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, n long, beam int, recall double, file string").collect()


def _links(world: SmallWorld, vectors: np.ndarray, queries: np.ndarray, beam: int, threshold: float):
    """For each query (its row, the shard's vectors that it is linked to), verified in double precision."""
    left, most = np.arange(len(queries)), max(beam, int(len(vectors) * WIDEST))
    while len(left) and beam <= most:
        full = []
        for part in _parts(left, max(beam, NUMBERS // 1024)):
            ids, sims = world.search(queries[part], beam)
            near = (ids >= 0) & (sims >= threshold - SLACK)
            whole = near.all(axis=1) & (beam < len(vectors))
            full.append(part[whole])
            for row, hit in zip(part[~whole], [i[n] for i, n in zip(ids[~whole], near[~whole])]):
                yield row, hit[vectors[hit] @ queries[row] >= threshold]
        left, beam = np.concatenate(full), beam * 2
    for part in _parts(left, len(vectors)):
        linked = queries[part] @ vectors.T >= threshold
        for row, hits in zip(part, linked):
            yield row, np.flatnonzero(hits)


def find_links(nodes: DataFrame, index: list[Row], folder: str, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) that connect all nodes that any shard's graph has found linked; each edge is a verified link, or the
    first node that a vector of the shard was linked with stands for that vector.

    A task holds a slice of the vectors and one graph at a time, so neither is copied for the other.
    """
    slices = max(1, -(-n // SLICE), min(SLICES, -(-n // LEAST_SLICE)))
    shards = defaultdict(list)
    for row in index:
        shards[row["dim"]].append((row["file"], row["beam"]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        asking = pa.Table.from_batches(held)
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for dim in pc.unique(asking.column("dim")).to_pylist():
            mine = asking.filter(pc.equal(asking.column("dim"), dim))
            names, queries = mine.column("node").to_numpy(), units(_matrix(mine.column("vector"), dim))
            for file, beam in shards[dim]:
                with fs.open_input_file(posixpath.join(base, file)) as source, np.load(source) as stored:
                    levels = sum(k.startswith("graph") for k in stored.files)
                    ids, vectors = stored["ids"], stored["vectors"]
                    world = SmallWorld.restored(vectors, [stored[f"graph{i}"] for i in range(levels)], [stored[f"entries{i}"] for i in range(levels)], LINKS)
                a, b = [], []
                owner = np.full(len(ids), -1, np.int64)
                for row, hits in _links(world, vectors, queries, beam, threshold):
                    hits = hits[ids[hits] != names[row]]
                    if not len(hits):
                        continue
                    new = hits[owner[hits] < 0]
                    known = np.unique(owner[hits[owner[hits] >= 0]])
                    owner[new] = names[row]
                    ends = np.concatenate([ids[new], known[known != names[row]]])
                    a.append(np.full(len(ends), names[row]))
                    b.append(ends)
                if a:
                    yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])
        give_back()

    return nodes.select("dim", "node", "vector").repartition(slices).mapInArrow(ask, "a long, b long")


def _all_linked(members: DataFrame, threshold: float) -> DataFrame:
    """(label, size, total, tight) of components: ``tight`` where every member lies within half the threshold's angle of
    the mean direction, so that each pair is linked."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = members.withColumn("unit", F.transform("vector", lambda x: x / length))
    sums = unit.select("label", F.posexplode("unit").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"))
    means = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    dot = F.aggregate(F.zip_with("unit", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    least = math.cos(math.acos(threshold) / 2) + 1e-9
    found = unit.join(means, "label").select("label", "copies", (dot / norm).alias("near"))
    return found.groupBy("label").agg(F.count("*").alias("size"), F.sum("copies").alias("total"), F.coalesce(F.min("near") >= least, F.lit(False)).alias("tight"))


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): how many other vectors each member (label, size, node, dim, vector, copies) is linked with."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("lo"), F.greatest(o, F.col("mine")).alias("hi")))
    rows = members.withColumns({"blocks": blocks, "mine": mine}).withColumn("pair", F.explode(others))

    def count(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        names, mine, copies = (rows.column(c).to_numpy() for c in ("node", "mine", "copies"))
        vectors = units(_matrix(rows.column("vector"), dim))
        linked = vectors @ vectors.T >= threshold
        np.fill_diagonal(linked, False)
        if rows.column("lo")[0].as_py() != rows.column("hi")[0].as_py():  # pairs within a block meet elsewhere
            linked &= mine[:, None] != mine[None, :]
        return pa.table({"node": names, "links": linked @ copies})

    rows = rows.select("label", "pair.lo", "pair.hi", "mine", "node", "dim", "vector", "copies")
    return rows.groupBy("label", "lo", "hi").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_copies(rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: the other vectors at a cosine of ``threshold`` or more, the
    least id that links lead to, and whether that is the row's own.

    Links are found with recall (see ``build_index``) and verified exactly; within a component all links are counted.
    Null and empty vectors, those of zeros and those with null or non-finite components link with nothing, and vectors of
    different lengths don't link. Repeated rows are copies, linked with each other. Ids must be whole numbers; rows
    without one take part, are not named as a component's least id unless it has no other, and are kept in that case
    alone. An empty table has no rows. Other columns are not read.

    Equal vectors, however many, are one node; each task holds a shard and a slice of the vectors. Graphs lie in the
    checkpoint folder until all links are found.
    """
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    good = usable(F.col("vector"))
    keyed = plain.select("vec_id", *[F.when(good, F.xxhash64(F.lit(s), "vector")).alias(f"h{s}") for s in (1, 2)], F.when(good, F.col("vector")).alias("vector"))
    nodes = keyed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("vector")}).checkpoint()
    n = nodes.count()
    shards = max(1, -(-n // SHARD_ROWS), min(SHARDS, -(-n // LEAST_ROWS)))
    vectors = nodes.select("node", "dim", "vector")
    folder = shared_folder(spark, "embedding-graphs")
    index = build_index(vectors, shards, folder, threshold)
    # checkpointed, as components read links twice
    links = find_links(vectors, index, folder, n, threshold).checkpoint()
    drop_folder(spark, folder)
    labels = connected_components(links)
    members = nodes.drop("h1", "h2").join(labels, "node").checkpoint()
    parts = _all_linked(members, threshold).checkpoint()
    sized = members.join(parts, "label")
    loose = _counted(sized.where("NOT tight"), threshold)
    own = members.join(parts.select("label", "total", "tight"), "label").join(loose, "node", "left")
    least = members.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = F.when(F.col("tight"), F.col("total") - 1).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    found = own.join(least, "label").select("node", linked.alias("n_links"), "component_id")
    per_node = nodes.select("h1", "h2", "node", "copies", "least").join(found, "node", "left")
    per_node = per_node.select("h1", "h2", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.lit(True).alias("met"))
    out = keyed.drop("vector").join(per_node, ["h1", "h2"], "left")
    component = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
