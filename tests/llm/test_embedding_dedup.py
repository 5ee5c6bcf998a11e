"""Near copies among embeddings against all pairs; the graph's recall; what has no direction."""

import math

import numpy as np
import pytest

from bytebasin.llm import embedding_dedup as ed
from bytebasin.llm.small_world import SmallWorld

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def plain(rows, threshold=0.95):
    """Sorted (vec_id, n_links, component_id, kept)."""
    good = {i: np.array(v, np.float32).astype(float) for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in range(len(rows))}
    for dim in {len(v) for v in good.values()}:
        at = [i for i, v in good.items() if len(v) == dim]
        m = np.stack([good[i] for i in at])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(m @ m.T >= threshold)):
            if a != b:
                links[at[a]].add(at[b])
    part = {}
    for i in links:
        if i not in part:
            reached, todo = {i}, [i]
            while todo:
                more = links[todo.pop()] - reached
                reached |= more
                todo += more
            least = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
            part |= dict.fromkeys(reached, least)
    return sorted(((r[0], len(links[i]), part[i], r[0] == part[i]) for i, r in enumerate(rows)), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], SCHEMA)
    return sorted(map(tuple, ed.near_copies(df.repartition(4), **how).collect()), key=repr)


def planted(seed, n=1500, dim=32):
    """Random vectors, tight groups, loose chains and exact copies among them."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    parts = [base]
    for size, noise in [(40, 0.03), (15, 0.18), (9, 0.22), (2, 0.2), (2, 0.05), (120, 0.2)]:
        c = rng.normal(size=dim)
        parts.append(c + noise * rng.normal(size=(size, dim)))
    a, b = rng.normal(size=(2, dim))
    parts.append(np.array([math.cos(t) * a / np.linalg.norm(a) + math.sin(t) * b / np.linalg.norm(b) for t in np.linspace(0, 1.4, 12)]))
    parts.append(np.repeat(base[:3], [7, 1, 2], axis=0))
    parts.append(base[3:5] * 2.5)
    v = np.vstack(parts).astype(np.float32)
    order = rng.permutation(len(v))
    return [(int(k), v[i].tolist()) for k, i in enumerate(order)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ed, "LEAST_ROWS", 300)
    monkeypatch.setattr(ed, "SLICE", 700)
    monkeypatch.setattr(ed, "BLOCK", 16)
    rows = planted(1)
    assert run(spark, rows) == plain(rows)


def test_what_has_no_direction_and_ids(spark):
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.01], [1.0], [-3.0], [5.0], [1e-40, 1e-40], [3e38, 3e38]]
    rows = [(i, v) for i, v in enumerate(odd)] + [(3, [1.0, 0.0]), (None, [1.0, 0.02]), (None, [0.0, 1.0]), (None, None), (20, [-1.0, -1.0]), (20, [-1.0, -1.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (1, None)]) == [(1, 0, 1, True)] * 2


def test_full_beams_are_widened_and_read_through(spark, monkeypatch):
    """Groups larger than any beam: every link counts, in a tight group and in a loose one."""
    monkeypatch.setattr(ed, "LEAST_ROWS", 200)
    monkeypatch.setattr(ed, "BEAM", 4)
    monkeypatch.setattr(ed, "BLOCK", 64)
    rng = np.random.default_rng(3)
    c, d = rng.normal(size=(2, 16))
    v = np.vstack([c + 0.02 * rng.normal(size=(150, 16)), d + 0.2 * rng.normal(size=(150, 16)), rng.normal(size=(300, 16))]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("dim, n", [(8, 700), (64, 3000)])
def test_graph_recall(dim, n):
    rng = np.random.default_rng(5)
    vectors = ed.units(rng.normal(size=(n, dim)))
    world = SmallWorld.built(vectors)
    beam, recall = ed.audited_beam(world, vectors, 0.95)
    assert recall >= ed.RECALL
    # nearest neighbours of other queries, against brute force
    queries = ed.units(rng.normal(size=(200, dim)))
    ids, _ = world.search(queries, 4 * beam)
    best = (queries @ vectors.T).argmax(axis=1)
    assert np.mean([b in i for b, i in zip(best, ids)]) >= 0.9


def test_query_against_plain(spark, sf):
    from bytebasin.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op13_embedding_dedup"](spark, sf).collect()), key=repr) == plain(rows)


def shuffled(spark):
    """Bytes shuffled so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    none = context._jvm.java.util.ArrayList()
    stages = context._jsc.sc().statusStore().stageList(none, False, False, context._gateway.new_array(context._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_graphs_are_not_copied_for_slices(spark, monkeypatch, tmp_path):
    """A shard's graph isn't shuffled to those who ask it, nor are vectors for each shard; and no file of it stays."""
    monkeypatch.setattr(ed, "LEAST_ROWS", 300)
    monkeypatch.setattr(ed, "SLICE", 100)
    monkeypatch.setattr(ed, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    rows = planted(4, n=3000)
    want, before = plain(rows), shuffled(spark)
    assert run(spark, rows) == want
    assert shuffled(spark) - before < 12 * len(rows) * 32 * 8
    assert not any(tmp_path.iterdir())


def test_search_in_wide_beams_goes_by_fewer_queries(monkeypatch):
    from bytebasin.llm import small_world

    rng = np.random.default_rng(6)
    world = SmallWorld.built(ed.units(rng.normal(size=(400, 8))))
    queries = ed.units(rng.normal(size=(50, 8)))
    ids, sims = world.search(queries, 400)
    monkeypatch.setattr(small_world, "WIDE", 400)
    again = world.search(queries, 400)
    assert (again[0] == ids).all() and np.allclose(again[1], sims, atol=1e-6)
