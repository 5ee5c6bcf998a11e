"""The Merkle manifest against a plain one, over trees of every shape."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bytebasin.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, tree int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree_of(leaves, fanout):
    """Levels of nodes, up to a single one."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout):
    found = []
    for below in levels[:-1]:
        g = i - i % fanout
        found.append(("".join(below[g:i]), "".join(below[i + 1 : g + fanout])))
        i //= fanout
    return found


def plain(rows, fanout):
    """Sorted (doc_id, leaf, path, subroot, root)."""
    trees = {}
    for r in rows:
        trees.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    names, built = sorted(trees), []
    for n in names:
        order = sorted(trees[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built.append((order, tree_of([leaf_of(r) for r in order], fanout)))
    top = tree_of([levels[-1][0] for _, levels in built], fanout)
    out = []
    for t, (order, levels) in enumerate(built):
        for i, r in enumerate(order):
            out.append((r[0], leaf_of(r), tuple(siblings(levels, i, fanout) + siblings(top, t, fanout)), levels[-1][0], top[-1][0]))
    return sorted(out, key=repr)


def rows_of(counts, seed=0):
    rng = random.Random(seed)
    rows, k = [], 0
    for lang, n in counts.items():
        for _ in range(n):
            k += 1
            rows.append((k * 7 % 1009, rng.choice(["a", None, "ü"]), lang, k, rng.choice(["Some Text", "", None, "é" * k, "x" * 5000]), "p", 1))
    return rng.sample(rows, len(rows))


@pytest.mark.parametrize("fanout, levels, counts", [
    (2, 1, {"en": 37, "de": 1, None: 6, "": 2, "zz": 16}),
    (2, 0, {"en": 23, "fr": 8}),
    (3, 1, {"en": 1}),
    (8, 1, {"en": 75, "de": 9, "x": 64}),
    (3, 2, {f"l{i}": 1 + i % 4 for i in range(14)}),
])
def test_against_a_plain_tree(spark, fanout, levels, counts):
    rows = rows_of(counts)
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout, levels=levels).collect()
    got = sorted(((r["doc_id"], r["leaf"], tuple(map(tuple, r["path"])), r["subroot"], r["root"]) for r in found), key=repr)
    assert got == plain(rows, fanout)


def test_paths_prove_and_tampering_shows(spark):
    rows = rows_of({"en": 40, None: 3})
    docs = spark.createDataFrame(rows, SCHEMA)
    later = merkle.digest(*[F.lower("text") if c == "text" else F.col(c) for c in merkle.FIELDS])
    found = merkle.verified(merkle.manifest(docs, fanout=3, levels=1, keep={"later": later}), "later").collect()
    assert len(found) == len(rows)
    changed = {r[0] for r in rows if r[4] and r[4] != r[4].lower()}
    assert {r["doc_id"] for r in found if not r["verified"]} == changed
    for r in found:
        assert r["proof_sha256"] == h("".join(a + b for a, b in r["path"]))


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None, None, "p", 1)] * 3 + [(5, "a", "en", 1, "x", "p", 1)] * 12
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=2, levels=1).collect()
    assert len(found) == 15 and len({r["root"] for r in found}) == 1
    assert sorted(r["position"] for r in found if r["lang"] is None) == [0, 1, 2]
    assert sorted(r["position"] for r in found if r["lang"]) == list(range(12))
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_plain(spark, sf):
    from bytebasin.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*merkle.FIELDS).collect()]
    want = {w[0]: w for w in plain(rows, 8)}
    found = QUERIES["op11_merkle_manifest"](spark, sf).collect()
    texts = {r[0]: r[4] for r in rows}
    for r in found:
        _, leaf, path, subroot, root = want[r["doc_id"]]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (leaf, subroot, root, h("".join(a + b for a, b in path)))
        t = texts[r["doc_id"]]
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and t and any("A" <= c <= "Z" for c in t)
        assert r["verified"] == (not tampered) == (r["folded_root"] == root)
