"""Decontamination against a search of every window in every document."""

import hashlib
import random

from bytebasin.llm import decontaminate
from bytebasin.llm.queries import op4_decontaminate
from bytebasin.llm.words import words_of


def windows(items, n=10):
    found = {}
    for item, text in items:
        w = words_of(text)
        if item is None or not w:
            continue
        for i in range(max(1, len(w) - n + 1)):
            found.setdefault(tuple(w[i : i + n]), set()).add(item)
    return found


def expected(text, found):
    w, hit, owners = words_of(text), set(), set()
    for n in {len(k) for k in found}:
        for i in range(len(w) - n + 1):
            if (key := tuple(w[i : i + n])) in found:
                hit |= set(range(i, i + n))
                owners |= found[key]
    return len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items):
    found = windows([(None if i is None else str(i), t) for i, t in items])
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, hits string, n_items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.digests(decontaminate.with_hits(frame, bench)).collect()}
    assert len(got) == len(docs)
    for i, t in enumerate(docs):
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == expected(t, found), t


def test_random_texts_over_few_words(spark):
    rng = random.Random(1)

    def text(n, k=3):
        return " ".join(rng.choice("abcdefg"[:k]) for _ in range(n))

    items = [(i, text(rng.randint(0, 30))) for i in range(25)] + [(3, text(12)), (None, text(20)), (90, None), (91, "!!"), (92, "a b a"), (93, "g")]
    docs = [text(rng.randint(0, 60), rng.choice([2, 3, 7])) for _ in range(80)] + [None, "", "?", "G", text(3000)]
    check(spark, docs, items)


def test_query(spark, sf):
    found = windows([(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = {r.doc_id: r for r in op4_decontaminate(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows.values())
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected(d.text, found)


def test_several_automata_find_what_one_does(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(8)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(20)]
    docs = [" ".join(rng.choices(words, k=5)) + " " + items[i % 20][1] + " x " + items[(i * 7) % 20][1][4:40] for i in range(15)]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    check(spark, docs, items)


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(0, f"Keep É this. {item.upper()}! and this as well as all of these other words"), (1, item), (2, "clean one two"), (3, None), (4, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(frame, bench).collect()}
    assert got == {0: "Keep É this. ! and this as well as all of these other words", 2: "clean one two", 3: None, 4: ""}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digests(decontaminate.with_hits(docs, none)).collect()[0].n_hit == 0
    assert decontaminate.with_hits(docs.limit(0), none).count() == 0


def test_several_blocks_in_one_pass_each(spark, monkeypatch):
    """Over several blocks the same stretches go as over one; no text is written, repeated rows and clashing names stay."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i % 17, " ".join(rng.choices(words, k=rng.choice([4, 12, 25])))) for i in range(30)]
    texts = [" ".join(rng.choices(words, k=20)) + " - " + items[i % 30][1] + ". " + " ".join(rng.choices(words, k=30)) + items[(i * 7) % 30][1] for i in range(25)]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate([*texts, *texts[:9], texts[0], None, None, "", "clean"])] + [(None, texts[3], "y", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, __0 int, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    whole, hits = key(decontaminate.decontaminate(docs, bench)), key(decontaminate.with_hits(docs, bench, into="spans"))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert len(list(decontaminate._blocks(bench, "item_id", "text"))) > 3
    assert key(decontaminate.decontaminate(docs, bench)) == whole and key(decontaminate.with_hits(docs, bench, into="spans")) == hits
    assert any(r[1] != t[1] for r, t in zip(whole, sorted(rows, key=repr)))
