"""Line dedup against a plain search of all matches."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bytebasin.llm import line_dedup as ld
from bytebasin.llm.queries import op1_line_dedup


def lines(text):
    return [x for x in re.split(ld.LINE_END, text or "") if x]


def plain(line):
    return line.strip().lower()


def words(key):
    return key.count(" ") + 1


def expected(docs, least=ld.MIN_WORDS):
    """Text left and lines gone by document, docs being (id, text, order among texts of one id).

    Every place is held against all earlier places with the same line, and the match is followed as far as it goes.
    """
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[2]))
    seen, out = {}, {}
    for number, text, _ in order:
        mine = lines(text)
        solid = [i for i, x in enumerate(mine) if plain(x)]
        keys = [plain(mine[i]) for i in solid]
        covered = set()
        for p, k in enumerate(keys):
            for other, q in seen.setdefault(k, []):
                if p and q and keys[p - 1] == other[q - 1]:
                    continue  # part of a longer match
                n = 0
                while p + n < len(keys) and q + n < len(other) and keys[p + n] == other[q + n]:
                    n += 1
                if sum(map(words, keys[p : p + n])) >= least:
                    covered |= set(range(p, p + n))
            seen[k].append((keys, p))
        gone = {solid[p] for p in covered}
        for p in covered:
            if p + 1 in covered:  # blank lines between
                gone |= set(range(solid[p], solid[p + 1]))
        out[number, text] = ("".join(x for i, x in enumerate(mine) if i not in gone) if gone else text, len(gone))
    return out


def check(docs, rows):
    """``rows`` are (id, text, removed lines) of what is left, ``docs`` (id, text)."""
    of = ranked(docs)
    want = expected([(*d, of[d]) for d in docs])
    assert sorted(rows, key=str) == sorted([(d[0], *want[d]) for d in docs], key=str)


def ranked(docs):
    """Order of the texts of one id: by the hash that Spark gives them."""
    from pyspark.sql import SparkSession

    once = Counter(number for number, _ in set(docs))
    of = dict.fromkeys(docs, 0)
    many = [d for d in of if once[d[0]] > 1]
    if many:
        frame = SparkSession.active().createDataFrame(many, "id long, text string")
        of |= {(r.id, r.text): r.of for r in frame.select("id", "text", F.xxhash64("text").alias("of")).collect()}
    return of


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n)).capitalize() + "."


def test_planted_passages(spark):
    rng = random.Random(5)
    passages = [" ".join(sentence(rng, rng.choice([6, 9, 14])) for _ in range(8)) for _ in range(4)] + [sentence(rng, 60)]
    docs = []
    for i in range(60):
        own = [sentence(rng, rng.randint(3, 20)) for _ in range(rng.randint(1, 12))]
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            sep = rng.choice(["\n", " "])
            own[at:at] = [passages[i % 5] + sep.strip(" ")]
        docs.append((i, rng.choice(["\n", " "]).join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = ld.dedup_lines(frame).collect()
    check(docs, [tuple(r) for r in rows])
    got = {r.doc_id: r.text for r in rows}
    first = {}
    for i, t in docs:
        if i % 3 == 0:
            p = passages[i % 5]
            if p in first:
                assert p not in got[i] and len(got[i]) <= len(t) - len(p)
            else:
                assert p in got[i]
            first.setdefault(p, i)
        else:
            assert got[i] == t


@pytest.mark.parametrize("seed", range(4))
def test_few_lines_repeated_at_random(spark, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, n) for n in (1, 1, 2, 3, 5, 8, 9, 11, 17, 24, 25, 30)] + ["", "  "]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 25)))) for i in range(70)]
    docs += [(rng.randint(0, 90), "\n".join(rng.choices(pool[:8], k=rng.randint(5, 60)))) for _ in range(30)] + [(None, docs[3][1]), (None, docs[4][1]), (5, docs[6][1]), (5, docs[6][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(docs, [tuple(r) for r in ld.dedup_lines(frame).collect()])


def test_passages_cut_at_random_out_of_others(spark):
    """Matches of all lengths, a passage's pieces standing first in different documents and contexts."""
    rng = random.Random(12)
    books = [[sentence(rng, rng.choice([2, 4, 7, 12, 20])) for _ in range(40)] for _ in range(3)]
    docs = []
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 4)):
            book = rng.choice(books)
            at = rng.randint(0, 39)
            text += book[at : at + rng.randint(1, 9)] + [sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(0, 2))]
        docs.append((rng.randint(0, 10**9), rng.choice(["\n", " ", "\n\n"]).join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(docs, [tuple(r) for r in ld.dedup_lines(frame).collect()])


def test_clashing_names(spark):
    long = "word " * 30 + "end."
    names = ["seeds", "runs", "lines", "covered", "row", "key", "__key", "places"]
    docs = [(i, long, *[f"{n} {i}" for n in names]) for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    rows = ld.dedup_lines(frame)
    assert rows.columns == [*frame.columns, "removed_lines"]
    assert sorted(map(tuple, rows.collect())) == [(*d[:1], d[1] if d[0] == 0 else "", *d[2:], int(d[0] > 0)) for d in docs]


def test_edges(spark):
    long = "word " * 30 + "end.\n"
    docs = [(None, long, 1, 2), (1, None, 1, 2), (2, "", 1, 2), (3, long, 1, 2), (3, long, 1, 2), (4, long.upper() + "own line", 1, 2), (5, "\n\n\n", 1, 2), (6, long * 3, 1, 2), (7, "Short. Short. Short.", 1, 2), (7, "other", 1, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, removed_lines int, id int")
    got = sorted(((r.doc_id, r.text, r.removed_lines) for r in ld.dedup_lines(frame).collect()), key=str)
    want = [(None, long, 0), (1, None, 0), (2, "", 0), (3, "", 1), (3, "", 1), (4, "own line", 1), (5, "\n\n\n", 0), (6, "", 3), (7, "Short. Short. Short.", 0), (7, "other", 0)]
    assert got == sorted(want, key=str)
    assert ld.dedup_lines(frame.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op1_line_dedup(spark, sf)
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    check(docs, [(r.doc_id, r.text, r.removed_lines) for r in rows.collect()])


def test_lines_make_up_the_text(spark):
    texts = ["x\x01. y\n\nz", "a. b! c? d\n\ne", " x. ", "\n", ".. a", "é. ü\r\nz"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", ld.lines_of(F.col("text")).alias("lines")).collect()
    assert all(r.text == "".join(r.lines) and r.lines == lines(r.text) for r in got)


def test_blank_lines_part_nothing(spark):
    rng = random.Random(7)
    said = [sentence(rng, 6) for _ in range(12)]
    whole = "\r\n\r\n".join(said)
    apart = "\n \n".join(said)
    docs = [(1, whole), (2, whole), (3, apart), (4, "Own words.\n\t\n" + apart + "\n \nOther words."), (5, "\r\n\r\n \n")]
    rows = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.text, r.removed_lines) for r in rows}
    assert got == {1: (whole, 0), 2: ("", 23), 3: ("", 23), 4: ("Own words.\n\t\n \nOther words.", 23), 5: (docs[4][1], 0)}


def test_two_lines_and_ends_in_other_contexts(spark):
    rng = random.Random(8)

    def words(n, k=5):
        return " ".join("".join(rng.choices("abcdefghij", k=k)) for _ in range(n)).capitalize() + "."

    docs, want = [], {}
    for i in range(40):  # two lines of 13 words, with other lines around them each time
        pair = [words(13), words(13)]
        own = [[words(4) for _ in range(4)] for _ in range(2)]
        docs += [(2 * i, "\n".join([*own[0][:2], *pair, *own[0][2:]])), (2 * i + 1, "\n".join([*own[1][:2], *pair, *own[1][2:]]))]
        want[2 * i], want[2 * i + 1] = docs[-2][1], "\n".join(own[1])
    for i in range(100, 400, 10):  # a pair that stood elsewhere first, within a passage of 27 words that two more share
        passage = [words(6), *[words(7), words(8)], words(6)]
        own = [words(4) for _ in range(6)]
        docs += [(i, "\n".join([own[0], *passage[1:3], own[1]])), (i + 1, "\n".join([own[2], *passage, own[3]])), (i + 2, "\n".join([own[4], *passage, own[5]]))]
        want |= {docs[-3][0]: docs[-3][1], docs[-2][0]: docs[-2][1], docs[-1][0]: own[4] + "\n" + own[5]}
    short = words(25, 2)  # enough words in few characters
    docs += [(500, f"{words(3)}\n{short}\n{words(3)}"), (501, f"A.\n{short}\nB.")]
    want |= {500: docs[-2][1], 501: "A.\nB."}
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_unique_lines_beside_a_run_stay(spark):
    rng = random.Random(9)
    run = "\n".join(sentence(rng, 14) for _ in range(3))
    bits = F.xxhash64(F.lower(F.col("line"))).bitwiseAND(F.lit(0xFFFF))
    lines = spark.range(400_000).select(F.concat(F.lit("Own line "), F.col("id").cast("string"), F.lit(".")).alias("line"))
    first = "The line beside."
    like = lines.where(bits == spark.createDataFrame([(first,)], "line string").select(bits).first()[0]).first().line
    none = lines.where(bits == 0).first().line
    docs = [(1, f"{first}\n{run}"), (2, f"{like}\n{run}\nEnd."), (3, f"{none}\n{run}\n{none}")]
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: f"{like}\nEnd.", 3: f"{none}\n{none}"}
