"""Personal data against Python's regular expressions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from bytebasin.llm import pii
from bytebasin.llm.queries import op8_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def expected(text):
    spans = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(spans)]


TEXTS = [
    None, "", "a@b.c", "a@b.c_d@e.f", "x" * 3000 + "@", "a@b..c a@b.c. a.b+c%d-e@f-g.h.i", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.256 0255.00.0.1 1.2.3", "1.1.1.1.", "999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111 1111  1111 1111", "4111111111111111", "41111111111111112222222222222222", "a4111111111111111b 5500-0000-0000-0004", "é 😀 4111111111111111 a@b.co 😀 +1 (017) 555-7713",
    "+1 (017) 555-7713 +44 20 7946 0958", "+1+1 222 333 444+5", "+1  2", "+12", "+1 (((((2", "+123456789012345678", "+1.2.3.4.5.6.7.8.9", "1 " * 3000, "+1 " * 500, "1-2-3-4-5-6-7-8-9-0-1-2 1", "DE89 3704 0044 0532 0130 00", "iban GB82WEST12345698765432, GB82WEST12345698765433",
    "call a@b.c 4111111111111111 1.2.3.4", "\n1.2.3.4\t5\n", "a@b.c\x0bx", "12 3456789012345678 90", "٣@b.c ١.٢.٣.٤",
]


def test_against_python(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.with_personal_data(docs.withColumn("pii", F.lit(1)).withColumn("kind", F.lit("k")))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    got = {r.doc_id: r for r in found.select("doc_id", pii.joined(base).alias("base"), "pii", "kind").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].base == ",".join(expected(t)), t
        assert all(t[s.start : s.end] == s.value for s in got[i].pii)


def test_account_numbers_and_context(spark):
    docs = spark.createDataFrame([(t,) for t in ("DE89 3704 0044 0532 0130 00 x", "my iban: GB82WEST12345698765432.", "GB82WEST12345698765433", "card 4111111111111111")], "text string")
    got = [[(s.kind, s.value, s.score) for s in r.pii] for r in pii.with_personal_data(docs).collect()]
    assert got[0][-1] == ("iban", "DE89 3704 0044 0532 0130 00", 0.9)
    assert ("iban", "GB82WEST12345698765432", 1.0) in got[1]
    assert got[2] == [] and got[3] == [("card", "4111111111111111", 0.9)]


def test_masked(spark):
    docs = spark.createDataFrame([("to a@b.co or +1 (017) 555-7713.",), ("none",)], "text string")
    out = pii.with_personal_data(docs).select(pii.masked(F.col("text"), F.col("pii")).alias("t")).collect()
    assert [r.t for r in out] == ["to <email> or <phone>.", "none"]


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = expected(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_email == sum(x.startswith("email") for x in want) and r.n_card == sum(x.startswith("card") for x in want)
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = pii.with_personal_data(docs)
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [100_000])
def test_very_long_runs(spark, n):
    texts = ["a" * n, "1" * n, "1 " * n, "+" * n, "+1" + "(" * n, "a@" + "b." * n, "1." * n, "A1" * n]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[(s.kind, s.start, s.end) for s in r.pii] for r in pii.with_personal_data(docs).collect()]
    assert [g for g in got[:5]] == [[]] * 5 and got[5] == [("email", 0, 2 + 2 * n - 1)]
    assert len(got[6]) == n // 4


def test_columns_of_any_name_stay(spark):
    from bytebasin.llm import pii

    row = ("a@b.org", "keep", 7, "old", "__")
    docs = spark.createDataFrame([row, (None, None, None, None, None)], "text string, __pii_text string, __pii_email int, pii string, __0 string")
    got = pii.with_personal_data(docs)
    assert got.columns == docs.columns
    first, second = sorted(got.collect(), key=lambda r: r.text is None)
    assert (first.text, first["__pii_text"], first["__pii_email"], first["__0"]) == ("a@b.org", "keep", 7, "__")
    assert [(s.kind, s.start, s.end) for s in first.pii] == [("email", 0, 7)] and second.pii == []
    again = pii.with_personal_data(docs, text="__pii_text", into="found")
    assert again.columns == [*docs.columns, "found"] and {r.pii for r in again.collect()} == {"old", None}
