"""Personal data by patterns, checksums and context, in DataFrame functions alone.

Regular expressions propose spans; Luhn, mod-97, range and shape checks confirm them; words nearby move their scores, and
a span of an added kind stays if its score reaches KEEP, so that a long code is a secret where words say so. A text is cut
at a kind's matches, so the lengths of the cuts give the matches' places. No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of ties, the four base kinds first.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
#: Each pattern takes what its base pattern takes leftmost and without overlap, in linear time: quantifiers don't give
#: back, and a match may begin only where a run of its first characters does, or where the match before it ended. Of
#: digit runs only those with the 12 to 19 digits of a card are taken.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
#: A character without which a text has no match, where there is one.
NEEDS = {"email": "@", "phone": "+"}
#: Score of a confirmed span, what a word of CONTEXT (in lower case) within NEAR characters before it adds, and the score
#: from which a span of an added kind stays.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.3}
BOOST = {"email": 0.1, "ip": 0.1, "card": 0.1, "phone": 0.1, "iban": 0.1, "secret": 0.5}
NEAR, KEEP = 40, 0.5
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "secret": "token|secret|passw|credential|bearer|auth|api.?key|access.?key|private.?key",
}
#: Matches whose places are added up in one go.
_BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's check."""
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether ``value`` passes the mod-97 check of account numbers."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i + 1, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(0), F.length(moved) - 1), F.lit(0), add) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    if kind == "secret":  # no word: letters and digits, and many different ones
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    return F.lit(True)


def _placed(kind: str, cuts: Column, found: Column) -> Column:
    """Confirmed matches with their places; ``cuts`` are the texts before, between and after the matches ``found``.

    Places are added up block by block and then within each block, so that a text of very many matches stays cheap.
    """
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, value: STRING, before: STRING>>)")
    n = F.size(found)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))

    def width(upto: Column, length: Column) -> Column:
        both = F.zip_with(F.slice(cuts, upto + 1, length), F.slice(found, upto + 1, length), lambda a, b: F.length(a) + F.length(b))
        return F.aggregate(both, F.lit(0), lambda total, x: total + x)

    def begin(starts: Column, b: Column) -> Column:
        return F.concat(starts, F.array(F.element_at(starts, -1) + width(b * _BLOCK, F.lit(_BLOCK))))

    starts = F.aggregate(blocks, F.array(F.lit(0)), begin)

    def block(b: Column) -> Column:
        pairs = F.arrays_zip(F.slice(cuts, b * _BLOCK + 1, F.least(F.lit(_BLOCK), n - b * _BLOCK)).alias("cut"), F.slice(found, b * _BLOCK + 1, F.lit(_BLOCK)).alias("value"))

        def add(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["cut"])
            end = start + F.length(pair["value"])
            span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"), F.right(pair["cut"], F.lit(NEAR)).alias("before"))
            kept = F.when(_confirmed(kind, pair["value"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
            return F.struct(end.alias("at"), kept.alias("spans"))

        first = F.struct(F.element_at(starts, b + 1).alias("at"), none.alias("spans"))
        return F.aggregate(pairs, first, add)["spans"]

    return F.when(n > 0, F.flatten(F.transform(blocks, block))).otherwise(none)


def with_personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array ``into`` of (kind, start, end, value, score), by start and then by kind.

    Starts and ends count code points, ends are exclusive. Every whole text is searched; a null or empty text has an
    empty array. Spans of different kinds may overlap. A column named ``into`` is replaced; others and repeated rows
    stay. Base kinds are kept whatever their score, those of an added kind from a score of KEEP on: an account number has it
    by its checksum, a secret by a word nearby.
    """
    # columns get numbers for a while, so that no name of theirs meets one in use here
    number = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    whole = "__pii_text"
    out = docs.toDF(*number.values()).withColumn(whole, F.coalesce(F.col(number[text]), F.lit("")))
    present = {k: F.contains(F.col(whole), F.lit(NEEDS[k])) if k in NEEDS else F.lit(True) for k in KINDS}
    out = out.withColumns({f"__pii_{k}_found": F.when(present[k], F.regexp_extract_all(F.col(whole), F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS})
    some = {k: F.size(F.col(f"__pii_{k}_found")) > 0 for k in KINDS}
    out = out.withColumns({f"__pii_{k}_cuts": F.when(some[k], F.split(F.col(whole), PATTERNS[k], -1)) for k in KINDS})
    out = out.withColumns({f"__pii_{k}": F.when(some[k], _placed(k, F.col(f"__pii_{k}_cuts"), F.col(f"__pii_{k}_found"))) for k in KINDS})

    def scored(order: int, kind: str) -> Column:
        def one(s: Column) -> Column:
            near = F.lower(s["before"]).rlike(CONTEXT[kind])
            score = F.lit(SCORES[kind]) + F.when(near, F.lit(BOOST[kind])).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.round(score, 2).alias("score"))

        empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, order: INT, kind: STRING, end: INT, value: STRING, score: DOUBLE>>)")
        return F.coalesce(F.transform(F.col(f"__pii_{kind}"), one), empty)

    found = F.filter(F.concat(*[scored(i, k) for i, k in enumerate(KINDS)]), lambda s: (s["order"] < len(BASE)) | (s["score"] >= KEEP))
    spans = F.array_sort(found)
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))
    kept = {c: F.col(n) for c, n in number.items()} | {into: spans}
    return out.select(*[v.alias(c) for c, v in kept.items()])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span's value replaced by its kind in angle brackets, spans being by start.

    A span that begins inside one before it is covered by that one's mark, which then reaches to the farther end. A null
    text or null spans give null, no spans the text.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        mark = F.concat(F.lit("<"), s["kind"], F.lit(">"))
        between = F.substring(text, state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        grown = F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], between, mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), grown.alias("out"))

    done = F.aggregate(spans, start, add)
    return F.concat(done["out"], F.substr(text, done["at"] + 1))
