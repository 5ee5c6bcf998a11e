"""Removal of later repeated runs of lines, in DataFrame functions alone.

Winnowing over line hashes. From every line a window reaches forward until it holds ``min_words`` words, or a few lines,
and the least line hash in it is selected as a fingerprint. Stretches of lines that agree in that many words hold a
window in common, and so select the same line of it: no repetition is without a fingerprint. Fingerprints that occur once go; around the
others matches are extended both ways, by windows that grow to the right line by line. Each window is met with its first
occurrence among all documents, whichever that is for it, so a match is followed to its very ends in every earlier
document that has it; what later occurrences cover is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import drop_folder, ensure_checkpoints, shared_folder, staged

#: A line ends after its line breaks, or where a sentence ends and a space follows; it keeps what ends it.
LINE_END = r"(?<=\n)(?!\n)|(?<=[.!?] )(?!\n)"
#: A character that marks line ends for a while; a text that has it is cut by the pattern instead.
_MARK = "\x01"
#: Words from which a repeated stretch of lines is deleted.
MIN_WORDS = 25
#: Lines of a window of winnowing at most.
WINDOW = 4
#: Bytes from which a line is selected before shorter ones.
LONG_LINE = 24
#: Lines whose words are added up in one go.
_BLOCK = 64


def lines_of(text: Column) -> Column:
    """Lines of a text; joined, they are the text. A null or empty text has none."""
    return F.when(F.length(text) > 0, F.filter(_parts(text), lambda x: x != "")).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def _parts(text: Column) -> Column:
    """Lines of a text, and an empty one where it ends in one."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    marked = F.replace(marked, F.lit(_MARK + "\n"), F.lit("\n"))
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, LINE_END, -1)).otherwise(F.split(marked, _MARK, -1))


def plain(line: Column) -> Column:
    """What a line is compared by: no case, no outer white space; empty for a blank line."""
    return F.lower(F.btrim(line, F.lit(" \t\r\n")))


def line_hash(line: Column) -> Column:
    """64-bit hash of a plain line. Long lines have those below 0, so that windows select them first: short ones are what
    texts have in common by chance."""
    hash = F.xxhash64(line)
    low = F.lit(-(2**63)).cast("long")
    return F.when(F.octet_length(line) >= LONG_LINE, hash.bitwiseOR(low)).otherwise(hash.bitwiseAND(F.lit(2**63 - 1).cast("long")))


def words_in(line: Column) -> Column:
    """Words of a plain line that is not blank: one more than the spaces within it."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _key(doc_id: str, text: str) -> Column:
    return F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("of"))


def _with_sums(df: DataFrame) -> DataFrame:
    """``df`` with ``upto``: words before each line, and in the end all words. Sums run within blocks of lines first, so
    that long texts stay cheap."""

    def block(b: Column) -> Column:
        return F.slice("words", b * _BLOCK + 1, F.lit(_BLOCK))

    blocks = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / _BLOCK).cast("int"))
    out = staged(df, totals=F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda total, n: total + n)))
    out = staged(out, before=F.aggregate("totals", F.array(F.lit(0)), lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n)))

    def sums(b: Column) -> Column:
        return F.aggregate(block(b), F.array(F.get("before", b)), lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))

    # each block's last sum is the next one's first
    parts = F.flatten(F.transform(blocks, lambda b: F.slice(sums(b), F.lit(1), F.size(block(b)))))
    return staged(out, upto=F.concat(parts, F.array(F.element_at("before", -1)))).drop("totals", "before")


def _selected(begin: Column, start: Column, min_words: int) -> Column:
    """The line that the window from ``start`` on, at word ``begin``, selects: the first of least hash; null where the
    text is too short.

    A window has ``min_words`` words or ``WINDOW`` lines, whichever takes fewer lines.
    """
    length = F.lit(WINDOW)
    for n in reversed(range(1, WINDOW)):
        length = F.when(F.get("upto", start + n) >= begin + min_words, n).otherwise(length)
    window = F.slice("hashes", start + 1, length)
    least = (start - 1 + F.array_position(window, F.array_min(window))).cast("int")
    # fewer lines than a window may have are left: they need the words
    return F.when((start + WINDOW <= F.size("hashes")) | (F.element_at("upto", -1) - begin >= min_words), least)


def _hashed_lines(docs: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """(id, of, hashes, upto, fingerprints) of every document with enough words; lines that are not blank count alone."""
    solid = F.filter(F.transform(_parts(F.col("text")), plain), lambda x: x != "")
    cut = staged(docs.select(_key(doc_id, text).alias("key"), F.col(text).alias("text")), solid=solid)
    cut = cut.where(F.size("solid") > 0).select("key", "solid")
    out = staged(cut, hashes=F.transform("solid", line_hash), words=F.transform("solid", words_in)).drop("solid")
    out = _with_sums(out).where(F.element_at("upto", -1) >= min_words)
    selected = F.transform("upto", lambda begin, i: _selected(begin, i, min_words))
    return staged(out, fingerprints=F.array_compact(F.array_distinct(selected))).select("key.*", "hashes", "words", "upto", "fingerprints")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(window, id, of, start, end) around the fingerprints ``met``.

    From each line whose window may have selected one goes the shortest stretch with enough words, and longer ones for
    as long as they would have too few words without their first line. In a repeated stretch with enough words every
    line is in one of these.
    """

    def reach(start: Column) -> Column:
        return F.get("owner", F.get("upto", start) + (min_words - 1))

    def grown(start: Column) -> Column:
        end = reach(start)
        most = F.coalesce(reach(start + 1), F.size("hashes")) - 1
        return F.when(end.isNotNull(), F.transform(F.sequence(end, F.greatest(end, most)), lambda e: window(start, e))).otherwise(none)

    def window(start: Column, end: Column) -> Column:
        return F.struct(F.xxhash64(F.slice("hashes", start + 1, end - start + 1)).alias("window"), start.alias("start"), end.alias("end"))

    none = F.expr("CAST(array() AS ARRAY<STRUCT<window: BIGINT, start: INT, end: INT>>)")
    starts = F.array_distinct(F.flatten(F.transform("met", lambda at: F.sequence(F.greatest(F.lit(0), at - (WINDOW - 1)), at))))
    placed = staged(lines, owner=F.flatten(F.transform("words", lambda n, i: F.array_repeat(i, n))), starts=starts)
    return placed.select("id", "of", F.inline(F.flatten(F.transform("starts", grown)))).select("window", "id", "of", "start", "end")


def repetitions(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, of, covered): for each document with repeated lines the windows (start, end) that later occurrences cover.

    ``of`` is a hash of the text; places count the lines that are not blank. A window is a later occurrence where the
    same lines stand earlier: in a document of smaller id (a null id is the smallest; of one id, the text of smaller
    hash is earlier), or earlier in the same text. Rows alike in id and text count as one document.

    Only fingerprints are shuffled at first, about two for every five lines; they are counted before the shuffle. Every occurrence is joined with one row for its hash, so a line or a passage that a third of the documents
    share makes no pairs among them, and both sides of each join are plain shuffles that Spark can split. What meets in
    one task is a document's own lines.
    """
    spark = docs.sparkSession
    ensure_checkpoints(spark)
    folder = shared_folder(spark, "line-hashes")
    _hashed_lines(docs, min_words, doc_id, text).write.option("compression", "zstd").parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")

    marks = lines.select("id", "of", F.inline(F.transform("fingerprints", lambda at: F.struct(F.get("hashes", at).alias("mark"), at.alias("at")))))
    again = marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark").checkpoint()
    mine = marks.join(again, "mark").groupBy(F.col("id").alias("m_id"), F.col("of").alias("m_of")).agg(F.collect_set("at").alias("met"))
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("of") == F.col("m_of"))
    met = lines.join(mine, same).select("id", "of", "hashes", "words", "upto", "met")
    _windows(met, min_words).write.option("compression", "zstd").parquet(f"{folder}/windows")

    windows = spark.read.parquet(f"{folder}/windows")
    place = F.struct("id", "of", "start")
    firsts = windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("window", "first").checkpoint()
    later = windows.join(firsts, "window").where(place > F.col("first"))
    covered = later.groupBy("id", "of").agg(F.collect_set(F.struct("start", "end")).alias("covered")).checkpoint()
    drop_folder(spark, folder)  # the checkpoint does not read it
    return covered


def _runs(places: Column, solid: Column) -> Column:
    """Runs of neighbouring places, as first and last places among all lines: blank lines between two of them go too."""
    starts = F.filter(places, lambda x, i: (i == 0) | (x != F.get(places, i - 1) + 1))
    ends = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (x != F.get(places, i + 1) - 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.get(solid, s).alias("start"), F.get(solid, e).alias("end")))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, joined."""

    def begin(i: Column) -> Column:
        return F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["end"] + 1)

    before = F.transform(runs, lambda r, i: F.slice(lines, begin(i) + 1, r["start"] - begin(i)))
    last = F.element_at(runs, -1)["end"]
    rest = F.slice(lines, last + 2, F.greatest(F.lit(0), F.size(lines) - last - 1))
    return F.concat(F.array_join(F.flatten(before), ""), F.array_join(rest, ""))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later repeated lines deleted from ``text``, and ``removed_lines``, how many lines went.

    A line goes exactly when it is in a stretch of lines with ``min_words`` words or more that stands earlier too: in a
    document of smaller id (null ids come first, one id's texts by a hash), or further up in the same text. Lines
    compare by 64-bit hashes without case and outer white space, blank lines count for nothing, and those between two
    lines that go go with them. Rows alike in id and text are one document and fare alike. A document whose text is
    deleted whole stays with an empty text; null and empty texts and those without repetition stay as they are. An
    empty table gives an empty table. Other columns stay, whatever their names; a column ``removed_lines`` is replaced.
    Ids must be whole numbers; any other is an error when rows are read.
    """
    # columns get numbers for a while, so that no name of theirs meets one in use here
    number = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*number.values()).withColumns({"key": _key(number[doc_id], number[text]), "text": F.col(number[text])})
    found = repetitions(docs, min_words, doc_id, text).select(F.struct("id", "of").alias("of_key"), "covered")
    held = rows.join(found, F.col("key").eqNullSafe(F.col("of_key")), "left").drop("key", "of_key")
    held = staged(held, lines=F.when(F.col("covered").isNotNull(), lines_of(F.col("text"))))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("covered", lambda w: F.sequence(w["start"], w["end"])))))
    solid = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: plain(F.get("lines", i)) != "")
    held = staged(held, places=places, solid=F.when(F.col("covered").isNotNull(), solid)).drop("covered")
    held = staged(held, runs=_runs(F.col("places"), F.col("solid"))).drop("places", "solid")
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"] + 1)
    whole = F.coalesce(_kept(F.col("lines"), F.col("runs")), F.col("text"))
    kept = [(whole if c == text else F.col(n)).alias(c) for c, n in number.items() if c != "removed_lines"]
    return held.select(*kept, F.coalesce(gone, F.lit(0).cast("long")).alias("removed_lines"))
