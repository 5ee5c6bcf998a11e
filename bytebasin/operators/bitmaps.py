"""Flags as masks and positions as bitmaps, the lowest bit first.

A bitmap is rows of bytes (keys, byte, bits). What is shuffled are words of 64 positions (keys, word, bits, known), put
together before the shuffle; ``known`` has the positions that there are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def mask_of(flags: list[Column]) -> Column:
    """Up to 64 flags as one number, flag k at bit k; the 64th is the sign."""
    if len(flags) > 64:
        raise ValueError("64 flags at most")
    bits = [F.shiftleft(F.coalesce(f, F.lit(False)).cast("long"), k) for k, f in enumerate(flags)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))


def explode_mask(df: DataFrame, mask: str, width: int) -> DataFrame:
    """A row for every set bit: ``bit``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.getbit(F.col(mask), k) == 1)
    return df.withColumn("bit", F.explode(bits))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _up(bits: Column, by: Column) -> Column:
    """Bits moved to higher places; none are left from 64 on."""
    return F.when(by < 64, F.call_function("shiftleft", bits, by.cast("int"))).otherwise(F.lit(0).cast("long"))


def _down(bits: Column, by: Column) -> Column:
    return F.when(by < 64, F.call_function("shiftrightunsigned", bits, by.cast("int"))).otherwise(F.lit(0).cast("long"))


def words_of(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, bits, known) of rows (keys, pos, value): a word's rows are one before the shuffle already."""
    known = _bit(F.col("pos") % 64)
    bits = F.when(F.col("value"), known).otherwise(F.lit(0).cast("long"))
    rows = positions.select(*keys, F.floor(F.col("pos") / 64).alias("word"), bits.alias("bits"), known.alias("known"))
    return _joined(rows, keys)


def _joined(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known"))


def words_of_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, bits) of half-open ranges (keys, start, end): a row for each word that a range touches."""
    rows = ranges.where("end > start").select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("word"))
    low, high = F.greatest(F.lit(0), F.col("start") - F.col("word") * 64), F.least(F.lit(64), F.col("end") - F.col("word") * 64)
    every = F.lit(-1).cast("long")
    return rows.select(*keys, "word", _up(every, low).bitwiseAND(_down(every, 64 - high)).alias("bits"))


def bytes_of(words: DataFrame, *columns: str) -> DataFrame:
    """(columns, byte, bits) of words: the bytes that hold a known position."""
    rows = words.select(*columns, "word", "bits", "known", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("__i"))
    part = lambda c: F.call_function("shiftrightunsigned", F.col(c), F.col("__i") * 8).bitwiseAND(F.lit(255).cast("long"))
    rows = rows.withColumn("__known", part("known")).where("__known <> 0")
    return rows.select(*columns, (F.col("word") * 8 + F.col("__i")).alias("byte"), part("bits").alias("bits"))


def words_of_bytes(bitmap: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, bits, known) of a bitmap; every position of a byte that is there is known."""
    place = (F.col("byte") % 8 * 8).cast("int")
    up = lambda c: F.call_function("shiftleft", c.cast("long"), place)
    return _joined(bitmap.select(*keys, F.floor(F.col("byte") / 8).alias("word"), up(F.col("bits")).alias("bits"), up(F.lit(255)).alias("known")), keys)


def pack(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, byte, bits) of rows (keys, pos, value): eight positions a byte, what is missing being 0."""
    return bytes_of(words_of(positions, keys), *keys)


def unpack(bitmap: DataFrame, count: str | None = None) -> DataFrame:
    """(..., pos, value) of a bitmap's rows; positions from ``count`` on are left out."""
    rows = bitmap.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = rows.withColumns({"pos": F.col("byte") * 8 + F.col("bit"), "value": F.getbit("bits", F.col("bit")) == 1})
    return (rows.where(F.col("pos") < F.col(count)) if count else rows).drop("bit", "byte", "bits")


@F.pandas_udf(LongType())
def _gathered(bits: pd.Series, mask: pd.Series) -> pd.Series:
    """The bits of a word under a mask, moved together."""
    b, m = (x.to_numpy("i8").view("u8") for x in (bits, mask))
    out, place = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
    for k in range(64):
        taken = (m >> np.uint64(k)) & np.uint64(1)
        out |= ((b >> np.uint64(k)) & taken) << np.minimum(place, np.uint64(63))
        place += taken
    return pd.Series(out.view("i8"))


def _laid(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """The bitmap of pieces (keys, to, n, bits), each the n lowest bits of a word that go to position ``to`` on: a piece
    lies in one word or two."""
    known = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - F.col("n")).cast("int"))
    shift = F.col("to") % 64
    word = F.floor(F.col("to") / 64)
    both = F.array(
        F.struct(word.alias("word"), _up(F.col("bits"), shift).alias("bits"), _up(known, shift).alias("known")),
        F.struct((word + 1).alias("word"), _down(F.col("bits"), 64 - shift).alias("bits"), _down(known, 64 - shift).alias("known")),
    )
    rows = pieces.where("n > 0").select(*keys, F.inline(both)).where("known <> 0")
    return bytes_of(_joined(rows, keys), *keys)


def select(bitmap: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The bits of a bitmap at chosen positions (keys, pos), moved together and packed again.

    Word by word: a running count of the chosen bits tells where those of a word go.
    """
    mask = words_of(chosen.select(*keys, "pos", F.lit(True).alias("value")), keys).select(*keys, "word", F.col("bits").alias("mask"))
    met = words_of_bytes(bitmap, keys).join(mask, [*keys, "word"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("known")))
    n = F.bit_count("mask").cast("long")
    before = Window.partitionBy(*keys).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    placed = met.withColumn("n", n).withColumn("to", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    return _laid(placed.select(*keys, "to", "n", _gathered("bits", "mask").alias("bits")), keys)


def select_ranges(bitmap: DataFrame, ranges: DataFrame, keys: list[str], order: str = "start") -> DataFrame:
    """The bits of a bitmap in half-open ranges (keys, start, end), one range after another in ``order``, packed again.

    Ranges are cut to the bitmap; they may overlap. A range is read by whole words, shifted to where it goes: the ranges
    before it tell by their lengths where that is.
    """
    words = words_of_bytes(bitmap, keys)
    ends = words.groupBy(*keys).agg(F.max(F.struct("word", "known")).alias("last"))
    top = F.col("last.word") * 64 + 64 - F.length(F.regexp_extract(F.lpad(F.bin("last.known"), 64, "0"), "^0*", 0))
    cut = ranges.where("start >= 0").join(ends.select(*keys, top.alias("__top")), keys)
    cut = cut.withColumn("end", F.least("end", "__top")).where("end > start")
    before = Window.partitionBy(*keys).orderBy(order, "start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("to", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0).cast("long")))
    touched = cut.select(*keys, "start", "end", "to", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("word"))
    met = touched.join(words.select(*keys, "word", "bits"), [*keys, "word"], "left")
    first, last = F.greatest("start", F.col("word") * 64), F.least("end", F.col("word") * 64 + 64)
    n = last - first
    lowest = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - n).cast("int"))
    bits = _down(F.coalesce("bits", F.lit(0).cast("long")), first - F.col("word") * 64).bitwiseAND(lowest)
    return _laid(met.select(*keys, (F.col("to") + first - F.col("start")).alias("to"), n.alias("n"), bits.alias("bits")), keys)


def trim(bitmap: DataFrame, length: int) -> DataFrame:
    """The bytes that ``length`` positions need."""
    return bitmap.where(F.col("byte") < F.ceil(F.lit(length) / 8))
