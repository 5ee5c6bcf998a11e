"""Batches of sequences: assignment, padding, token shifts, collation, salted hot keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from bytebasin.functions.scalars import pad_length
from bytebasin.operators.ranking import global_rank

#: Bytes of a token.
TOKEN = 2


def batches(df: DataFrame, per_batch: int, *order: Column | str, drop_last: bool = False) -> DataFrame:
    """``batch`` and ``slot`` by rank; a last batch that is not full goes if ``drop_last``."""
    ranked = global_rank(df, *order)
    out = ranked.withColumns({"batch": F.floor(F.col("rank") / per_batch).cast("long"), "slot": F.col("rank") % per_batch})
    if drop_last:
        full = ranked.count() // per_batch
        out = out.where(F.col("batch") < full)
    return out.drop("rank")


@F.arrow_udf(BinaryType())
def tokens_of(blobs: pa.Array) -> pa.Array:
    """The bytes of a blob as tokens of 16 bits, little-endian: one more than the byte, so that 0 is left for padding.
    A null blob has none. A batch is shifted as it lies, without an object for each blob."""
    whole = blobs.cast(pa.large_binary()).fill_null(b"")
    if not len(whole):
        return pa.array([], pa.binary())
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    held = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    tokens = held.astype("<u2")
    tokens += np.uint16(1)
    return pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer((at - at[0]) * TOKEN), pa.py_buffer(tokens)]).cast(pa.binary())


def token_count(tokens: Column | str) -> Column:
    return F.floor(F.octet_length(tokens) / TOKEN).cast("long")


def padded(tokens: Column | str, length: Column) -> Column:
    """Tokens filled up with zeros on the right."""
    return F.rpad(tokens, (length * TOKEN).cast("int"), F.lit(b"\0"))


def collate(rows: DataFrame, least: int = 0, multiple: int = 1, bins: tuple[int, ...] | None = None, keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """(keys, length, names, lengths, tokens) of rows (keys, slot, name, tokens): every sequence padded to the length of
    its batch. Tokens stay binary, two bytes each. A batch is what meets in one task, by its definition.
    """
    rows = rows.withColumn("n", token_count("tokens"))
    found = rows.groupBy(*keys).agg(F.max("n").alias("most"), F.array_sort(F.collect_list(F.struct("slot", "name", "n", "tokens"))).alias("rows"))
    found = found.withColumn("length", pad_length(F.col("most"), least, multiple, bins))
    return found.select(
        *keys, "length", F.transform("rows", lambda r: r["name"]).alias("names"), F.transform("rows", lambda r: r["n"]).alias("lengths"),
        F.transform("rows", lambda r: padded(r["tokens"], F.col("length"))).alias("tokens"),
    )


def with_empty_structures(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of a single padding token for every (batch, label) of ``keys`` that has none in ``rows``."""
    missing = keys.join(rows.select("batch", "label").distinct(), ["batch", "label"], "left_anti")
    fill = missing.select("batch", "label", F.lit(0).cast("long").alias("slot"), F.lit(-1).cast("long").alias("name"), F.lit(bytes(TOKEN)).alias("tokens"))
    return rows.select("batch", "label", "slot", "name", "tokens").unionByName(fill)


def salt_plan(frequencies: dict[int, float], rows: int, first: int | None = None) -> dict[int, tuple[int, int]]:
    """(base, copies) of each key: copies in proportion to its frequency, a power of two each.

    The budget is ``rows`` less one row for each key, which every key keeps for itself. A key's share of it goes to the
    nearest power of two, a tie going up, 1 at least. While all copies together are more than the budget, keys with more
    than one are halved in turn, in the order of the keys. Copies of keys that have several lie one after another from
    ``first`` on, by default behind the greatest key; a key with one copy is its own base.
    """
    keys, budget = sorted(frequencies), rows - len(frequencies)
    if len(keys) > budget:
        raise ValueError("too few rows for the keys")
    total = sum(frequencies.values()) or 1.0
    copies = {}
    for k in keys:
        share, low = frequencies[k] / total * budget, 1
        while low * 2 <= share:
            low *= 2
        copies[k] = low if share <= 1 or share - low < 2 * low - share else low * 2
    while sum(copies.values()) > budget:
        for k in keys:
            if sum(copies.values()) <= budget:
                break
            copies[k] = max(1, copies[k] // 2)
    plan, base = {}, first if first is not None else max(keys, default=-1) + 1
    for k in keys:
        plan[k] = (base, copies[k]) if copies[k] > 1 else (k, 1)
        base += copies[k] if copies[k] > 1 else 0
    return plan


def salted(tokens: DataFrame, plan: dict[int, tuple[int, int]], stride: int) -> DataFrame:
    """``salted``: base + ((pos + row * stride) & (copies - 1)) of every token with several copies; others stay.

    Only keys with several copies are sent around: fewer than the rows that the plan was made for.
    """
    several = [(k, base, copies) for k, (base, copies) in plan.items() if copies > 1]
    table = tokens.sparkSession.createDataFrame(several, "token long, base long, copies long")
    joined = tokens.join(F.broadcast(table), "token", "left")
    turn = (F.col("pos") + F.col("row") * stride).bitwiseAND(F.col("copies") - 1)
    return joined.withColumn("salted", F.coalesce(F.col("base") + turn, F.col("token").cast("long"))).drop("base", "copies")
