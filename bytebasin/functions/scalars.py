"""Column functions: sanitising, padding, bytes, softmax, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row, however often later steps name it: they come out of a
    generator, through which the optimiser moves no expression."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(*columns))


def starts_with_magic(data: Column, magics: tuple[bytes, ...]) -> Column:
    """Whether a blob begins with any of the given byte strings."""
    found = F.lit(False)
    for m in magics:
        found |= F.substring(data, 1, len(m)) == F.lit(m)
    return found


def clean_name(name: Column) -> Column:
    """Base name up to its first dot; null unless it is 64 hexadecimal digits."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    stem = F.regexp_extract(base, r"^([^.]*)", 1)
    return F.when(stem.rlike("^[0-9a-fA-F]{64}$"), stem)


def clean_timestamp(ts: Column, cutoff: int) -> Column:
    """The timestamp if it lies in [0, cutoff], else -1."""
    return F.when(ts.between(0, cutoff), ts).otherwise(F.lit(-1).cast("long"))


def round_up(x: Column, to: int) -> Column:
    """The least multiple of ``to`` that is not below ``x``."""
    return (F.floor((x + to - 1) / to) * to).cast("long")


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    """Probability of the second of two logits."""
    most = F.greatest(logit0, logit1)
    return F.exp(logit1 - most) / (F.exp(logit0 - most) + F.exp(logit1 - most))


def little_endian(data: Column, offset: Column | int, width: int) -> Column:
    """The unsigned number of ``width`` bytes at an offset, null beyond the end; 64-bit numbers wrap."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(data, (offset + 1).cast("int"), F.lit(width))
    pairs = F.concat(*[F.substring(F.hex(part), 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.length(part) == width, F.conv(pairs, 16, 10).cast("decimal(20,0)").cast("long"))


def patch_size(length: Column, size: int | None = None, count: int | None = None) -> tuple[Column, Column]:
    """(size, count) of the patches of a sequence, from exactly one of them."""
    if (size is None) == (count is None):
        raise ValueError("give the size or the count of patches, not both")
    if size is not None:
        return F.lit(size).cast("long"), F.ceil(length / size)
    return F.ceil(length / count), F.lit(count).cast("long")


def pad_length(most: Column, least: int = 0, multiple: int = 1, bins: tuple[int, ...] | None = None) -> Column:
    """Length to pad a batch to: ``most`` or ``least``, rounded up to a multiple, or the least bin that holds both."""
    if least < 0 or multiple <= 0 or (bins is not None and not bins):
        raise ValueError("least must not be negative, multiple must be positive, bins must not be empty")
    wanted = F.greatest(most.cast("long"), F.lit(least).cast("long"))
    if bins:
        fits = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in bins]), lambda b: b >= wanted))
        return F.coalesce(fits, F.raise_error(F.lit("no bin is long enough")).cast("long"))
    return round_up(wanted, multiple)
