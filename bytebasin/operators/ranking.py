"""Global ranks, running sums, seeded orders, limits, shards and workers, without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytebasin.sources.shared import checkpointed

#: ``monotonically_increasing_id`` has the partition in the bits from here on, the row's place below.
_PLACE_BITS = 33


def seeded(key: Column, seed: int | str) -> Column:
    """A sort key that shuffles by seed alike on every engine; the key itself breaks ties."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows dealt by ranges of an order and sorted, with ``__part`` and ``__place`` within it; checkpointed, so that a
    lost executor can't renumber them. One shuffle."""
    rows = df.repartitionByRange(_partitions(df), *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    place = F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return checkpointed(rows.withColumns({"__part": F.shiftright("__id", _PLACE_BITS), "__place": place}).drop("__id"))


def global_rank(df: DataFrame, *order: Column | str, into: str = "rank") -> DataFrame:
    """Rows numbered from 0 in a total order.

    Rows are dealt by ranges of the order and numbered where they lie; the numbers of rows in the ranges, one for each
    partition, are summed up on the driver and sent back. The rows themselves are shuffled once and checkpointed, so
    give it narrow ones: rank keys, and join what is large by key.
    """
    dealt = _dealt(df, *order)
    counts = sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect())
    starts = accumulate([0, *[n for _, n in counts]])
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "__part long, __start long")
    ranked = dealt.join(F.broadcast(offsets), "__part")  # a row for each partition
    return ranked.withColumn(into, F.col("__place") + F.col("__start")).drop("__part", "__place", "__start")


def running_sums(df: DataFrame, order: list[Column | str], *columns: str) -> DataFrame:
    """``df`` with ``sum_<column>`` for each of ``columns``: the sum over all rows up to this one in a total order.

    Sums run within ranges of the order; the ranges' totals, a row for each partition, are added on the driver.
    """
    dealt = _dealt(df, *order)
    found = sorted(dealt.groupBy("__part").agg(*[F.sum(c).alias(c) for c in columns]).collect(), key=lambda r: r["__part"])
    before, rows = [0.0] * len(columns), []
    for r in found:
        rows.append((r["__part"], *map(float, before)))
        before = [b + (r[c] or 0) for b, c in zip(before, columns)]
    offsets = df.sparkSession.createDataFrame(rows, "__part long" + "".join(f", `__before_{c}` double" for c in columns))
    within = Window.partitionBy("__part").orderBy("__place")
    out = dealt.join(F.broadcast(offsets), "__part")
    out = out.withColumns({f"sum_{c}": F.sum(c).over(within) + F.col(f"__before_{c}") for c in columns})
    return out.drop("__part", "__place", *[f"__before_{c}" for c in columns])


def shards_by_count(df: DataFrame, per_shard: int, *order: Column | str) -> DataFrame:
    """``idx``, the row's rank, and ``shard``, a new one every ``per_shard`` rows."""
    if per_shard <= 0:
        raise ValueError("rows per shard must be positive")
    return global_rank(df, *order, into="idx").withColumn("shard", F.floor(F.col("idx") / per_shard).cast("long"))


def shards_by_bytes(df: DataFrame, budget: int, size: str = "size", page: int = 4096) -> DataFrame:
    """``shard`` by next fit over ``idx``: a new one opens when the padded bytes would pass ``budget``.

    A blob larger than the budget closes a shard that has rows and gets its own; the first blob opens none. Next fit is
    a fold over all rows, done in parallel: only (idx, size) are dealt by ranges of ``idx``, and each range tells, for
    every way in which it may be entered, how many shards it opens and how full it leaves the last one. Ways that end
    alike are told once. The driver goes through these from range to range, and each range then numbers its own rows.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    import numpy as np
    import pandas as pd

    narrow = _dealt(df.select("idx", F.col(size).alias("size")), "idx")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each range's rows together: two numbers a row."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            for part, rows in batch.groupby("part", sort=False):
                if held and held[0]["part"].iloc[0] != part:
                    yield pd.concat(held)
                    held = []
                held.append(rows)
        if held:
            yield pd.concat(held)

    def filled(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Padded bytes before each row and after the last; for each row the row that opens the next shard if it opens one."""
        upto = np.concatenate([[0], np.cumsum(-(-rows["size"].to_numpy("i8") // page) * page)])
        following = np.maximum(np.searchsorted(upto[1:], upto[:-1] + budget, "right"), np.arange(1, len(upto)))
        return upto, following

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole(batches):
            upto, following = filled(rows)
            n = len(rows)
            opened, left = [0] * (n + 1), [0] * (n + 1)
            for i in range(n - 1, -1, -1):
                j = int(following[i])
                opened[i], left[i] = (opened[j] + 1, left[j]) if j < n else (1, int(upto[n] - upto[i]))
            first = int(np.searchsorted(upto[1:], budget, "right"))  # no later row can be the first to open a shard
            out = pd.DataFrame({"reach": upto[1 : first + 2][:n], "opened": opened[: first + 1][:n], "left": left[: first + 1][:n]})
            changed = (out[["opened", "left"]] != out[["opened", "left"]].shift(-1)).any(axis=1)
            yield out[changed].assign(part=rows["part"].iloc[0], total=upto[n], fresh_opened=opened[0] - 1, fresh_left=left[0])

    dealt = narrow.select("idx", "size", F.col("__part").alias("part"))
    found = dealt.mapInPandas(ways, "reach long, opened long, left long, part long, total long, fresh_opened long, fresh_left long")
    entries: dict[int, tuple[int, int]] = {}  # bytes held, -1 before any row; the shard that is open
    held, shard, part, done = -1, 0, None, True
    for r in checkpointed(found).orderBy("part", "reach").toLocalIterator():
        if r["part"] != part:
            held = held if done else held + total
            part, total, done, entry = r["part"], r["total"], False, held
            entries[part] = (held, shard)
            if entry < 0:
                held, shard, done = r["fresh_left"], shard + r["fresh_opened"], True
        if not done and r["reach"] + entry > budget:
            held, shard, done = r["left"], shard + r["opened"], True

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole(batches):
            upto, following = filled(rows)
            held, shard = entries[int(rows["part"].iloc[0])]
            at = int(following[0]) if held < 0 else int(np.searchsorted(upto[1:], budget - held, "right"))
            opens = []
            while at < len(rows):
                opens.append(at)
                at = int(following[at])
            local = np.searchsorted(np.array(opens, "i8"), np.arange(len(rows)), "right")
            yield pd.DataFrame({"idx": rows["idx"], "shard": shard + local})

    return df.join(dealt.mapInPandas(number, "idx long, shard long"), "idx")


def shard_prefix(shards: DataFrame, least: int) -> int:
    """The shard up to which the first shards hold ``least`` rows; an error if all of them don't."""
    counts = shards.groupBy("shard").agg(F.count("*").alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("shard")))  # a row a shard
    found = running.where(F.col("upto") >= least).agg(F.min("shard")).first()[0]
    if found is None:
        raise ValueError(f"fewer than {least} rows in all shards")
    return found


def worker_of(shard: Column, workers: int) -> Column:
    """Shards dealt to workers in turn."""
    return shard % workers


def chunk_of(shards: DataFrame, workers: int) -> DataFrame:
    """Shards dealt to workers in near-equal runs, the first ones having one more."""
    n = shards.count()
    if n < workers:
        raise ValueError("fewer shards than workers")
    return shards.withColumn("worker", F.ntile(workers).over(Window.orderBy("shard")) - 1)  # a row a shard


def seeded_sample(df: DataFrame, key: str, k: int, seed: int | str) -> DataFrame:
    """``k`` rows without replacement, those of least seeded key."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(k)
