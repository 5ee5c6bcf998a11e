"""What several operators of this subpackage share: folders, ordered buckets, Arrow batches, a worker's kept state."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections import Counter
from collections.abc import Callable
from itertools import accumulate
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.sources.shared import shared_root

#: Rows and bytes in one Arrow batch unless the session asks for fewer; texts may be long.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20

T = TypeVar("T")
#: What this worker process keeps from one batch or task to the next: one object, of the operator that ran last.
_KEPT: dict = {}


def kept(key, make: Callable[[], T]) -> T:
    """The worker's object for ``key``, made on first use. Another operator's object is let go first, so a worker that
    goes from stage to stage holds the state of one of them."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on after its task, beside those of other stages."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def limit_arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Lower the session's Arrow batches to ``rows`` and about ``size`` bytes, so that a batch of long texts fits a worker."""
    arrow = "spark.sql.execution.arrow."
    for key, most in ((f"{arrow}maxRecordsPerBatch", rows), (f"{arrow}maxBytesPerBatch", size), (f"{arrow}maxBytesPerOutputBatch", size)):
        now = (spark.conf.get(key, None) or "-1").removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, under a local temp folder on a local master alone."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``shared_folder`` named, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoints(spark: SparkSession) -> None:
    """``checkpoint()`` writes to ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(spark))


def ordered_ranges(df: DataFrame, key: str, tie: str, buckets: int, into: str = "range") -> tuple[DataFrame, int]:
    """``df`` with ``into``, 0 .. n - 1, rising with (``key``, ``tie``), null keys last; and n, about ``buckets``.

    Ranges of about equal numbers of rows: where one key takes the place of several ranges, its rows are dealt by
    ``tie``, a 64-bit hash, and so are rows without a key. The driver holds a number or two for each range; a row finds
    its range by a binary search in the JVM.
    """
    from pyspark.ml.feature import Bucketizer

    counts = df.agg(F.count("*").alias("rows"), F.count(key).alias("keyed")).first()
    probes = [i / buckets for i in range(1, buckets)]
    found = df.where(F.col(key).isNotNull()).approxQuantile(key, probes, 0.25 / buckets) if probes and counts["keyed"] else []
    times = Counter(found)
    cuts = sorted(times)
    # ranges that begin at each cut; keys beyond 53 bits may look alike as cuts, so they get one
    widths = [1, *[times[c] if abs(c) < 1 << 53 else 1 for c in cuts]]
    nulls = counts["rows"] - counts["keyed"]
    widths.append(max(1, round(buckets * nulls / max(1, counts["rows"]))))
    begins = [0, *accumulate(widths)]
    cell = "__cell"
    rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__key", outputCol=cell, handleInvalid="keep").transform(df.withColumn("__key", F.col(key).cast("double"))) if cuts else df.withColumns({"__key": F.col(key), cell: F.lit(0.0)})
    at = F.when(F.col(key).isNull(), F.lit(len(widths) - 1)).otherwise(F.col(cell).cast("int"))
    rows = rows.withColumn(cell, at)

    def of(numbers: list) -> Column:
        return F.get(F.lit(numbers), F.col(cell))

    width = of(widths)
    same = F.col(key).isNull() | (F.col("__key").cast("double") == of([math.nan, *cuts, math.nan]))
    place = F.when(same, F.floor((F.shiftright(tie, 33) + (1 << 30)) * width / (1 << 31))).otherwise(width - 1)
    return rows.withColumn(into, (of(begins[:-1]) + F.when(width > 1, place).otherwise(0)).cast("int")).drop("__key", cell), begins[-1]


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row.

    They come out of a generator, through which the optimiser moves no expression: a later step that names such a column
    several times, or filters by it, reads its value and does not compute it again.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(*columns))

