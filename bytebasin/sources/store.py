"""Blobs, manifests, archives and packed data sets: reading and writing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bytebasin.functions.scalars import starts_with_magic
from bytebasin.operators.intervals import point_join
from bytebasin.sources import ranged
from bytebasin.sources.shared import checkpointed

SIZE_SCHEMA = "idx long, name string, shard int, offset long, size long"
META_SCHEMA = "idx long, name string, shard int, timestamp long, malware int, family string"
RUNLOG_SUFFIX = "_gpu_mem"
#: The reason of a row that a user's transform has left out.
SKIPPED = "skipped"
#: Bytes of a row group of stored sets; shards, and keys, that a lookup of many pushes down at most.
ROW_GROUP, FEW_SHARDS, FEW_KEYS = 8 << 20, 1000, 200
#: Sizes of Bloom filters that are tried, each half of the one before, from a megabyte on.
FILTER_SIZES = 16


def read_blobs(spark: SparkSession, folder: str, max_length: int | None = None, pattern: str = "*") -> DataFrame:
    """(path, name, data, size) of every file under a folder; empty files have no row. Of a prefix of ``max_length``
    bytes no more is read, however long the file; whole files must fit a cell."""
    if max_length:
        return ranged.read_prefixes(spark, folder, max_length, pattern).drop("length")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).where("length > 0")
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("content").alias("data"), F.col("length").alias("size"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(sha, label) lines, by sha; a repeated sha is an error when rows are read."""
    rows = spark.read.schema("sha string, label int").option("sep", " ").csv(path)
    counted = rows.groupBy("sha").agg(F.max("label").alias("label"), F.count("*").alias("n"))
    single = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated: "), "sha")).cast("boolean")).otherwise(F.lit(True))
    return counted.where(single).select("sha", "label").orderBy("sha")


def write_index(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws(" ", "sha", F.col("label").cast("int").cast("string")).alias("value")).write.text(path)


def archive_members(spark: SparkSession, folder: str, max_length: int | None = None) -> DataFrame:
    """(archive, name, data, reject_reason) of the members of zip files that are no folders and not empty.

    Members are dealt over tasks, whatever archive they are of, and read one by one. What can't be read is a row with
    its reason and no data: an archive that is none, or a member of one.
    """
    return ranged.members(ranged.archive_index(spark, folder), max_length)


def read_archives(spark: SparkSession, folder: str, magics: tuple[bytes, ...] = (b"MZ",), max_length: int | None = None) -> DataFrame:
    """(archive, name, data) of the members of zip files; ``.pdb``, other magics and what can't be read are left out."""
    index = ranged.archive_index(spark, folder).where(~F.coalesce(F.lower("name").endswith(".pdb"), F.lit(False)))
    found = ranged.members(index, max_length).where("reject_reason IS NULL").drop("reject_reason")
    return found.where(starts_with_magic(F.col("data"), magics))


def packed_ranges(spark: SparkSession, folder: str, read=None) -> DataFrame:
    """Samples of a packed data set with ``reject_reason``: manifest and metadata joined, each blob cut out of its
    shard's container.

    ``size/*.csv`` and ``meta/*.csv`` with a header, containers in ``data/`` ending in the shard's number. Tasks read the
    ranges of their rows; a container that begins with the zstd magic is inflated as a stream. A sample whose container
    is missing or too short has no data and a reason.
    """
    sizes = spark.read.schema(SIZE_SCHEMA).option("header", True).csv(f"{folder}/size")
    meta = spark.read.schema(META_SCHEMA).option("header", True).csv(f"{folder}/meta")
    shard = F.regexp_extract("path", r"(\d+)(?:\.[A-Za-z0-9.]*)?$", 1).cast("int")
    boxes = ranged.read_prefixes(spark, f"{folder}/data", len(ranged.ZSTD)).select(shard.alias("shard"), "path", (F.col("data") == F.lit(ranged.ZSTD)).alias("inflated"))
    boxes = checkpointed(boxes)  # a row a container: their beginnings are read once
    entries = sizes.join(meta, ["idx", "name", "shard"]).join(boxes, "shard", "left")
    found = [ranged.cut(entries.where(F.coalesce("inflated", F.lit(False)) == flag).drop("inflated"), flag, read) for flag in (False, True)]
    rows = found[0].unionByName(found[1])
    label = F.coalesce(F.col("malware") == 1, F.lit(False))
    return rows.select("idx", "name", "shard", "data", label.alias("label"), F.nullif("timestamp", F.lit(-1)).alias("ts"), F.coalesce("family", F.lit("")).alias("family"), "size", "reject_reason")


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of a packed data set; one that can't be read is an error when rows are read."""
    rows = packed_ranges(spark, folder)
    bad = F.raise_error(F.concat(F.col("reject_reason"), F.lit(": "), "name")).cast("boolean")
    return rows.where(F.when(F.col("reject_reason").isNotNull(), bad).otherwise(F.lit(True))).drop("reject_reason")


def write_containers(samples: DataFrame, folder: str, page: int = 4096, compressed: Column | None = None) -> None:
    """Samples (idx, name, shard, data, label, ts, family) as ``read_packed`` reads them: a container for each shard,
    blobs padded to ``page`` in the order of ``idx``, with the manifest's and the metadata's tables.

    ``compressed`` tells of a shard whether its container is written as zstd. A shard is written by one task, blob by
    blob; a container is moved to its place when it is whole, so that a task may run again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = sink = raw = None
        at = 0
        for batch in batches:
            offsets = []
            for mine, zstd, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "compressed", "data"))):
                if mine != shard:
                    if sink is not None:
                        sink.close()
                        raw.commit()
                    shard, at = mine, 0
                    raw = ranged.Written(f"{folder}/data/data-{mine}.bin")
                    sink = pa.CompressedOutputStream(raw.stream, "zstd") if zstd else raw.stream
                data = data or b""
                offsets.append(at)
                sink.write(data + bytes(-len(data) % page))
                at += len(data) + -len(data) % page
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("idx", "name", "shard")] + [pa.array(offsets, pa.int64()), pa.array([len(d or b"") for d in batch.column("data").to_pylist()], pa.int64())], ["idx", "name", "shard", "offset", "size"])
        if sink is not None:
            sink.close()
            raw.commit()

    flag = compressed if compressed is not None else F.lit(False)
    rows = samples.select(F.col("idx").cast("long").alias("idx"), F.col("name").cast("string").alias("name"), F.col("shard").cast("int").alias("shard"), flag.alias("compressed"), "data")
    sorted_rows = rows.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "idx")
    sorted_rows.mapInArrow(write, SIZE_SCHEMA).write.mode("error").option("header", True).csv(f"{folder}/size")
    meta = samples.select("idx", F.col("name").cast("string").alias("name"), "shard", F.coalesce("ts", F.lit(-1)).cast("long").alias("timestamp"), F.when(F.col("label"), 1).otherwise(-1).alias("malware"), F.coalesce("family", F.lit("")).alias("family"))
    meta.write.mode("error").option("header", True).csv(f"{folder}/meta")


def _write_stored(rows: DataFrame, folder: str, key: str) -> None:
    """Parquet by shard, each shard in the order of the key, with Bloom filters on it: a lookup opens its shard's folder,
    and in it only row groups that may hold the key.

    A filter is as large as its row group's keys need, else each small shard would hold a megabyte of it. A shard of more
    bytes than a task should have is written by several, each of them in the order of the key.
    """
    dealt = rows.hint("rebalance", "shard").sortWithinPartitions("shard", key)
    writer = dealt.write.mode("error").partitionBy("shard").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", True).option("parquet.bloom.filter.candidates.number", FILTER_SIZES)
    writer.option(f"parquet.bloom.filter.enabled#{key}", True).parquet(folder)


def write_packed(samples: DataFrame, folder: str, key: str = "name") -> None:
    """Samples with ``idx`` and ``shard`` as Parquet, a folder for each shard; a folder that is there is refused."""
    _write_stored(samples, folder, key)


def write_regions(regions: DataFrame, folder: str, key: str = "name") -> None:
    """Regions of samples as Parquet, a folder for each shard; a folder that is there is refused."""
    _write_stored(regions, folder, key)


def lookup(rows: DataFrame, name, shard: int | None = None, key: str = "name") -> DataFrame:
    """Rows of one key, read from its shard's folder alone if that is given; an error if there is none."""
    found = rows.where(F.col(key) == name)
    found = found.where(F.col("shard") == shard) if shard is not None else found
    if found.isEmpty():
        raise KeyError(name)
    return found


def lookup_many(rows: DataFrame, keys: DataFrame, key: str = "name") -> DataFrame:
    """Rows of many (key, shard) pairs; pairs without a row have none here.

    Where the pairs lie in few shards, no other shard's folder is opened, and where they are few, their keys are pushed
    down to the row groups' statistics and Bloom filters. Beyond these numbers the join prunes what it can.
    """
    pairs = checkpointed(keys.select(key, "shard"))
    shards = pairs.select("shard").distinct().limit(FEW_SHARDS + 1).collect()
    if len(shards) <= FEW_SHARDS:
        rows = rows.where(F.col("shard").isin([r[0] for r in shards]))
    names = pairs.select(key).distinct().limit(FEW_KEYS + 1).collect()
    if len(names) <= FEW_KEYS:
        rows = rows.where(F.col(key).isin([r[0] for r in names]))
    return pairs.join(rows, [key, "shard"])


def shard_of(idx: DataFrame, samples: DataFrame) -> DataFrame:
    """The shard of every idx, by the least and greatest idx of each shard; met in buckets, not shard by shard."""
    spans = samples.groupBy("shard").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end")).withColumn("all", F.lit(1))
    return point_join(idx.select("idx", F.col("idx").alias("pos"), F.lit(1).alias("all")), spans, key="all").select("idx", "shard")


def fan_out(name: Column, depth: int = 2) -> Column:
    """root/n[0]/n[1]/name."""
    return F.concat_ws("/", *[F.substring(name, i + 1, 1) for i in range(depth)], name)


def read_runlog(spark: SparkSession, path: str) -> DataFrame:
    """A run log of JSON lines, the union of its keys as columns; memory readings in GiB."""
    rows = spark.read.json(path)
    return rows.withColumns({c: F.col(c) / 2**30 for c in rows.columns if c.endswith(RUNLOG_SUFFIX)}) if any(c.endswith(RUNLOG_SUFFIX) for c in rows.columns) else rows


def append_runlog(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_predictions(scores: DataFrame, path: str) -> None:
    scores.select("name", "label", "logits").write.parquet(path)


def concat(*parts: DataFrame) -> DataFrame:
    """Data sets one after another, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_function(fn, schema: str):
    """A table function of a user's transform, for SQL and DataFrames alike, over TABLE(name, data).

    ``fn(name, data)`` gives a tuple after ``schema``, None to skip the sample, or fails. Each sample is one row: the
    transform's columns, ``sample``, its name as text, and ``reject_reason``: null, ``skipped`` or the error. Rejected
    rows have nulls in the transform's columns, so that nothing is lost unseen.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    class Transform:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows, samples, reasons = [], [], []
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist()):
                try:
                    found = fn(name, data)
                    reason = None if found is not None else SKIPPED
                except Exception as e:  # whatever a user's code raises is a reason to reject the row, not the job
                    found, reason = None, f"error: {type(e).__name__}: {e}"
                rows.append(found if found is not None else (None,) * len(kinds))
                samples.append(None if name is None else str(name))
                reasons.append(reason)
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(samples, pa.string()), pa.array(reasons, pa.string())], [*kinds.names, "sample", "reject_reason"])

    return F.arrow_udtf(Transform, returnType=f"{schema}, sample string, reject_reason string")


def transformed(samples: DataFrame, fn, schema: str) -> DataFrame:
    """A user's transform of samples with ``sample`` and ``reject_reason``, see ``table_function``."""
    return table_function(fn, schema)(samples.select("name", "data").asTable())


def map_blobs(samples: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(name, data)`` of every sample: a tuple after ``schema``, or None to leave the sample out. An error of it is
    one of the job when rows are read."""
    rows = transformed(samples, fn, schema)
    bad = F.raise_error(F.concat(F.col("reject_reason"), F.lit(", sample "), F.coalesce("sample", F.lit("null")))).cast("boolean")
    good = F.when(F.coalesce("reject_reason", F.lit("")).startswith("error"), bad).otherwise(F.col("reject_reason").isNull())
    return rows.where(good).drop("sample", "reject_reason")


def score_blobs(samples: DataFrame, model) -> DataFrame:
    """(name, label, logits) by ``model``, which takes a list of blobs and gives two logits for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[["name", "label"]].assign(logits=[list(map(float, x)) for x in model(batch["data"].tolist())])

    return samples.select("name", F.col("label").cast("int").alias("label"), "data").mapInPandas(run, "name long, label int, logits array<double>")
