"""Whole jobs put together from the operators: acquire and split, preprocess into shards, batches for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.functions.scalars import clean_timestamp
from bytebasin.operators import batching as bt
from bytebasin.operators import integrity as ig
from bytebasin.operators import intervals as iv
from bytebasin.operators import layout, splits
from bytebasin.operators.ranking import shards_by_count
from bytebasin.sources import store


def acquire(members: DataFrame, times: DataFrame, cutoff: int, malware: bool) -> DataFrame:
    """Samples (name, data, label, ts) of archive members: named by content, one of each, times looked up or -1."""
    named = members.select(F.sha2("data", 256).alias("name"), "data").dropDuplicates(["name"])
    ts = clean_timestamp(F.coalesce("ts", F.lit(-1).cast("long")), cutoff)
    return named.join(times.select("name", "ts"), "name", "left").select("name", "data", F.lit(int(malware)).alias("label"), ts.alias("ts"))


def preprocess(index: DataFrame, blobs: DataFrame, folder: str, max_length: int, per_shard: int) -> DataFrame:
    """Write ``samples`` and ``regions`` of the indexed blobs to ``folder`` by shard; returns each shard's check.

    ``index`` is (sha, label) and ``blobs`` (name, data). Structures come from whole blobs and are then cut to the
    length that is stored; blobs that are no executables keep a single range.
    """
    spark = index.sparkSession
    found = index.select(F.col("sha").alias("name"), "label").join(blobs.select("name", "data"), "name")
    ranked = shards_by_count(found.select("name", "label"), per_shard, "name")
    samples = ranked.join(blobs.select("name", F.substring("data", 1, max_length).alias("data")), "name").withColumn("size", F.length("data").cast("long"))
    store.write_packed(samples, f"{folder}/samples")
    kept = spark.read.parquet(f"{folder}/samples")
    regions = iv.trim(layout.structures(found.select("name", "data")), max_length).join(ranked.select("name", "shard"), "name")
    store.write_regions(regions, f"{folder}/regions")
    return ig.verify_shards(kept, ranked.select("shard", "name", "label"), spark.read.parquet(f"{folder}/regions"), max_length)


def split_by_class(samples: DataFrame, shares: tuple[float, float, float], folder: str, per_shard: int, seed: int = 0) -> DataFrame:
    """Write a stratified split by split and shard; returns how many rows it left out and should have."""
    rows = samples.withColumn("idx", F.xxhash64("name"))
    split = splits.stratified_split(rows.select("idx", "name", "label"), shares, seed=seed)
    sharded = shards_by_count(split, per_shard, "split", "name").select("name", "split", "shard")
    splits.write_splits(samples.join(sharded, "name"), folder)
    return splits.removed_report(samples.count(), split, shares, "class ratios")


def training_batches(spark: SparkSession, folder: str, level: str, per_batch: int, least: int = 0, multiple: int = 64, most: int | None = None, cap: int | None = None) -> DataFrame:
    """(batch, label, length, names, lengths, tokens) of preprocessed samples, a sequence for each structure of ``level``.

    A structure's ranges are joined in order; samples without ranges have one unknown range.
    """
    samples = spark.read.parquet(f"{folder}/samples")
    regions = spark.read.parquet(f"{folder}/regions").where(F.col("level") == level)
    rows = iv.with_fallback(regions, samples.select("name", "size"), cap)
    rows = rows.withColumn("ord", F.xxhash64("label", "start", "end"))
    if most:
        rows = iv.collapse(rows, most)
    if cap:
        rows = iv.cap_lengths(rows, cap)
    sliced = iv.slice_blobs(samples, rows.withColumn("ord", F.col("start")))
    batches = bt.batches(samples.select("name"), per_batch, "name")
    values = sliced.join(batches, "name").select("batch", "label", "slot", "name", bt.tokens_of("data").alias("tokens"))
    return bt.collate(values, least, multiple, keys=("batch", "label"))
