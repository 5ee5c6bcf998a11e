"""Checks of data sets: rows of violations rather than the first error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_dataset(sizes: DataFrame, meta: DataFrame) -> DataFrame:
    """(check, key) of every violation: rows of one table alone, differing names or shards, repeated names, gaps in idx."""
    s, m = sizes.select("idx", F.col("name").alias("sn"), F.col("shard").alias("ss")), meta.select("idx", F.col("name").alias("mn"), F.col("shard").alias("ms"))
    both = s.join(m, "idx", "full_outer")
    kind = (
        F.when(F.col("sn").isNull(), "no size row").when(F.col("mn").isNull(), "no meta row")
        .when(F.col("sn") != F.col("mn"), "names differ").when(F.col("ss") != F.col("ms"), "shards differ")
    )
    pairs = both.select(kind.alias("check"), F.col("idx").cast("string").alias("key")).where("check IS NOT NULL")
    names = sizes.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated name").alias("check"), F.col("name").cast("string").alias("key"))
    top = sizes.agg(F.max("idx")).first()[0]
    span = sizes.sparkSession.range(0, (-1 if top is None else top) + 1).withColumnRenamed("id", "idx")
    gaps = span.join(sizes.select("idx"), "idx", "left_anti").select(F.lit("missing idx").alias("check"), F.col("idx").cast("string").alias("key"))
    return pairs.unionByName(names).unionByName(gaps)


def verify_shards(samples: DataFrame, expected: DataFrame, regions: DataFrame, max_size: int) -> DataFrame:
    """A row for each shard: samples, missing, unexpected, wrong labels, oversized, wrong digests, stray region names.

    A digest is checked where the blob was not cut, that is where it is shorter than ``max_size``. One job for all
    shards; only names, labels and digests are shuffled.
    """
    got = samples.select("shard", "name", "label", (F.length("data") > max_size).alias("big"), ((F.length("data") < max_size) & (F.sha2("data", 256) != F.col("name"))).alias("bad"))
    want = expected.select("shard", "name", F.col("label").alias("want"))
    both = got.withColumn("here", F.lit(1)).join(want.withColumn("there", F.lit(1)), ["shard", "name"], "full_outer")
    status = both.groupBy("shard").agg(
        F.count("here").alias("samples"), F.count_if(F.col("here").isNull()).alias("missing"), F.count_if(F.col("there").isNull()).alias("unexpected"),
        F.count_if(F.col("label") != F.col("want")).alias("wrong_label"), F.count_if(F.col("big")).alias("oversized"), F.count_if(F.col("bad")).alias("wrong_digest"),
    )
    stray = regions.select("shard", "name").distinct().join(want, ["shard", "name"], "left_anti").groupBy("shard").agg(F.count("*").alias("stray_regions"))
    return status.join(stray, "shard", "left").withColumn("stray_regions", F.coalesce("stray_regions", F.lit(0).cast("long")))


def validate_sample(stored: DataFrame, source: DataFrame, max_size: int, k: int, seed: int = 0) -> DataFrame:
    """(rows, max_size, checked, differing): totals, and ``k`` sampled blobs compared with their sources byte by byte."""
    from bytebasin.operators.ranking import seeded_sample

    picked = seeded_sample(stored.select("name"), "name", k, seed)
    pairs = picked.join(stored.select("name", "data"), "name").join(source.select("name", F.substring("data", 1, max_size).alias("origin")), "name", "left")
    checked = pairs.agg(F.count("*").alias("checked"), F.count_if(~F.col("data").eqNullSafe(F.col("origin"))).alias("differing"))
    return stored.agg(F.count("*").alias("rows"), F.max(F.length("data")).cast("long").alias("max_size")).crossJoin(checked)
