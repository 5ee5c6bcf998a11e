"""Queries of stored forms: containers, archives, packed sets, regions, splits, index and run-log files, each written to
the shared folder and read back; the folder goes once the rows are checkpointed."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.operators import splits as sp
from bytebasin.plans.split_queries import COUNTS, SHARES
from bytebasin.plans.store_queries import D, packed
from bytebasin.registry import query
from bytebasin.sources import ranged, store
from bytebasin.sources import tables as tb
from bytebasin.sources.shared import checkpointed, drop_folder, new_folder


def _through(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in a folder that ``write`` has filled."""
    folder = new_folder(spark, "stored")
    try:
        write(folder)
        return checkpointed(read(folder))
    finally:
        drop_folder(spark, folder)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, idx, shard, data, size, label, ts, family): documents by 64, ranked without their bytes."""
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("data"), F.when(F.col("lang") != "en", F.col("lang")).alias("family"))
    rows = packed(spark, sf_dir).join(docs, "name")
    return rows.withColumns({"label": F.coalesce(F.col("label") == 1, F.lit(False)), "ts": F.when(F.col("name") % 3 != 0, F.col("name"))})


CONTAINED = "SELECT CAST(name AS VARCHAR) AS name, idx, shard, size, sha256(data) AS sha, coalesce(label = 1, false) AS label, CASE WHEN name % 3 <> 0 THEN name END AS ts, CASE WHEN lang <> 'en' THEN lang ELSE '' END AS family FROM packed JOIN documents ON doc_id = name"


@query(f"{D} {CONTAINED}")
def container_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document out of a container by its manifest; every other container is compressed."""
    write = lambda folder: store.write_containers(_samples(spark, sf_dir), folder, compressed=F.col("shard") % 2 == 1)
    read = lambda folder: store.read_packed(spark, folder).select("name", "idx", F.col("shard").cast("long").alias("shard"), "size", F.sha2("data", 256).alias("sha"), "label", "ts", "family")
    return _through(spark, write, read)


@query(D + " SELECT shard, left(rpad(hex(data), 200, '0'), 200) AS head FROM packed WHERE idx % 64 = 0")
def container_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bytes of every container."""
    shard = F.regexp_extract("name", r"(\d+)\.bin$", 1).cast("long")
    return _through(spark, lambda folder: store.write_containers(_samples(spark, sf_dir), folder), lambda folder: ranged.read_prefixes(spark, f"{folder}/data", 100).select(shard.alias("shard"), F.hex("data").alias("head")))


def _write_archives(samples: DataFrame, folder: str) -> None:
    """An archive for each shard, members deflated or stored in turn, written by one task member by member."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = out = archive = None
        for batch in batches:
            for mine, name, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "name", "data"))):
                if mine != shard:
                    if archive is not None:
                        archive.close()
                        out.commit()
                    shard, out = mine, ranged.Written(f"{folder}/part-{mine}.zip")
                    archive = zipfile.ZipFile(out.stream, "w")
                method = zipfile.ZIP_DEFLATED if name % 2 else zipfile.ZIP_STORED
                archive.writestr(zipfile.ZipInfo(f"{name // 10}/{name}.{'pdb' if name % 7 == 0 else 'exe'}"), data or b"", method)
            yield batch.select(["name"])
        if archive is not None:
            archive.close()
            out.commit()

    rows = samples.select("shard", "name", "data").repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "name")
    rows.mapInArrow(write, "name long").write.format("noop").mode("overwrite").save()


@query(D + " SELECT 'part-' || shard || '.zip' AS archive, (name // 10) || '/' || name || '.exe' AS member, size, sha256(data) AS sha FROM packed JOIN documents ON doc_id = name WHERE name % 7 <> 0 AND regexp_matches(text, '^[A-M]')")
def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that begin with one of some letters, out of archives; members of another kind are passed over."""
    magics = tuple(bytes([c]) for c in b"ABCDEFGHIJKLM")
    read = lambda folder: store.read_archives(spark, folder, magics).select(F.regexp_extract("archive", "([^/]*)$", 1).alias("archive"), F.col("name").alias("member"), F.length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha"))
    return _through(spark, lambda folder: _write_archives(_samples(spark, sf_dir), folder), read)


@query(D + " SELECT name, idx, shard, sha256(data) AS sha FROM packed JOIN documents ON doc_id = name")
def packed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples packed by shard, all of them read back."""
    return _through(spark, lambda folder: store.write_packed(_samples(spark, sf_dir), folder), lambda folder: spark.read.parquet(folder).select("name", "idx", F.col("shard").cast("long").alias("shard"), F.sha2("data", 256).alias("sha")))


@query(D + " SELECT p.name, p.idx, p.shard, p.size FROM packed p JOIN (SELECT o_orderkey AS name FROM orders) k ON k.name = p.name")
def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the orders' numbers, looked up in the packed set by name and shard."""
    ids = packed(spark, sf_dir).select("name", "shard")
    keys = tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name")).join(ids, "name")
    return _through(spark, lambda folder: store.write_packed(_samples(spark, sf_dir), folder), lambda folder: store.lookup_many(spark.read.parquet(folder), keys).select("name", "idx", F.col("shard").cast("long").alias("shard"), "size"))


@query(D + ", r AS (SELECT o_orderkey AS name, o_orderkey % 3 AS shard, o_custkey AS value FROM orders) SELECT p.name, p.shard, r.value FROM packed p JOIN r ON r.name = p.name AND r.shard = p.shard")
def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept by name and shard, asked for by both: an order's customer where the document of its number lies in its shard."""
    kept = tb.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 3).alias("shard"), F.col("o_custkey").alias("value"))
    keys = packed(spark, sf_dir).select("name", "shard")
    return _through(spark, lambda folder: store.write_regions(kept, folder), lambda folder: store.lookup_many(spark.read.parquet(folder), keys).select("name", F.col("shard").cast("long").alias("shard"), "value"))


@query(f"""WITH {tb.REGIONS_SQL} SELECT name, label, count(*) AS n, CAST(sum("end" - "start") AS BIGINT) AS covered FROM regions GROUP BY name, label""")
def region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions stored by shard, summed up by name and label as they are read."""
    rows = tb.regions(spark, sf_dir).withColumn("shard", F.col("name") % 5)
    read = lambda folder: spark.read.parquet(folder).groupBy("name", "label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"))
    return _through(spark, lambda folder: store.write_regions(rows, folder), read)


@query("SELECT sha256(encode(text)) AS sha, CAST(max(coalesce(toxic, 0)) AS INTEGER) AS label FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of documents with their labels, as lines of text and back."""
    rows = tb.samples(spark, sf_dir).groupBy(F.sha2("data", 256).alias("sha")).agg(F.max(F.coalesce("label", F.lit(0))).alias("label"))
    return _through(spark, lambda folder: store.write_index(rows, folder), lambda folder: store.read_index(spark, folder))


@query(f"""WITH {tb.RUNLOG_SQL} SELECT run AS epoch, count(*) AS n, count(*) FILTER (WHERE metric = 'click') AS with_memory, round(coalesce(sum(value) FILTER (WHERE metric = 'click'), 0), 6) AS memory, round(coalesce(sum(value) FILTER (WHERE metric <> 'click'), 0), 6) AS loss FROM runlog GROUP BY run""")
def runlog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log of two kinds of lines, appended one after the other; clicks stand for readings of memory, in bytes."""
    events = tb.runlog(spark, sf_dir).select(F.col("run").alias("epoch"), "metric", "value")

    def write(folder: str) -> None:
        store.append_runlog(events.where("metric = 'click'").select("epoch", (F.col("value") * 2.0**30).alias("tr_gpu_mem")), folder)
        store.append_runlog(events.where("metric <> 'click'").select("epoch", F.col("value").alias("vl_loss")), folder)

    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6)
    return _through(spark, write, lambda folder: store.read_runlog(spark, folder).groupBy("epoch").agg(F.count("*").alias("n"), F.count("tr_gpu_mem").alias("with_memory"), total("tr_gpu_mem").alias("memory"), total("vl_loss").alias("loss")))


@query("SELECT vec_id AS name, CAST(label % 2 AS INTEGER) AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS negative, round(CAST(embedding[2] AS DOUBLE), 6) AS positive FROM embeddings")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their logits, written and read again."""
    rows = tb.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), (F.col("label") % 2).cast("int").alias("label"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("logits"))
    return _through(spark, lambda folder: store.write_predictions(rows, folder), lambda folder: spark.read.parquet(folder).select("name", "label", *[F.round(F.col("logits")[i], 6).alias(n) for i, n in enumerate(("negative", "positive"))]))


@query(f"WITH {tb.TIMED_SQL}{COUNTS}, ranked AS (SELECT idx, ts, row_number() OVER (ORDER BY ts, idx) - 1 AS rank FROM timed), s AS (SELECT *, CASE WHEN rank < ca THEN 'tr' WHEN rank < ca + cb THEN 'vl' ELSE 'ts' END AS split FROM ranked, c) SELECT split, idx % 4 AS shard, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2")
def stored_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by time written by split and shard; what is read of each part is its number of rows and its times."""
    split = sp.temporal_split(tb.timed_samples(spark, sf_dir), SHARES).withColumn("shard", F.col("idx") % 4)
    read = lambda folder: spark.read.parquet(folder).groupBy("split", F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return _through(spark, lambda folder: sp.write_splits(split, folder), read)


@query("""SELECT CASE WHEN octet_length(encode(text)) < 500 THEN 'skipped' WHEN starts_with(text, 'S') THEN 'error: ValueError: an S' END AS reject_reason, count(*) AS n,
CAST(coalesce(sum(CASE WHEN octet_length(encode(text)) >= 500 AND NOT starts_with(text, 'S') THEN len(text) - len(replace(text, chr(10), '')) END), 0) AS BIGINT) AS breaks FROM documents GROUP BY 1""")
def transformed_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's transform as a table function in SQL: short blobs are skipped, some fail, and both are counted."""

    def breaks(name: int, data: bytes) -> tuple[int, int] | None:
        if len(data) < 500:
            return None
        if data.startswith(b"S"):
            raise ValueError("an S")
        return name, data.count(b"\n")

    spark.udtf.register("line_breaks", store.table_function(breaks, "name long, breaks long"))
    tb.samples(spark, sf_dir).select("name", "data").createOrReplaceTempView("line_break_samples")
    return spark.sql("SELECT reject_reason, count(*) AS n, coalesce(sum(breaks), 0) AS breaks FROM line_breaks(TABLE(line_break_samples)) GROUP BY reject_reason")
