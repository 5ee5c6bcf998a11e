"""Streams as queries: the given tables' rows are appended to a folder part by part, and a stream reads what is there and
ends. Each stream goes through several batches, with its state and its checkpoint in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.plans.file_queries import _samples, _through
from bytebasin.plans.store_queries import D
from bytebasin.registry import query
from bytebasin.sources import ranged, store
from bytebasin.sources import tables as tb
from bytebasin.streaming import streams

#: Parts in which rows are appended; rows of a shard in the packed stream.
PARTS, PER_SHARD = 4, 100


def _append(rows: DataFrame, folder: str, by: str) -> None:
    """Rows in files of their own by ranges of a column, one after the other, as a producer would leave them.

    Rows are read and made by all tasks; what one task gets is a part's narrow rows, to put them into its file.
    """
    cuts = rows.select(F.percentile_approx(F.col(by).cast("double"), [k / PARTS for k in range(1, PARTS)], 1000)).first()[0] or []
    at = F.lit(0)
    for c in sorted(set(cuts)):
        at = at + (F.col(by).cast("double") > c).cast("int")
    for k in range(len(set(cuts)) + 1):
        rows.where(F.coalesce(at, F.lit(0)) == k).repartition(1).write.mode("append").parquet(folder)


def _files_a_batch(spark: SparkSession, folder: str, pattern: str) -> int:
    """Files a batch for ``PARTS`` batches, however many there are: a batch costs its state's tasks, whatever it reads."""
    return max(8, -(-ranged.list_files(spark, folder, pattern).count() // PARTS))


def _run(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Everything that is there through the stream, into ``folder``/out or the given sink."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    started = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{folder}/out").start()
    started.awaitTermination()


@query(D + """, boxes AS (SELECT shard, string_agg(rpad(hex(data), 2 * CAST(ceil(size / 4096.0) * 4096 AS INTEGER), '0'), '' ORDER BY idx) AS bytes FROM packed GROUP BY shard)
SELECT DISTINCT sha256(unhex(bytes)) AS name, CAST(octet_length(unhex(bytes)) AS BIGINT) AS full_size, sha256(unhex(left(bytes, 2000))) AS head FROM boxes""")
def ingested_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files named by their content, cut to a prefix, the first of each name; every file is there twice."""

    def write(folder: str) -> None:
        samples = _samples(spark, sf_dir)
        for k in range(2):
            store.write_containers(samples, f"{folder}/in/{k}")
        found = streams.fingerprinted(streams.blob_stream(spark, f"{folder}/in", "*.bin", _files_a_batch(spark, f"{folder}/in", "*.bin")), 1000)
        # files are as old as this run: no name is forgotten while it lasts
        once = streams.unique_names(found, ("modificationTime", "1 day"))
        _run(once.select("name", "full_size", F.sha2("data", 256).alias("head")), folder)

    return _through(spark, write, lambda folder: spark.read.parquet(f"{folder}/out"))


@query("SELECT sha256(encode(text)) AS name, min(doc_id) AS least, count(*) AS copies FROM documents GROUP BY 1")
def streamed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every text among documents that come by id, and how many there are of it in all."""
    docs = tb.read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("name"), "doc_id", F.timestamp_seconds(F.col("doc_id") + 1_000_000_000).alias("ts"))

    def write(folder: str) -> None:
        _append(docs, f"{folder}/in", "doc_id")
        _run(streams.unique_names(streams.table_stream(spark, f"{folder}/in", 1), ("ts", "100000 days")), folder)

    def read(folder: str) -> DataFrame:
        copies = docs.groupBy("name").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
        return spark.read.parquet(f"{folder}/out").groupBy("name").agg(F.count("*").alias("n")).where("n = 1").join(copies, "name").select("name", "least", "copies")

    return _through(spark, write, read)


@query(f"""WITH d AS (SELECT doc_id AS name, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT idx // {PER_SHARD} AS shard, count(*) AS n, min(idx) AS first, max(idx) AS last, CAST(sum(name) AS BIGINT) AS names FROM d GROUP BY 1""")
def streamed_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered on from batch to batch, as they come by id, and dealt to shards by number."""
    docs = tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))

    def write(folder: str) -> None:
        _append(docs, f"{folder}/in", "name")
        _run(streams.table_stream(spark, f"{folder}/in", 1), folder, each=streams.packer(f"{folder}/out", PER_SHARD))

    read = lambda folder: streams.packed_rows(spark, f"{folder}/out").groupBy("shard").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"), F.sum("name").alias("names"))
    return _through(spark, write, read)


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean_rate, max(value) AS max_level FROM events GROUP BY 1, 2")
def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly reports of events as they come, each batch's reports in place of the last one's."""

    def write(folder: str) -> None:
        _append(tb.read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), f"{folder}/in", "event_id")
        reports = streams.windowed_metrics(streams.table_stream(spark, f"{folder}/in", 1), "1 hour", "1 day")
        _run(reports, folder, "complete", lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))

    return _through(spark, write, lambda folder: spark.read.parquet(f"{folder}/out").withColumn("mean_rate", F.round("mean_rate", 6)))


@query(f"""WITH {tb.RUNLOG_SQL}, v AS (SELECT run, step, value, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runlog),
b AS (SELECT *, step - max(CASE WHEN before IS NULL OR value > before THEN step END) OVER (PARTITION BY run ORDER BY step) AS bad FROM v)
SELECT run, min(step) AS stop FROM b WHERE bad > 10 GROUP BY run""")
def streamed_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which each run stops, told by a stream of its values when it does."""

    def write(folder: str) -> None:
        # by step: a run's rows come in its own order from part to part
        _append(tb.runlog(spark, sf_dir).select("run", "step", "value", F.timestamp_seconds(F.col("step") + 1_000_000_000).alias("ts")), f"{folder}/in", "step")
        _run(streams.early_stops(streams.table_stream(spark, f"{folder}/in", 1), 10, expires=("ts", "1 day", 86_400)), folder)

    return _through(spark, write, lambda folder: spark.read.parquet(f"{folder}/out"))
