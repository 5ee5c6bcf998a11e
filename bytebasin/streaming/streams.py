"""Streams: ingest, incremental packing, unique names, metric reports, early stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def blob_stream(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as (path, modificationTime, length, content), so many a batch at most."""
    reader = spark.readStream.format("binaryFile").schema(BLOB_SCHEMA).option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def table_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder, with the schema of those that are there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def fingerprinted(blobs: DataFrame, max_length: int | None = None) -> DataFrame:
    """Blobs named by SHA-256, cut to a prefix, empty ones left out."""
    kept = blobs.where("length > 0").withColumn("name", F.sha2("content", 256))
    data = F.substring("content", 1, max_length) if max_length else F.col("content")
    return kept.select("name", data.alias("data"), F.col("length").alias("full_size"), "modificationTime")


def unique_names(stream: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first row of every name. With a watermark (column, delay) a name is forgotten once the watermark has passed
    its row by the delay, so that state does not grow without end; a copy that comes later than that is a first row again.
    """
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(["name"])
    return stream.dropDuplicates(["name"])


def _marks(spark: SparkSession, folder: str) -> tuple[object, dict[int, object]]:
    """The sink's marks, by batch: the last two."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_next")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(path)] if system.exists(path) else []
    return system, {int(p.getName()): p for p in found if p.getName().isdigit()}


def packer(folder: str, per_shard: int) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that numbers rows on from the batches before and writes them by shard.

    A batch goes to a folder of its own, which is overwritten if the batch is run again. What the next number is after a
    batch is a mark of one row; a batch reads the mark of the one before it and leaves its own, and older marks go. So
    the thousandth batch reads as much as the second, and a batch that is run again gets the same numbers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from bytebasin.operators.ranking import global_rank

        spark = batch.sparkSession
        system, marks = _marks(spark, folder)
        last = max((b for b in marks if b < batch_id), default=None)
        before = spark.read.schema("next long").json(marks[last].toString()).first()[0] if last is not None else 0
        ranked = global_rank(batch, "name", into="rank").withColumn("idx", F.col("rank") + before)
        rows = ranked.withColumn("shard", F.floor(F.col("idx") / per_shard)).drop("rank")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        n = spark.read.schema(rows.schema).parquet(f"{folder}/batch={batch_id}").count()
        spark.createDataFrame([(before + n,)], "next long").coalesce(1).write.mode("overwrite").json(f"{folder}/_next/{batch_id}")
        for b, path in marks.items():
            if last is not None and b < last:
                system.delete(path, True)

    return write


def packed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What ``packer`` has written."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")


def windowed_metrics(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Count, mean and greatest value by event type and tumbling window; with ``late`` for a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    found = rows.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_rate"), F.max("value").alias("max_level"))
    return found.select("event_type", F.col("w.start").alias("start"), "n", "mean_rate", "max_level")


def early_stops(values: DataFrame, patience: int, threshold: float = 0.0, expires: tuple[str, str, int] | None = None) -> DataFrame:
    """Early stops of a stream of (run, step, value), one row a run when it stops; steps come in order within a run.

    The state of a run is its best value, how many steps have not improved on it, and whether it has stopped. With
    ``expires`` (time column, delay of the watermark, seconds) a run's state goes once the watermark is so many seconds
    beyond its last row; a run that goes on after that begins anew.
    """
    import pandas as pd

    ts, delay, idle = expires or (None, None, 0)

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run": pd.Series([], dtype="int64"), "stop": pd.Series([], dtype="int64")})
            return
        best, bad, stopped = state.get if state.exists else (None, 0, False)
        out, last = [], None
        for pdf in batches:
            if ts is not None and len(pdf):
                last = max(filter(None, (last, pdf[ts].max())))
            for s, v in pdf.sort_values("step")[["step", "value"]].itertuples(index=False):
                if stopped:
                    break
                if best is None or v > best + threshold:
                    best, bad = float(v), 0
                elif (bad := bad + 1) > patience:
                    stopped = True
                    out.append((key[0], int(s)))
        state.update((best, bad, stopped))
        if last is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run", "stop"])

    columns = ["run", "step", "value"] + ([ts] if ts else [])
    rows = values.select(*columns).withWatermark(ts, delay) if ts else values.select(*columns)
    return rows.groupBy("run").applyInPandasWithState(step, "run long, stop long", "best double, bad long, stopped boolean", "append", "EventTimeTimeout" if ts else "NoTimeout")
