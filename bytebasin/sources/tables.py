"""Canonical tables: samples, regions, scores and run logs, from the star-schema and document tables.

samples(name, data, label, size), regions(name, label, ord, start, end, size), scores(name, label, score),
runlog(run, step, metric, value). Ranges are half-open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("CODE", "DATA", "DNETCODE", "DNETDATA")
#: Size of the blobs that ``regions`` lie on.
REGION_SIZE = 200
#: Rows of a task, of tables dealt by a key: at most, and, where a shuffle's tasks need not all be used, at least.
MOST_ROWS, LEAST_ROWS = 500_000, 50_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table dealt by a key, over more tasks the more rows it has: what a task sorts does not grow with them."""
    n, most = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(-(-n // MOST_ROWS), min(most, -(-n // LEAST_ROWS)), 1), key)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "UTF-8").alias("data"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.col("toxic").alias("label"))
    return docs.join(labels, "name", "left").withColumn("size", F.length("data").cast("long"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("start", "end", "label", "l_suppkey", "l_extendedprice")
    label = F.get(F.array(*map(F.lit, LABELS)), F.col("l_linenumber") % 4)
    start = (F.col("l_partkey") % 200).cast("long")
    rows = _dealt(rows, "l_orderkey").select("l_orderkey", "l_suppkey", "l_extendedprice", label.alias("label"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    rows = rows.withColumn("ord", F.row_number().over(order).cast("long"))
    return rows.select(F.col("l_orderkey").alias("name"), "label", "ord", "start", "end", F.lit(REGION_SIZE).cast("long").alias("size"))


REGIONS_SQL = """regions AS (
  SELECT l_orderkey AS name, label, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e, label, l_suppkey, l_extendedprice) AS ord,
         s AS "start", e AS "end", CAST(200 AS BIGINT) AS size
  FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'CODE' WHEN 1 THEN 'DATA' WHEN 2 THEN 'DNETCODE' ELSE 'DNETDATA' END AS label,
               CAST(l_partkey % 200 AS BIGINT) AS s, CAST(l_partkey % 200 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem))"""


def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of the lines of every document, their labels turning by three."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    order = Window.partitionBy("name").orderBy("ord")
    end = F.sum(F.octet_length("line") + 1).over(order)
    lines = docs.select("name", F.col("ord").cast("long").alias("ord"), (F.col("ord") % 3).cast("long").alias("label"), (end - F.octet_length("line") - 1).cast("long").alias("start"), (end - 1).cast("long").alias("end"))
    return lines.where("end > start")


LINE_REGIONS_SQL = """line_regions AS (
  SELECT name, ord, ord % 3 AS label, e - n - 1 AS "start", e - 1 AS "end"
  FROM (SELECT *, CAST(sum(n + 1) OVER (PARTITION BY name ORDER BY ord) AS BIGINT) AS e
        FROM (SELECT doc_id AS name, CAST(p - 1 AS BIGINT) AS ord, CAST(octet_length(encode(parts[p])) AS BIGINT) AS n
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, range(1, 100000) r(p)
              WHERE p <= len(parts)))
  WHERE n > 0)"""


def timed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, ts, label) of orders: ties in ts are usual, idx breaks them."""
    rows = read(spark, sf_dir, "orders")
    ts = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return rows.select(F.col("o_orderkey").cast("long").alias("idx"), ts.alias("ts"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


TIMED_SQL = "timed AS (SELECT CAST(o_orderkey AS BIGINT) AS idx, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS ts, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("name"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").cast("double").alias("score"))


SCORES_SQL = "scores AS (SELECT l_orderkey AS name, CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST(l_discount AS DOUBLE) AS score FROM lineitem)"


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return rows.select(F.col("user_id").alias("run"), step.alias("step"), F.col("event_type").alias("metric"), "value")


RUNLOG_SQL = "runlog AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS metric, value FROM events)"
