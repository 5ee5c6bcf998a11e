"""Queries of scores and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.functions.scalars import softmax_positive
from bytebasin.operators import metrics as mt
from bytebasin.registry import query
from bytebasin.sources import tables as tb

S, L = f"WITH {tb.SCORES_SQL}", f"WITH {tb.RUNLOG_SQL}"
CURVE = S + """, d AS (SELECT score, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM scores GROUP BY score),
c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM d),
k AS (SELECT *, lag(tp, 1, 0.0) OVER (ORDER BY score DESC) AS tp0, lag(fp, 1, 0.0) OVER (ORDER BY score DESC) AS fp0 FROM c) """


@query(S + """, c AS (SELECT count(*) FILTER (WHERE score >= 0.05 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.05 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.05 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.05 AND label = 0) AS tn FROM scores),
m AS (SELECT *, CAST(tp + tn AS DOUBLE) / greatest(1, tp + tn + fp + fn) AS acc, CAST(tp AS DOUBLE) / greatest(1, tp + fp) AS pre, CAST(tp AS DOUBLE) / greatest(1, tp + fn) AS rec FROM c)
SELECT *, 2 * pre * rec / greatest(1.0, pre + rec) AS f1 FROM m""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(tb.scores(spark, sf_dir), 0.05)


@query(CURVE + "SELECT CASE WHEN max(tp) > 0 AND max(fp) > 0 THEN sum((fp - fp0) * (tp + tp0) / 2.0) / (max(tp) * max(fp)) ELSE 0.5 END AS auroc FROM k")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.auroc(tb.scores(spark, sf_dir))


@query(CURVE + "SELECT CASE WHEN max(tp) > 0 THEN sum((tp - tp0) * tp / (tp + fp)) / max(tp) ELSE 0.0 END AS auprc FROM k")
def auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.auprc(tb.scores(spark, sf_dir))


@query("""WITH v AS (SELECT vec_id AS name, label % 2 AS label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
p AS (SELECT name, label, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p FROM v)
SELECT name, label, round(p, 6) AS p, CAST(p >= 0.5 AS INTEGER) AS predicted FROM p""")
def softmax_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = tb.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), (F.col("label") % 2).alias("label"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    p = softmax_positive(F.col("a"), F.col("b"))
    return vec.select("name", "label", F.round(p, 6).alias("p"), (p >= 0.5).cast("int").alias("predicted"))


@query(L + " SELECT metric, round(sum(value * step) / sum(step), 6) AS mean, sum(step) AS weight FROM runlog GROUP BY metric")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.weighted_mean(tb.runlog(spark, sf_dir), "value", "step", "metric")
    return out.withColumn("mean", F.round("mean", 6))


@query(L + ", w AS (SELECT run % 4 AS worker, metric AS key, value FROM runlog) SELECT key, round(sum(value), 4) AS value, count(DISTINCT worker) = (SELECT count(DISTINCT worker) FROM w) AS complete FROM w GROUP BY key")
def reduced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tb.runlog(spark, sf_dir).select((F.col("run") % 4).alias("worker"), F.col("metric").alias("key"), "value")
    return mt.reduce_workers(parts).withColumn("value", F.round("value", 4))


@query(L + """, best AS (SELECT run, metric, CASE metric WHEN 'purchase' THEN max(value) ELSE min(value) END AS best FROM runlog WHERE value IS NOT NULL AND metric IN ('purchase', 'view') GROUP BY run, metric)
SELECT b.run, b.metric, round(b.best, 6) AS best, coalesce(min(r.step), -1) AS step FROM best b LEFT JOIN runlog r ON r.run = b.run AND r.metric = b.metric AND r.value = b.best GROUP BY b.run, b.metric, b.best""")
def runlog_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = mt.best_steps(tb.runlog(spark, sf_dir), {"purchase": "max", "view": "min"})
    return best.withColumn("best", F.round("best", 6))


@query(L + """, c AS (SELECT run, step, metric, CAST(step % 3 AS DOUBLE) AS value FROM runlog), best AS (SELECT run, metric, avg(value) AS best FROM c GROUP BY run, metric)
SELECT b.run, b.metric, round(b.best, 6) AS best, coalesce(min(r.step), -1) AS step FROM best b LEFT JOIN c r ON r.run = b.run AND r.metric = b.metric AND r.value = b.best GROUP BY b.run, b.metric, b.best""")
def runlog_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of small whole numbers, and the first step that has the mean itself."""
    rows = tb.runlog(spark, sf_dir).withColumn("value", (F.col("step") % 3).cast("double"))
    means = mt.best_steps(rows, {m: "mean" for m in [r["metric"] for r in rows.select("metric").distinct().collect()]})
    return means.withColumn("best", F.round("best", 6))


@query(L + """, v AS (SELECT run, step, value, max(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runlog),
b AS (SELECT *, step - max(CASE WHEN before IS NULL OR value > before THEN step END) OVER (PARTITION BY run ORDER BY step) AS bad FROM v)
SELECT run, min(CASE WHEN bad > 10 THEN step END) AS stop FROM b GROUP BY run""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.early_stop(tb.runlog(spark, sf_dir), patience=10)


@query((L + """, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM runlog), w AS (SELECT run, i, step, value AS best, 0 AS bad, CAST(NULL AS BIGINT) AS stop FROM o WHERE i = 1
UNION ALL SELECT o.run, o.i, o.step, CASE WHEN value > best + 8 THEN value ELSE best END, CASE WHEN value > best + 8 THEN 0 ELSE bad + 1 END, coalesce(stop, CASE WHEN value <= best + 8 AND bad + 1 > 10 THEN o.step END) FROM w JOIN o ON o.run = w.run AND o.i = w.i + 1)
SELECT run, min(stop) AS stop FROM w GROUP BY run""").replace("WITH runlog", "WITH RECURSIVE runlog"))
def early_stop_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early stops where a value has to be better by a threshold."""
    return mt.early_stop(tb.runlog(spark, sf_dir), patience=10, threshold=8.0)


@query("SELECT user_id % 7 AS report, CAST(event_id % 24 AS BIGINT) AS hour, round(avg(value), 6) AS mean_rate, max(value) AS max_level FROM events GROUP BY 1, 2")
def monitor_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("report"), (F.col("event_id") % 24).cast("long").alias("hour"), F.col("value").alias("rate"), F.col("value").alias("level"))
    return mt.monitor_report(ev, "report", "hour").withColumn("mean_rate", F.round("mean_rate", 6))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean_rate, max(value) AS max_level FROM events GROUP BY 1, 2")
def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming metric report."""
    from bytebasin.streaming.streams import windowed_metrics

    out = windowed_metrics(tb.read(spark, sf_dir, "events"), "1 hour")
    return out.withColumn("mean_rate", F.round("mean_rate", 6))
