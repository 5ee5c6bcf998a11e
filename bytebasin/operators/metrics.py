"""Scores and run logs: confusion, AUROC, AUPRC, weighted means, best steps, early stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytebasin.operators.ranking import running_sums


def confusion(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and accuracy, precision, recall and F1, denominators being 1 at least (so F1 is 2pr / max(p + r, 1))."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    c = scores.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    one = F.lit(1)
    c = c.withColumns({"acc": (F.col("tp") + F.col("tn")) / F.greatest(one, F.expr("tp + tn + fp + fn")), "pre": F.col("tp") / F.greatest(one, F.expr("tp + fp")), "rec": F.col("tp") / F.greatest(one, F.expr("tp + fn"))})
    return c.withColumn("f1", 2.0 * F.col("pre") * F.col("rec") / F.greatest(F.lit(1.0), F.col("pre") + F.col("rec")))


def _thresholds(scores: DataFrame) -> DataFrame:
    """Running true and false positives by distinct score from above, summed up in ranges of scores."""
    by_score = scores.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    running = running_sums(by_score, [F.col("score").desc()], "p", "n")
    return running.select("score", F.col("sum_p").alias("tp"), F.col("sum_n").alias("fp"), (F.col("sum_p") - F.col("p")).alias("tp0"), (F.col("sum_n") - F.col("n")).alias("fp0"))


def auroc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids, ties as one threshold; 0.5 where a class is missing."""
    area = _thresholds(scores).agg(F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0")) / 2.0).alias("area"), F.max("tp").alias("pos"), F.max("fp").alias("neg"))
    return area.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("area") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auroc"))


def auprc(scores: DataFrame) -> DataFrame:
    """Sum over thresholds of the recall gained times the precision; 0 without positives."""
    t = _thresholds(scores)
    parts = t.agg(F.sum((F.col("tp") - F.col("tp0")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.max("tp").alias("pos"))
    return parts.select(F.when(F.col("pos") > 0, F.col("s") / F.col("pos")).otherwise(0.0).alias("auprc"))


def weighted_mean(partials: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    return partials.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def reduce_workers(partials: DataFrame) -> DataFrame:
    """Sums by key over workers; ``complete`` tells whether every worker has the key."""
    workers = partials.agg(F.count_distinct("worker").alias("workers"))
    sums = partials.groupBy("key").agg(F.sum("value").alias("value"), F.count_distinct("worker").alias("n"))
    return sums.crossJoin(F.broadcast(workers)).select("key", "value", (F.col("n") == F.col("workers")).alias("complete"))


def best_steps(runlog: DataFrame, how: dict[str, str]) -> DataFrame:
    """For each run and metric the value by ``how`` (max, min or mean) and the first step that has it, -1 if none."""
    kind = F.create_map(*[F.lit(x) for pair in how.items() for x in pair])[F.col("metric")]
    rows = runlog.where("value IS NOT NULL").withColumn("how", kind).where("how IS NOT NULL")
    best = rows.groupBy("run", "metric", "how").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("mid"), F.min(F.struct((-F.col("value")).alias("v"), "step")).alias("at_hi"), F.min(F.struct(F.col("value").alias("v"), "step")).alias("at_lo"))
    value = F.when(F.col("how") == "max", F.col("hi")).when(F.col("how") == "min", F.col("lo")).otherwise(F.col("mid"))
    step = F.when(F.col("how") == "max", F.col("at_hi.step")).when(F.col("how") == "min", F.col("at_lo.step"))
    found = best.select("run", "metric", "how", value.alias("best"), step.alias("step"))
    mean = rows.alias("r").join(found.where("how = 'mean'").alias("b"), ["run", "metric"]).where("r.value = b.best").groupBy("run", "metric").agg(F.min("r.step").alias("mean_step"))
    return found.join(mean, ["run", "metric"], "left").select("run", "metric", "best", F.coalesce("step", "mean_step", F.lit(-1).cast("long")).alias("step"))


def early_stop(runlog: DataFrame, patience: int, threshold: float = 0.0, mode: str = "max") -> DataFrame:
    """Per run the first step at which more than ``patience`` steps in a row did not improve; null if none.

    The first value is the baseline; only a value beyond the best by more than ``threshold`` improves. With threshold 0
    the best is the running extreme, so windows do; else a run's steps are folded in order.
    """
    sign = 1.0 if mode == "max" else -1.0
    if threshold == 0:
        order = Window.partitionBy("run").orderBy("step")
        before = F.max("v").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = runlog.select("run", "step", (F.col("value") * sign).alias("v"))
        rows = rows.withColumn("better", before.isNull() | (F.col("v") > before)).withColumn("i", F.row_number().over(order))
        last = F.max(F.when(F.col("better"), F.col("i"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("bad", F.col("i") - last)
        return rows.groupBy("run").agg(F.min(F.when(F.col("bad") > patience, F.col("step"))).alias("stop"))
    import pandas as pd

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        best, bad, stop = None, 0, None
        for step, v in zip(pdf.sort_values("step")["step"], pdf.sort_values("step")["value"] * sign):
            if best is None or v > best + threshold:
                best, bad = v, 0
            elif (bad := bad + 1) > patience:
                stop = int(step)
                break
        return pd.DataFrame({"run": [key[0]], "stop": pd.array([stop], dtype="Int64")})

    return runlog.select("run", "step", "value").groupBy("run").applyInPandas(fold, "run long, stop long")


def monitor_report(readings: DataFrame, *keys: str) -> DataFrame:
    """Mean of rates, greatest of levels; NaN where a report has no reading."""
    nan = F.lit(float("nan"))
    return readings.groupBy(*keys).agg(F.coalesce(F.avg("rate"), nan).alias("mean_rate"), F.coalesce(F.max("level"), nan).alias("max_level"))
