"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytebasin.llm.common import ensure_checkpoints


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node of its component.

    Each round takes the least label of a node's neighbours and then that label's own label, so that long chains halve;
    rounds end when no label changes. Only longs move, summed up before the shuffle, and every round is checkpointed.
    """
    ensure_checkpoints(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        # the label's own label may be lower by now
        jumped = hooked.join(labels.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
        after = jumped.select("node", F.least("label", F.coalesce("root", "label")).alias("label"), F.col("label").alias("hooked")).drop("hooked").checkpoint()
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was")
        if changed.isEmpty():
            return after
        labels = after
