"""Connected components as repeated joins: smallest neighbour label, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of the edges (a, b); the label is the smallest id that can be reached.

    Each round a node takes the smallest label among its own and its neighbours', then the
    label of that label, so long chains shrink by half; rounds end when no label falls.
    Every round is written to the shared folder.  No edges: no rows.
    """
    both = common.persist_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.persist_table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now is None or now == total:
            return labels
        total = now
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "label")
        near = heard.unionByName(labels).groupBy("id").agg(F.min("label").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        labels = common.persist_table(near.join(up, "label").select("id", F.least("above", "label").alias("label")))
