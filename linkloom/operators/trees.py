"""Folder trees as tables of leaves: counts, depth limit, small and oversized leaves, quality, conservation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import lexicon


def rollup_counts(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """Records under every node of the levels, the root included: one pass with a rollup."""
    depth = sum((1 - F.grouping(c) for c in levels), F.lit(0))
    return leaves.rollup(*levels).agg(F.count(F.lit(1)).alias("records"), depth.cast("int").alias("depth"))


def limit_depth(leaves: DataFrame, levels: list[str], depth: int) -> DataFrame:
    """Records by the path cut at ``depth`` levels."""
    return leaves.groupBy(F.concat_ws("/", *levels[:depth]).alias("path")).agg(F.count(F.lit(1)).alias("records"))


def pull_up_small(leaves: DataFrame, parent: str, leaf: str, threshold: int = 5) -> DataFrame:
    """Leaves of at most ``threshold`` records go up to their parent (leaf name empty); where all are small the largest stays."""
    counts = leaves.groupBy(parent, leaf).agg(F.count(F.lit(1)).alias("records"))
    w = Window.partitionBy(parent)
    counts = counts.withColumns({"largest": F.row_number().over(w.orderBy(F.col("records").desc(), leaf)), "big": F.max(F.when(F.col("records") > threshold, 1).otherwise(0)).over(w)})
    stays = (F.col("records") > threshold) | ((F.col("big") == 0) & (F.col("largest") == 1))
    return counts.select(parent, F.when(stays, F.col(leaf)).otherwise("").alias("leaf"), "records").groupBy(parent, "leaf").agg(F.sum("records").alias("records"))


def split_oversized(leaves: DataFrame, leaf: str, kind: str, limit: int = 40, least: int = 3) -> DataFrame:
    """Leaves of ``limit`` or more records part by kind when two kinds have ``least`` records; smaller kinds become 其他."""
    counts = leaves.groupBy(leaf, kind).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(leaf)
    counts = counts.withColumns({"size": F.sum("n").over(w), "large": F.sum(F.when(F.col("n") >= least, 1).otherwise(0)).over(w)})
    parted = (F.col("size") >= limit) & (F.col("large") >= 2)
    name = F.when(~parted, F.lit("")).when(F.col("n") >= least, F.col(kind)).otherwise(lexicon.OTHER)
    return counts.groupBy(leaf, name.alias("part")).agg(F.sum("n").alias("records"))


def quality(nodes: DataFrame, leaf_flag: str = "is_leaf", oversized: int = 40, records: str = "records") -> DataFrame:
    """One row: folders, leaves, leaves of one record, the deepest level, the largest leaf, oversized leaves."""
    leaf = F.col(leaf_flag)
    return nodes.agg(
        F.count(F.lit(1)).alias("folders"), F.count_if(leaf).alias("leaves"), F.count_if(leaf & (F.col(records) == 1)).alias("singletons"),
        F.max("depth").alias("max_depth"), F.max(F.when(leaf, F.col(records))).alias("max_leaf"), F.count_if(leaf & (F.col(records) >= oversized)).alias("oversized"),
    )


def conservation(source: DataFrame, shown: DataFrame, key: str = "id") -> DataFrame:
    """One row: source records, records missing from what is shown, rows shown again; and whether both are zero."""
    counts = shown.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = source.select(key).distinct().join(counts, key, "full_outer")
    one = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.sum(F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))).alias("repeated"), F.count(F.lit(1)).alias("records"))
    return one.withColumn("passed", (F.col("missing") == 0) & (F.col("repeated") == 0))


def bundles(candidates: DataFrame, least: int = 3) -> DataFrame:
    """Each record under its first label that at least ``least`` records share, as (root, label, priority, records); most records first, then priority, then label.

    Candidates are (id, root, position, label, priority); records without such a label are left out.
    """
    support = candidates.groupBy("root", "label").agg(F.count_distinct("id").alias("support"), F.max("priority").alias("priority")).where(F.col("support") >= least)
    fitting = candidates.select("id", "root", "label", "position").join(support.select("root", "label"), ["root", "label"], "left_semi")
    chosen = fitting.groupBy("id", "root").agg(F.min_by("label", "position").alias("label")).groupBy("root", "label").agg(F.count(F.lit(1)).alias("records"))
    return chosen.join(support.select("root", "label", "priority"), ["root", "label"]).orderBy(F.col("records").desc(), F.col("priority").desc(), "label")
