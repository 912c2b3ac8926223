"""A training corpus from raw documents: quality, toxicity, exact and near deduplication, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return whole rows of ``documents``.  A stage's input is Parquet, so what it reads twice is a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import common, exact_dedup, minhash, packing, quality, toxicity
from linkloom.llm.queries import fresh_index, vocabulary

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the text's pairwise quality score reaches the cut.

    Null text is empty, and judged as such; rows are judged one by one, so equal rows and rows of one or no id share
    nothing but what their texts score; an empty table gives no rows; other columns pass through, whatever their names.
    """
    return quality.keep(docs, quality.train(docs, common.read_table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the classifier does not call the text toxic; odd input as in the quality stage."""
    return toxicity.keep(docs, toxicity.train(docs, common.read_table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text, the one with the smallest id; null text is empty, null ids come last."""
    return exact_dedup.keep(docs, fresh_index(docs, sf_dir, "pipeline"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (similarity 0.8 on five-word shingles); texts without words all stay."""
    return minhash.keep(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences; null text is empty and is its end id alone, rows are packed one by one."""
    return packing.digest(packing.pack(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written as Parquet and read again."""
    docs = common.read_table(spark, sf_dir, "documents")
    folder = common.shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
