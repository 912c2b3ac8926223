"""The registered queries of this package and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, common, exact_dedup, fingerprint, huffman, lm, minhash, packing, quality, token_counts, toxicity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_paragraph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(common.read_table(spark, sf_dir, "documents"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(common.read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op4_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.read_table(spark, sf_dir, "documents"), percent=85)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(common.read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(common.read_table(spark, sf_dir, "documents"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


def op8_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = common.shared_dir(spark)
    huffman.write(common.read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), target)
    return huffman.read(spark, target, with_ids=False)


def fresh_index(docs: DataFrame, sf_dir: str, use: str) -> exact_dedup.DigestIndex:
    """An empty index for a whole-table query; one table for each input and use, made anew, with buckets for all its rows."""
    spark = docs.sparkSession
    name = f"digests_{use}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return exact_dedup.DigestIndex(spark, name, path=f"{common.shared_dir(spark)}/{name}", buckets=exact_dedup.buckets_for(docs.count()))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    rows = exact_dedup.dedup(docs, fresh_index(docs, sf_dir, "op9"), batches=2)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over the whole table, the second one replayed.

    1: every document's count by the word vocabulary is inserted.  2: every document's count by the byte-level vocabulary is
    inserted, and documents in other languages than English leave the word vocabulary.  3: what is left there
    is revised: one more id each, the end id that goes between documents.
    """
    return rolled_up(token_counts.TokenRollup(spark), common.read_table(spark, sf_dir, "documents"))


def rolled_up(rollup: token_counts.TokenRollup, docs: DataFrame) -> DataFrame:
    words, pieces = "word_bpe_49k", "byte_bpe_50k"
    both = common.persist_table(token_counts.counted(docs, {name: vocabulary(f"{name}.json") for name in (words, pieces)}))
    first = both.where(F.col("tokenizer_version") == words)
    other = F.coalesce(F.col("lang") != "en", F.lit(False))
    second = both.where(F.col("tokenizer_version") == pieces).unionByName(first.where(other).withColumn("op", F.lit("delete")))
    rollup.commit(1, first)
    rollup.commit(2, second)
    rollup.commit(2, second)
    rollup.commit(3, first.where(~other).withColumns({"op": F.lit("revise"), "n_tokens": F.col("n_tokens") + 1}))
    return rollup.totals()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_paragraph_fingerprints": op1_paragraph_fingerprints,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_toxicity": op3_toxicity,
    "op4_minmax_near_duplicates": op4_minmax_near_duplicates,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_elias_fano_lm": op6_elias_fano_lm,
    "op7_pairwise_quality": op7_pairwise_quality,
    "op8_huffman_token_files": op8_huffman_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_rollup": op10_token_rollup,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op9_exact_dedup": OP9_SQL}
