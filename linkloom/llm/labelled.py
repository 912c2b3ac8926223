"""The bounded labelled sample that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common

#: Labelled rows that a classifier is fitted on, at most; counts and scores cover all rows.
SAMPLE_ROWS = 6000
#: Characters of sampled texts that reach the driver, at most; the longest texts of the sample are left out.
SAMPLE_CHARS = 40_000_000
FOLDS = 5
HELD_OUT = 0


def held_out(id_col):
    return common.crc_mod(id_col, FOLDS) == HELD_OUT


def marks(labels: DataFrame, label: str) -> DataFrame:
    """(k, y) of every labelled document outside the held-out fold; null labels don't count, of several labels the largest does."""
    rows = labels.select(labels["doc_id"].cast("long").alias("k"), labels[label].cast("int").alias("y")).where("k is not null and y is not null")
    return rows.where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out fold.

    The rows with the smallest hash of their id among the documents that have a label; null labels don't count; of
    several labels of a document the largest does.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("k")).where("k is not null").distinct()
    chosen = marks(labels, label).join(ids, "k").orderBy(F.xxhash64("k"), "k").limit(rows)
    found = common.id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("k"))
    found = common.persist_table(found.groupBy("k").agg(F.min("text").alias("text"), F.max("y").alias("y")))
    # lengths alone decide what the driver gets, shortest texts first
    kept, total = [], 0
    for r in sorted(found.select("k", F.length("text").alias("n")).collect(), key=lambda r: (r["n"], r["k"])):  # at most ``rows`` pairs
        total += r["n"]
        if total > SAMPLE_CHARS:
            break
        kept.append(r["k"])
    got = sorted(found.where(F.col("k").isin(kept)).select("k", "text", "y").toLocalIterator(), key=lambda r: r["k"])
    return [r["text"] for r in got], [r["y"] for r in got]
