"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest: (digest, keep_id).  New rows are
reduced to one row for each digest, written out, and the digests that the index lacks are found with a
sort-merge anti-join and appended, one file for each bucket and batch.  The index side is read bucket by
bucket and never shuffled; a bucket of several files is sorted again when it is read, one of a single file is in order.
A batch that runs again finds its own digests with the same keep_id, so replays change nothing.
The number of buckets is the index's own; ``buckets_for`` gives it for the digests it is to hold.

Texts are equal when identical after each run of ASCII white space is replaced by one
space.  Only digests move: texts are read once and never shuffled, except in ``keep``, which moves whole rows once.

Defined results: null text is empty; of equal texts the smallest doc_id stays (null ids
come after all others); repeated rows keep their row in ``annotate``; in ``keep`` one row of each
text stays: of several rows with its smallest id the one whose columns come first in order; an empty
table gives no rows; extra columns never take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

BUCKETS = 32
#: Digests of a bucket: about 160 MB.
BUCKET_ROWS = 4_000_000
#: A group with more than this part of all rows is joined by broadcast; there are at most 1 / HOT of them.
HOT = 0.001


def normalized(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), common.SPACE_RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): the SHA-256 of each normalised text, 32 bytes."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.unhex(F.sha2(normalized(docs[text_col]), 256)).alias("digest"))


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold so many digests: a power of two, 65,536 at most."""
    return min(1 << 16, max(BUCKETS, 1 << (max(0, rows) // BUCKET_ROWS).bit_length()))


class DigestIndex:
    """A bucketed table of the digests kept so far.

    ``name`` is a table of the session's catalog; with ``path`` the files lie there and the
    table is defined over them again by any later session.
    """

    def __init__(self, spark: SparkSession, name: str, *, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            where = f" LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{where}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, batch: DataFrame) -> None:
        """Add the digests of (doc_id, digest) rows that the index lacks, each with its smallest doc_id."""
        # written out first: Catalyst would move the join below the aggregate and shuffle every row of a hot digest
        first = common.persist_table(batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
        # an append may not read the table it writes, so the new rows are cut off as well
        new = common.persist_table(first.join(self.table().select("digest").hint("merge"), "digest", "left_anti").select("digest", "keep_id"))
        new.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def annotate(self, batch: DataFrame) -> DataFrame:
        """(doc_id, digest, keep_id, group_size, kept) for every row of a batch that has been appended.

        ``group_size`` counts the batch's rows.  Rows of small groups meet their group in a
        shuffled join; the at most 1 / HOT groups above that share of all rows are broadcast.
        """
        groups = common.persist_table(batch.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")).join(self.table().hint("merge"), "digest"))
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        limit = max(1, int(total * HOT))
        hot = groups.where(F.col("group_size") > limit).select(F.col("digest").alias("hot_digest"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
        marked = batch.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left").drop("hot_digest")
        big = marked.where("hot_size is not null").select("doc_id", "digest", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size"))
        rest = marked.where("hot_size is null").select("doc_id", "digest").join(groups.where(F.col("group_size") <= limit), "digest")
        out = big.unionByName(rest)
        return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, index: DigestIndex, *, batches: int = 1) -> DataFrame:
    """Append the documents to the index in ``batches`` ascending ranges of doc_id, then annotate every row."""
    rows = common.persist_table(digests(docs))
    cuts = rows.approxQuantile("doc_id", [n / batches for n in range(1, batches)], 0.01) if batches > 1 else []
    low = None
    for high in [*cuts, None]:
        part = F.lit(True)
        if low is not None:
            part = part & ((F.col("doc_id") >= int(low)) | F.col("doc_id").isNull() & F.lit(high is None))
        if high is not None:
            part = part & (F.col("doc_id") < int(high))
        index.append_new(rows.where(part))
        low = high
    return index.annotate(rows)


def keep(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, all their columns, one row for each text."""
    digest, row_id, row = common.unused(docs, "digest", "id", "row")
    kept = dedup(docs, index).where("kept").select(F.col("digest").alias(digest), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(row_id)).distinct()
    rows = docs.select(
        F.unhex(F.sha2(normalized(docs["text"]), 256)).alias(digest), F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("")).alias(row_id),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(row),
    )
    # repeats of a row meet before the shuffle; copies under other ids lie apart, however many there are
    rows = rows.groupBy(digest, row_id).agg(F.min(row).alias(row))
    return rows.join(kept.hint("merge"), [digest, row_id], "left_semi").select(*[F.col(row)[c].alias(c) for c in docs.columns])
