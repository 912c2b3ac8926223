"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes (doc_id, source, lang, tokenizer_version, n_tokens, op) is one of

    insert   a document's count under a version that has none yet      +1 document, +n tokens
    delete   the document leaves that version                          -1 document, -old tokens
    revise   a new count, source or language                           -old row, +new row

Old values come from the ledger, the latest row of each (doc_id, tokenizer_version), so a
delete or a revision need only name the document.  A batch turns into deltas
(source, lang, tokenizer_version, d_docs, d_tokens), pre-aggregated before the shuffle and
written with the new ledger rows in a folder named after the batch.  Totals are the
sum of all committed deltas, so they are additive and order-free.  A batch is committed by
the last file it writes; a batch id that is already committed is skipped, an uncommitted folder is
overwritten, so a batch that is replayed or broken off counts once.  Every ``COMPACT_EVERY`` batches the ledger and the deltas
are summed up in a snapshot; a commit reads the last snapshot and the batches since, not the whole history.
A document's counts are the numbers of ids that public vocabularies give its whole text, one version for each.

Defined results: null source or language is a group of its own; a null count is 0; a null doc_id is a
document like others; of several rows for a (doc_id, tokenizer_version) in a batch the largest ``seq`` counts
(ties: larger n_tokens, then op, source, lang in descending order); deleting what is absent
changes nothing; inserting what is present is a revision; a group that falls to zero documents is left out;
empty batches commit and change nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

KEY = ["doc_id", "tokenizer_version"]
GROUP = ["source", "lang", "tokenizer_version"]
_LEDGER = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, alive boolean, batch long"
_DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long, batch long"
#: Batches between snapshots.
COMPACT_EVERY = 16
#: Chunks that a worker remembers for each vocabulary.
CACHED_CHUNKS = 400_000
_CHANGE = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, op string, seq long"


def _counts(batches: Iterator[pa.RecordBatch], versions: dict[str, str], op: str, seq: int) -> Iterator[pa.RecordBatch]:
    from .chunked_tokens import encoder

    common.take_over("token_counts")
    for given in batches:
        for low in range(0, given.num_rows, 4096):
            part = given.slice(low, 4096)
            for version, path in versions.items():
                counts = encoder(path, "<u4", CACHED_CHUNKS).count(part.column(3))
                n = part.num_rows
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array([version] * n), pa.array(counts, pa.int64()), pa.array([op] * n), pa.array([seq] * n, pa.int64())], names=[x.split()[0] for x in _CHANGE.split(", ")])


def counted(docs: DataFrame, versions: dict[str, str], op: str = "insert", seq: int = 0) -> DataFrame:
    """One change for each document and version (name: path of a tokenizers file), from one read of the texts (null: empty)."""
    common.ship(docs.sparkSession)

    def run(batches):
        from linkloom.llm.token_counts import _counts

        return _counts(batches, versions, op, seq)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _CHANGE)


class TokenRollup:
    """The ledger and the deltas under ``path`` (a folder every executor reaches)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or common.shared_dir(spark)).rstrip("/")

    def _fs(self):
        jvm, path = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marks(self, kind: str) -> list[int]:
        jvm, fs = self._fs()
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(marks)) if fs.exists(marks) else []

    def _mark(self, kind: str, batch: int) -> None:
        jvm, fs = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{batch}"), True).close()

    def committed(self) -> list[int]:
        """Ids of the committed batches, ascending."""
        return self._marks("commits")

    def _read(self, kind: str, schema: str) -> DataFrame:
        done, last = self.committed(), self._marks("snapshots")[-1:]
        paths = [f"{self.path}/{kind}/snapshot-{n}" for n in last] + [f"{self.path}/{kind}/batch-{n}" for n in done if not last or n > last[0]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> None:
        """Sum up what is committed in a snapshot; one that was broken off is written again, and read only when it is marked."""
        done = self.committed()
        if done and done[-1] not in self._marks("snapshots"):
            n = done[-1]
            self.ledger().withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{self.path}/ledger/snapshot-{n}")
            sums = self.totals().select(*GROUP, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"), F.lit(n).cast("long").alias("batch"))
            sums.write.mode("overwrite").parquet(f"{self.path}/deltas/snapshot-{n}")
            self._mark("snapshots", n)

    def ledger(self) -> DataFrame:
        """The latest row of each document and version; deleted ones have alive = false."""
        rows = self._read("ledger", _LEDGER)
        value = F.struct("batch", "source", "lang", "n_tokens", "alive")
        return rows.groupBy(*KEY).agg(F.max(value).alias("v")).select(*KEY, "v.source", "v.lang", "v.n_tokens", "v.alive")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens): the sum of the committed deltas."""
        sums = self._read("deltas", _DELTA).groupBy(*GROUP).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        order = F.struct(F.col("seq"), F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n_tokens"), "op", "source", "lang")
        last = changes.select("doc_id", "tokenizer_version", "seq", "n_tokens", "op", "source", "lang").groupBy(*KEY).agg(F.max(order).alias("new"))
        if done:
            old = self.ledger().where("alive").select(F.col("doc_id").alias("o_id"), F.col("tokenizer_version").alias("o_version"), F.struct("source", "lang", "n_tokens").alias("old"))
            same = last["doc_id"].eqNullSafe(old["o_id"]) & last["tokenizer_version"].eqNullSafe(old["o_version"])
            both = last.join(old, same, "left")
        else:
            both = last.withColumn("old", F.lit(None).cast("struct<source:string,lang:string,n_tokens:bigint>"))
        gone = F.col("new.op") == "delete"
        both = both.where(~gone | F.col("old").isNotNull())
        row = F.when(gone, F.struct("old.source", "old.lang", "old.n_tokens")).otherwise(F.struct("new.source", "new.lang", "new.n_tokens"))
        ledger = both.select(*KEY, row.alias("r"), (~gone).alias("alive"), "old")
        ledger = ledger.select(*KEY, "r.source", "r.lang", "r.n_tokens", "alive", F.lit(batch).cast("long").alias("batch"), "old")
        ledger.write.mode("overwrite").parquet(f"{self.path}/ledger/batch-{batch}")
        rows = self.spark.read.schema(_LEDGER + ", old struct<source:string,lang:string,n_tokens:bigint>").parquet(f"{self.path}/ledger/batch-{batch}")

        def signed(sign: int, source, lang, tokens):
            return F.struct(source.alias("source"), lang.alias("lang"), F.lit(sign).cast("long").alias("d_docs"), (sign * tokens).alias("d_tokens"))

        parts = F.array(
            F.when(F.col("alive"), signed(1, F.col("source"), F.col("lang"), F.col("n_tokens"))),
            F.when(F.col("old").isNotNull(), signed(-1, F.col("old.source"), F.col("old.lang"), F.col("old.n_tokens"))),
        )
        deltas = rows.select("tokenizer_version", F.explode(parts).alias("d")).where("d is not null").select("d.source", "d.lang", "tokenizer_version", "d.d_docs", "d.d_tokens")
        deltas = deltas.groupBy(*GROUP).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).withColumn("batch", F.lit(batch).cast("long"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/deltas/batch-{batch}")
        self._mark("commits", batch)
        if len(done) % COMPACT_EVERY == COMPACT_EVERY - 1:
            self.compact()
        return True
