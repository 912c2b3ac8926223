"""What the operators share: reading tables, the shared folder, shipping the package to executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..shipping import ship as ship

#: ASCII white space as the contracts spell it, for Java and RE2 regular expressions.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's layout; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local default only in local mode (tests), an error on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints/linkloom"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/linkloom-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null text as empty, whatever else the input carries."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def unused(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for further columns that clash with none of the documents', whatever case they are told apart by."""
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        names.append(name)
        taken.add(name.lower())
    return names


def crc_mod(id_col, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a document (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


_owner: str | None = None


def take_over(owner: str) -> None:
    """Called in a Python worker when an operator's task begins: what another operator remembered there is dropped.

    Workers are reused, and the dictionaries of one operator are dead weight beside the next.
    """
    global _owner
    if _owner not in (None, owner):
        import gc
        import sys

        for name, attribute in (("chunked_tokens", "encoder"), ("bpe", "codec")):
            module = sys.modules.get(f"linkloom.llm.{name}")
            if module:
                getattr(module, attribute).cache_clear()
        if "linkloom.llm.toxicity" in sys.modules:
            sys.modules["linkloom.llm.toxicity"]._cache = {}
        gc.collect()
        pool = sys.modules["pyarrow"].default_memory_pool() if "pyarrow" in sys.modules else None
        if pool:
            pool.release_unused()
    _owner = owner


def schema(**kinds) -> StructType:
    named = {"long": LongType(), "string": StringType(), "binary": BinaryType()}
    return StructType([StructField(name, named.get(kind, kind)) for name, kind in kinds.items()])
