"""Incremental fetch results: micro-batches upserted into a cache by key, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.health import cache_priority
from ..operators.skew import shared_folder, written


def upsert(cache: DataFrame | None, batch: DataFrame, key: str = "user_id") -> DataFrame:
    """The best row for each key of cache and batch: priority, then the latest ``ord``.  Applying a batch twice changes nothing."""
    both = batch if cache is None else cache.unionByName(batch)
    value = F.struct(cache_priority(F.col("status"), F.col("status") != "success").alias("priority"), "ord", "status")
    return both.groupBy(key).agg(F.max(value).alias("v")).select(key, "v.status", "v.ord")


def latest_cache(spark: SparkSession, path: str, *, files_per_batch: int = 1, buckets: int = 16) -> DataFrame:
    """The cache after a stream over the attempts at ``path`` has been read to its present end.

    The cache lies in buckets of its key.  A batch rewrites the buckets that it touches, each under the batch's number, and reads for each the
    newest version of a batch before it; so a batch that is run again gives the same files, and a restart from the checkpoint the same cache.
    """
    base = shared_folder(spark, "fetch")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path if not path.endswith(".parquet") else path + "*")
    kind = F.col("event_id") % 7
    status = F.when(kind == 0, "timeout").when(kind == 1, "broken").when(kind == 2, "skipped").when(kind == 3, "error").otherwise("success")
    rows = stream.select("user_id", status.alias("status"), F.col("event_id").alias("ord"))
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("bucket")
    newest: dict[int, int] = {}

    def files(numbers: dict[int, int]) -> list[str]:
        return [f"{base}/batch-{n}/bucket={b}" for b, n in sorted(numbers.items())]

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        best = written(upsert(None, batch))
        touched = [r["bucket"] for r in best.select(bucket).distinct().collect()]  # as many as there are buckets
        before = {b: newest[b] for b in touched if b in newest and newest[b] < number}
        known = session.read.schema("user_id long, status string, ord long").parquet(*files(before)) if before else None
        upsert(known, best).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/batch-{number}")
        newest.update(dict.fromkeys(touched, number))

    query = rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id long, status string, ord long").parquet(*files(newest))
