"""Rows of frequent keys dealt out in parts, so that no task gets all rows of a key; and ranked counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Keys with more than this part of all rows learn their number of parts by broadcast; there are at most 1 / HOT of them.
HOT = 0.001


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local default in local mode alone (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints/linkloom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows from a file in the shared folder, so that they are made once and survive a lost executor."""
    path = shared_folder(df.sparkSession, "stage")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_parts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with ``parts``: how many parts of about ``size`` rows their key's rows make."""
    counts = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    limit = max(size, int((counts.agg(F.sum("__n")).first()[0] or 0) * HOT))
    wanted = lambda name: F.ceil(F.col("__n") / size).cast("int").alias(name)
    hot = counts.where(F.col("__n") > limit).select(key, wanted("__hot"))
    some = counts.where((F.col("__n") <= limit) & (F.col("__n") > size)).select(key, wanted("__some"))
    marked = rows.join(F.broadcast(hot), key, "left")
    big = marked.where("__hot is not null").withColumnRenamed("__hot", "parts")
    rest = marked.where("__hot is null").drop("__hot").join(some, key, "left").withColumn("parts", F.coalesce("__some", F.lit(1))).drop("__some")
    return big.unionByName(rest)


def pairs_within(rows: DataFrame, key: str, id_col: str = "id", size: int = 2000, carry: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, of ids that share a key, each pair once.

    A key's ids are dealt out in parts and parts meet two by two, so a task gets at most ``size`` ids of either side.  A pair comes from the
    first key that it shares, so pairs are never shuffled to make them distinct.  Keys are numbered, which keeps their lists short.
    ``carry`` (id and further columns) adds these columns of both sides, as c_a and c_b: ids travel once for each key and part, pairs not at all.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(key).alias("key")).distinct()
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.monotonically_increasing_id().alias("number")))
    rows = written(rows.join(shared, "key").select("id", F.col("number").alias("key")))
    before = rows.join(rows.groupBy("id").agg(F.collect_list("key").alias("keys")), "id").select("id", "key", F.filter("keys", lambda k: k < F.col("key")).alias("before"))
    dealt = with_parts(before, "key", size).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    more = [] if carry is None else [c for c in carry.columns if c != "id"]
    dealt = dealt if carry is None else dealt.join(carry, "id")
    met = dealt.select("key", "id", "before", "part", *more, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("key", "id", "before", "part", *more, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    x, y = met.alias("x"), met.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "i", "j")]
    apart = (F.col("x.i") == F.col("x.j")) | (F.col("x.part") != F.col("y.part"))
    first = ~F.arrays_overlap("x.before", "y.before")
    both = x.join(y, same[0] & same[1] & same[2] & apart & (F.col("x.id") < F.col("y.id")) & first)
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *[F.col(f"{side}.{c}").alias(f"{c}_{end}") for side, end in ("xa", "yb") for c in more])


def numbered(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, number, before) of rows (id, key), and (key, n, number) of the keys: numbered by falling size, without single records and without keys all of whose ids share a larger key."""
    rows = rows.select("id", F.col(key).alias("key")).distinct()
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts.orderBy(F.col("n").desc(), "key").select("key", "n", F.monotonically_increasing_id().alias("number")))
    rows = written(rows.join(counts.select("key", "number"), "key").select("id", "number"))
    lists = rows.groupBy("id").agg(F.collect_list("number").alias("numbers"))
    earlier = rows.join(lists, "id").select("number", F.explode(F.filter("numbers", lambda k: k < F.col("number"))).alias("larger"))
    covered = written(earlier.groupBy("number", "larger").agg(F.count(F.lit(1)).alias("n")).join(counts.select("number", "n"), ["number", "n"]).select("number").distinct())
    rows = written(rows.join(covered, "number", "left_anti"))
    lists = rows.groupBy("id").agg(F.collect_list("number").alias("numbers"))
    return rows.join(lists, "id").select("id", "number", F.filter("numbers", lambda k: k < F.col("number")).alias("before")), counts.join(covered, "number", "left_anti")


def _spread(rows: DataFrame, blocks: Column, counts: DataFrame, least: int) -> int:
    """Partitions for the blocks of keys of more than ``least`` records."""
    large = counts.where(F.col("n") > least).agg(F.sum(blocks)).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4000, 2 * int(large)))


def blocks_within(rows: DataFrame, key: str, carry: DataFrame, size: int = 2000) -> DataFrame:
    """(number, i, j, part, id, before, ...): the ids of parts i and j of each key, dealt out as in `pairs_within`, with the columns of ``carry``; a block's rows lie in one partition.

    Pairs of a block are a, b of different parts, or of one part where i = j, whose ``before`` have nothing in common; each pair that shares a
    key is in one block.  Keys are numbered by falling size.  A key all of whose ids share a larger key adds no pair and is left out.
    """
    rows, counts = numbered(rows, key)
    dealt = with_parts(rows, "number", size).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).join(carry, "id")
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    parts = F.ceil(F.col("n") / size)
    return met.drop("parts", "other").repartition(_spread(rows, parts * (parts + 1) / 2, counts, size // 4), "number", "i", "j")


#: Rows of a key that are packed and unpacked together, at most; a part of a key has up to STRIP such chunks, and no more than gives it STRIPS parts.
CHUNK, STRIP, STRIPS = 6000, 5, 6


def compared(rows: DataFrame, key: str, carry: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """What ``run`` gives for the blocks of `blocks_within`.

    A record travels once for each part of its key, so records of a key of several parts are packed, with codes for words: parts can be
    large, as a task unpacks two chunks of them at a time (`kernel.blocks`), and a copy of a record takes a fraction of its columns.
    """
    rows, counts = numbered(rows, key)
    most, least = counts.agg(F.max("n"), F.min("n")).first()
    size = min(chunk, max(2000, -(-(most or 0) // STRIPS)))
    dealt = written(with_parts(rows, "number", size))
    few, many = dealt.where("parts = 1").drop("parts").join(carry, "id"), dealt.where("parts > 1").join(carry, "id")
    out = few.withColumns({x: F.lit(0) for x in ("i", "j", "part")}).repartition(_spread(rows, F.lit(1), counts, size // 4), "number", "i", "j").groupBy("number", "i", "j").applyInArrow(run, schema)
    if (most or 0) <= size:
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from linkloom.operators import kernel

        return kernel.packed(batches)

    strip = F.least(F.lit(STRIP), F.ceil(F.col("parts") / STRIPS)).cast("int")
    chunks = many.withColumn("chunk", F.pmod(F.xxhash64("id"), "parts").cast("int")).groupBy("number", "chunk", "parts").applyInArrow(pack, "number long, chunk int, parts int, packed binary")
    chunks = chunks.withColumns({"part": F.floor(F.col("chunk") / strip).cast("int"), "last": F.floor((F.col("parts") - 1) / strip).cast("int")})
    met = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).select("number", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "chunk", "packed")
    parts = F.ceil(F.col("n") / size)
    parts = F.ceil(parts / F.least(F.lit(STRIP), F.ceil(parts / STRIPS)))
    blocks = met.repartition(_spread(rows, parts * (parts + 1) / 2, counts, size), "number", "i", "j").groupBy("number", "i", "j").applyInArrow(run, schema)
    return blocks if least > size else out.unionByName(blocks)


def top(rows: DataFrame, key: str, value: Column, *, at: Column | None = None, weight: Column | None = None, order: list[Column] | None = None, limit: int | None = None, name: str = "top") -> DataFrame:
    """(key, name): the values of each key with their weights, largest first, as an array of (value, n, share).

    Ties go by ``order`` (on the column ``value``) if it is given, else by the first appearance ``at``.  Values that are null or blank
    are left out; shares are of the weights of all values.  Counts are combined before the shuffle.
    """
    w = F.lit(1) if weight is None else weight
    rows = rows.select(key, value.alias("value"), w.alias("w"), (F.lit(0) if at is None else at).alias("at")).where("value is not null and value <> ''")
    counts = rows.groupBy(key, "value").agg(F.sum("w").alias("n"), F.min("at").alias("at"))
    by = Window.partitionBy(key)
    ranked = counts.withColumns({"rank": F.row_number().over(by.orderBy(F.col("n").desc(), *(order or [F.col("at")]), "value")), "share": F.bround(F.col("n") / F.sum("n").over(by), 4)})
    if limit:
        ranked = ranked.where(F.col("rank") <= limit)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n", "share"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"), x["share"].alias("share")))
    return ranked.groupBy(key).agg(cells.alias(name))
