"""Near-duplicate documents by min-max hashing of word shingles.

Each hash function keeps both the smallest and the largest value over a document's
shingles, so ``2 * H`` signature values cost H evaluations; each agrees for two documents with
the probability of their Jaccard similarity.  Bands of ``ROWS`` values are looked up; the number of bands
follows from the similarity asked for, so that a pair exactly at it is missed in every band with
probability below ``MISS``.  Links are confirmed on the full shingle sets.

1. Documents with equal shingle sets form a class with a number of its own; its smallest doc_id stands for it.
2. Classes that share a band meet the bucket's class that shares most bands with others, the pivot; the exact
   similarity to the pivot is computed for each.  Links give first components.  A pivot with many
   members is sent to as many groups of ``FAN`` members, so no task gets them all.
3. What else shares a pivot can link only across components. Under one order of a pivot's
   shingles (those the pivot lacks first, then by hash) two linked sets share one of their first
   n - ceil(similarity * n) + 1 shingles, at places that leave room for the overlap they need.
   Members outside the pivot's component are joined with all members on these
   shingles; near variants mostly have shingles of their own there, so few pairs are left, and none is lost.
4. Components are joined from all confirmed links.

So a bucket of m classes emits m - 1 pairs, and pairs within it only where neither the components nor
the prefixes settle them.  Nothing is capped.  Shingles are compared by 40 bits of their
hash (a chance of 1e-6 that two sets of a thousand seem to share one more than they do); a set's repeats of
such a shortened hash count once on both sides.

Defined results: null text is empty; an empty set has size 0, is linked with nothing and is its own
component; a text of fewer words than a shingle has one shingle, the whole sequence; equal
sets are linked; a null doc_id is a document without links; rows of one doc_id with different texts are documents of
their own that share an id; repeated rows repeat; an empty table gives no rows.  ``keep`` decides on rows, whatever
their ids: of each component the row with the smallest doc_id stays (null ids come last, then the row read first).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .components import components
from .shingles import WORDS, mix, odd, shingle_set

ROWS = 5
MISS = 2e-7
#: The similarity of near-duplicate stages that no contract sets, in hundredths.
SIMILARITY = 80
_SEED = 20240502
_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"
#: Bytes of a shingle's hash in a set that is sent to be compared.
WIDTH = 5
#: Members of a pivot that meet it in one group.
FAN = 256
#: Pivots with more than this part of all pairs learn their number of groups by broadcast; there are at most 1 / HOT.
HOT = 0.001
_TESTED = "a long, b long, linked boolean"
_PREFIXED = "a long, b long, n long, prefix array<long>"
#: Bits of the map of ids whose sets are wanted; a bit that is set for another id only costs work.
MAP_BITS = 1 << 24
MAP_SLOTS = 64


class MinMax:
    """The hash functions for a similarity in hundredths."""

    def __init__(self, percent: int, rows: int = ROWS, miss: float = MISS):
        share = (percent / 100) ** rows
        self.bands = math.ceil(math.log(miss) / math.log1p(-share)) if share < 1 else 1
        self.rows, self.functions = rows, -(-self.bands * rows // 2)
        rng = np.random.default_rng(_SEED)
        self.factors = odd(self.functions, rng)[:, None]
        self.offsets = rng.integers(0, 1 << 63, self.functions, dtype=np.uint64)[:, None]
        self.places, self.salts = odd(rows, rng), odd(self.bands, rng)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """min, max, min, max, ... of each function; two values for one evaluation."""
        low, high = np.full(self.functions, 2**64 - 1, np.uint64), np.zeros(self.functions, np.uint64)
        for at in range(0, len(shingles), 1024):  # an array that fits the cache, whatever the text
            values = shingles[None, at : at + 1024] * self.factors + self.offsets
            low, high = np.minimum(low, values.min(1)), np.maximum(high, values.max(1))
        return np.stack([low, high], 1).reshape(-1)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        grid = signature[: self.bands * self.rows].reshape(self.bands, self.rows)
        return mix((grid * self.places).sum(1) + self.salts).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], percent: int, words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    common.take_over("minhash")
    hashes = MinMax(percent)
    for given in batches:
        for low in range(0, given.num_rows, 1024):
            part = given.slice(low, 1024)
            sizes, digests, bands = [], [], []
            for text in part.column(1):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                if len(shingles):
                    signature = hashes.signature(shingles)
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bands.append(hashes.keys(signature))
                else:
                    digests.append(None)
                    bands.append(np.zeros(0, np.int64))
            yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])


def packed(shingles: np.ndarray) -> bytes:
    """The sorted set as WIDTH bytes each, most significant part of the hash; repeats of that part once."""
    short = shingles >> np.uint64(64 - 8 * WIDTH)
    short = short[np.r_[True, short[1:] != short[:-1]]] if len(short) else short
    return short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    cells = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(cells), 8), np.uint8)
    out[:, 8 - WIDTH :] = cells
    return out.reshape(-1).view(">u8").astype(np.int64)


def _places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(MAP_BITS)).astype(np.int64)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of a partition's ids in compressed slots."""
    import zstandard

    bits, any_ids = np.zeros(MAP_BITS, np.uint8), False
    for given in batches:
        bits[_places(given.column(0).to_numpy(zero_copy_only=False))] = 1
        any_ids = True
    if any_ids:
        slots = np.packbits(bits).reshape(MAP_SLOTS, -1)
        used = np.flatnonzero(slots.any(1))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([zstandard.compress(slots[n].tobytes(), 1) for n in used], pa.binary())], names=["slot", "map"])


def _merged(table: pa.Table) -> pa.Table:
    """One slot of all partitions' maps."""
    import zstandard

    whole = np.zeros(MAP_BITS // 8 // MAP_SLOTS, np.uint8)
    for raw in table.column("map"):
        whole |= np.frombuffer(zstandard.decompress(raw.as_py()), np.uint8)
    return pa.table({"slot": table.column("slot").slice(0, 1), "map": pa.array([whole.tobytes()], pa.binary())})


def _id_map(ids: DataFrame) -> np.ndarray:
    """One map of all ids: MAP_BITS bits on the driver, whatever their number; partitions' maps are merged by slot."""

    def run(batches):
        from linkloom.llm.minhash import _maps

        return _maps(batches)

    def merge(table):
        from linkloom.llm.minhash import _merged

        return _merged(table)

    whole = np.zeros((MAP_SLOTS, MAP_BITS // 8 // MAP_SLOTS), np.uint8)
    for row in ids.mapInArrow(run, "slot int, map binary").groupBy("slot").applyInArrow(merge, "slot int, map binary").collect():  # MAP_SLOTS rows
        whole[row["slot"]] = np.frombuffer(row["map"], np.uint8)
    return whole.reshape(-1)


def _sets(batches: Iterator[pa.RecordBatch], words: int, wanted) -> Iterator[pa.RecordBatch]:
    import xxhash

    bits = np.unpackbits(wanted.value)
    for given in batches:
        ids = given.column(0)
        keep = ids.is_valid().to_numpy(zero_copy_only=False)
        keep[keep] = bits[_places(ids.drop_null().to_numpy(zero_copy_only=False))] > 0
        texts = given.column(1).filter(pa.array(keep))
        for low in range(0, len(texts), 1024):
            found = [shingle_set(t.as_py(), words) for t in texts.slice(low, 1024)]
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()), pa.array([packed(f) for f in found], pa.binary())], names=["digest", "shingles"])


def prefix(own: np.ndarray, references: list[np.ndarray], percent: int) -> np.ndarray:
    """The first shingles of a set, those that fewest references hold first, that a linked set must share one of."""
    held = sum((np.isin(own, r, assume_unique=True).astype(np.int8) for r in references), np.zeros(len(own), np.int8))
    return own[np.lexsort((own, held))][: len(own) - -(-percent * len(own) // 100) + 1]


def _tested(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for given in batches:
        linked = []
        for x, y in zip(given.column(2), given.column(3)):
            one, two = unpacked(x.as_py()), unpacked(y.as_py())
            both = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(100 * both >= percent * (len(one) + len(two) - both))
        yield pa.record_batch([given.column(0), given.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _prefixed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for given in batches:
        sizes, firsts = [], []
        for own, references in zip(given.column(2), given.column(3)):
            mine = unpacked(own.as_py())
            sizes.append(len(mine))
            firsts.append(prefix(mine, [unpacked(r) for r in references.as_py()], percent))
        yield pa.record_batch([given.column(0), given.column(1), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], names=["a", "b", "n", "prefix"])


def _grouped(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with ``part``, (a, part) of every group): a pivot's members in groups of about ``FAN``.

    The number of a pivot's groups reaches its pairs by broadcast where it has more than ``HOT`` of all pairs.
    """
    counts = common.persist_table(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", "n", F.ceil(F.col("n") / FAN).cast("int").alias("parts")))
    limit = max(FAN, int((counts.agg(F.sum("n")).first()[0] or 0) * HOT))
    hot = counts.where(F.col("n") > limit).select("a", F.col("parts").alias("hot_parts"))
    some = counts.where((F.col("n") <= limit) & (F.col("parts") > 1)).select("a", F.col("parts").alias("some_parts"))
    marked = pairs.join(F.broadcast(hot), "a", "left")
    big = marked.where("hot_parts is not null").withColumnRenamed("hot_parts", "parts")
    rest = marked.where("hot_parts is null").drop("hot_parts").join(some, "a", "left").withColumn("parts", F.coalesce("some_parts", F.lit(1))).drop("some_parts")
    out = big.unionByName(rest).withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int")).drop("parts")
    return out, counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _test(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b) on full sets."""

    def test(batches):
        from linkloom.llm.minhash import _tested

        return _tested(batches, percent)

    # no bound is known for any side, so none is broadcast
    pairs, groups = _grouped(pairs)
    left = groups.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")).hint("merge")
    joined = pairs.join(right, "b").join(left.hint("merge"), ["a", "part"]).select("a", "b", "set_a", "set_b")
    return common.persist_table(joined.mapInArrow(test, _TESTED))


def _with_prefixes(spokes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n, prefix) of members b around pivots a, in the order of the pivot's references."""

    def run(batches):
        from linkloom.llm.minhash import _prefixed

        return _prefixed(batches, percent)

    others = spokes.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y"), F.min_by("b", F.xxhash64("b")).alias("z"))
    chosen = others.select("a", F.explode(F.array_distinct(F.array("a", "x", "y", "z"))).alias("id"))
    references = chosen.join(sets.hint("merge"), "id").groupBy("a").agg(F.collect_list("shingles").alias("references"))  # four at most
    members, groups = _grouped(spokes.select("a", "b"))
    references = groups.join(references.hint("merge"), "a")
    own = sets.select(F.col("id").alias("b"), F.col("shingles").alias("own")).hint("merge")
    joined = members.join(own, "b").join(references.hint("merge"), ["a", "part"]).select("a", "b", "own", "references")
    return common.persist_table(joined.mapInArrow(run, _PREFIXED))


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; linked: 100 * common >= percent * union."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.id_text(docs)

    def sign(batches):
        from linkloom.llm.minhash import _signed

        return _signed(batches, percent, words)

    signed = common.persist_table(rows.mapInArrow(sign, _SIGNED))
    linkable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    classes = signed.where(linkable).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    classes = common.persist_table(classes.withColumn("id", F.monotonically_increasing_id()))

    entries = classes.select("id", "doc_id", F.explode("bands").alias("band"))
    sizes = entries.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    shared = common.persist_table(entries.join(sizes, "band", "left_semi"))
    # the pivot shares more bands than any other of its bucket: what copies were made from is near to all of them
    degrees = shared.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    pivots = shared.join(degrees, "id").groupBy("band").agg(F.max(F.struct("degree", -F.col("doc_id"), "id")).alias("most")).select("band", F.col("most.id").alias("pivot"))
    star = common.persist_table(shared.join(pivots, "band").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())

    members = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    members = common.persist_table(classes.select("id", "digest", "doc_id").join(members.hint("merge"), "id", "left_semi"))
    wanted = spark.sparkContext.broadcast(_id_map(members.select("doc_id")))

    def to_sets(batches):
        from linkloom.llm.minhash import _sets

        return _sets(batches, words, wanted)

    # texts don't move: sets are made where the texts are read, of the ids on the map
    sets = rows.mapInArrow(to_sets, "digest binary, shingles binary").join(members.select("id", "digest").hint("merge"), "digest").select("id", "shingles").dropDuplicates(["id"])
    sets = common.persist_table(sets)

    tested = _test(star, sets, percent)
    links = tested.where("linked").select("a", "b")
    labels = components(links)

    named = labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
    pivots = labels.select(F.col("id").alias("a"), F.col("label").alias("label_a"))
    spokes = tested.select("a", "b").join(named, "b", "left").join(pivots, "a", "left")
    spokes = spokes.select("a", "b", F.coalesce("label_a", "a").alias("label_a"), F.coalesce("label_b", "b").alias("label"))
    # a pivot with one member outside its component, or none, is settled
    open_pivots = spokes.groupBy("a").agg(F.count_if(F.col("label") != F.col("label_a")).alias("outside"), F.count(F.lit(1)).alias("size")).where("outside > 0 and size > 1").select("a")
    spokes = common.persist_table(spokes.join(open_pivots, "a", "left_semi"))
    spokes = _with_prefixes(spokes, sets, percent).join(spokes, ["a", "b"])
    entries = spokes.select("a", "b", "n", "label", (F.col("label") != F.col("label_a")).alias("outside"), F.posexplode("prefix").alias("at", "shingle"))
    x, y = entries.where("outside").alias("x"), entries.alias("y")
    need = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent) - 1e-9)
    may_link = (
        (F.col("x.a") == F.col("y.a"))
        & (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.label") != F.col("y.label"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need)
    )
    rest = x.join(y, may_link).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    more = _test(rest, sets, percent).where("linked").select("a", "b")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = classes.select("digest", "id", "doc_id").join(labels, "id", "left").select("digest", "doc_id", F.coalesce("label", "id").alias("label"))
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(lowest, "label").select("digest", "component_id")
    out = signed.select("doc_id", "n_shingles", F.when(linkable, F.col("digest")).alias("digest")).join(ids, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, percent: int = SIMILARITY, words: int = WORDS) -> DataFrame:
    """The documents that stay, all their columns: one row of each component."""
    (number,) = common.unused(docs, "row")
    # numbers are written with the rows: a task that runs again could give others
    numbered = common.persist_table(docs.withColumn(number, F.monotonically_increasing_id()))
    found = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), percent, words).where("n_shingles > 0").select("doc_id", "component_id")
    ids = numbered.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = ids.join(found, ids["row"] == found["doc_id"]).groupBy("component_id").agg(F.min_by("row", order).alias("row"))
    gone = found.join(first, "component_id", "left").where(F.col("doc_id") != F.col("row")).select("doc_id")
    return numbered.join(gone.hint("merge"), F.col(number) == gone["doc_id"], "left_anti").select(*[f"`{c}`" for c in docs.columns])
