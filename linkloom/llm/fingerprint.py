"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame expressions only.

A paragraph (a line) has a wide vector: ``LANES`` lanes hashed from its SHA-512, and
``2 * PLANES * 3`` sign lanes, each the sum over the paragraph's word pairs of +1 or -1 by a bit of
the pair's hash.  A document's fingerprint is the sum of its paragraphs' vectors, lanes modulo 2^32
and sign lanes modulo 2^24.  So it does not depend on the paragraphs' order, a paragraph is added or taken
away by adding or subtracting its vector (``combine``), and equal texts have equal fingerprints.
The first lanes tell multisets apart; the sign lanes of two fingerprints estimate the cosine of
their word-pair counts (an AMS sketch), which is the likeness.

Neighbours: the next document by ascending doc_id is found without a global window.  Documents go to
blocks of near ids, equal spans of ids between quantiles; the first document of a block is sent to the block before
it as well, so one shuffle of the texts brings all neighbours together.  The blocks' first ids are broadcast:
``BLOCKS`` numbers at most (some 30 MB), so blocks hold ``DOCS_A_BLOCK`` documents up to 268 million documents and grow
beyond; a block is sorted by its task, which spills.

Defined results: null text is empty; an empty text has no paragraph, all lanes 0; likeness is 1 for equal
fingerprints and 0 if one side has no word pairs; a null doc_id sorts first; rows of equal doc_id follow
in the order of their texts; with one row, the row is its own neighbour; an empty table gives no rows;
extra columns are ignored.  Likeness is within about 0.09 (one standard deviation) of the cosine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

LANES = 32
LANE_BITS = 32
SIGN_BITS = 24
#: Planes of three sign lanes for each of two 64-bit hashes: 126 sign lanes.
PLANES = 21
#: Word pairs that one packed counter takes before lanes are carried over to whole numbers.
PACKED_ROWS = 1 << 20
DOCS_A_BLOCK = 256
BLOCKS = 1 << 20
QUANTILES = 256
_SPREAD = 1 | 1 << 21 | 1 << 42
_EXACT = LANES * LANE_BITS // 4
_DIGITS = SIGN_BITS // 4


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside lambda functions an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _paragraphs(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def _lanes(paragraphs: Column) -> Column:
    """Lanes of a document as hexadecimal text."""
    mask = F.lit((1 << LANE_BITS) - 1).cast("long")

    def lanes(digests: Column) -> Column:
        def lane(k: Column) -> Column:
            return F.aggregate(digests, F.lit(0).cast("long"), lambda acc, d: (acc + F.xxhash64(d, k).bitwiseAND(mask)).bitwiseAND(mask))

        return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lane)

    values = _bound(F.transform(paragraphs, lambda p: F.sha2(p, 512)), lanes)
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), LANE_BITS // 4, "0")), "")


def _pairs(text: Column) -> Column:
    """Hashes of each word with its follower in the paragraph, of the last word alone."""

    def of(paragraph: Column) -> Column:
        words = F.filter(F.split(paragraph, common.SPACE_RUN), lambda w: F.length(w) > 0)
        return _bound(words, lambda ws: F.transform(ws, lambda w, n: F.xxhash64(w, F.get(ws, n + 1))))

    return F.flatten(F.transform(_paragraphs(text), of))


def _packed(h: Column) -> list[Column]:
    """Sums of the 21-bit counters: bit k, k + 21 and k + 42 of a hash in one number."""
    spread = F.lit(_SPREAD).cast("long")
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(spread)) for k in range(PLANES)]


def _counters(packed: list[Column]) -> Column:
    """The three counters of each packed sum, as one array."""
    mask = F.lit((1 << 21) - 1).cast("long")
    return F.flatten(F.transform(F.array(*packed), lambda s: F.array(s.bitwiseAND(mask), F.shiftrightunsigned(s, 21).bitwiseAND(mask), F.shiftrightunsigned(s, 42).bitwiseAND(mask))))


def _signs(ones: Column, count: Column) -> Column:
    """Sign lanes from the counts of ones among ``count`` bits."""
    return F.transform(ones, lambda c: 2 * c - count)


def _sign_text(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(F.pmod(s, F.lit(1 << SIGN_BITS).cast("long")))), _DIGITS, "0")), "")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)


def _cosine(x: Column, y: Column) -> Column:
    size = F.sqrt(_dot(x, x) * _dot(y, y))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(x, y) / size))).otherwise(F.lit(0.0))


def _numbers(fingerprint: Column) -> tuple[Column, Column]:
    """(lanes, sign lanes as signed numbers) of a fingerprint's text."""
    wide, narrow = LANE_BITS // 4, _DIGITS
    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.conv(F.substring(fingerprint, k * wide + 1, F.lit(wide)), 16, 10).cast("long"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(6 * PLANES - 1)), lambda k: F.conv(F.substring(fingerprint, k * narrow + _EXACT + 1, F.lit(narrow)), 16, 10).cast("long"))
    half = 1 << (SIGN_BITS - 1)
    return lanes, F.transform(raw, lambda v: F.when(v >= half, v - 2 * half).otherwise(v))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a with b's paragraphs added (sign 1) or taken away (sign -1)."""
    (lanes_a, signs_a), (lanes_b, signs_b) = _numbers(a), _numbers(b)
    lanes = F.zip_with(lanes_a, lanes_b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << LANE_BITS).cast("long")))
    text = F.array_join(F.transform(lanes, lambda v: F.lpad(F.lower(F.hex(v)), LANE_BITS // 4, "0")), "")
    return F.concat(text, _sign_text(F.zip_with(signs_a, signs_b, lambda x, y: x + sign * y)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; 1 if they are equal."""
    return F.when(a == b, F.lit(1.0)).otherwise(_cosine(_numbers(a)[1], _numbers(b)[1]))


def _sketched(rows: DataFrame, key: list[str], texts: dict[str, str]) -> DataFrame:
    """For each row (by ``key``) and name in ``texts``: ``<name>_signs``, the sign lanes of that text column.

    Word pairs are exploded and summed within the rows' own partitions; counters are carried over to
    whole numbers every ``PACKED_ROWS`` pairs, so texts of any length fit.
    """

    def tagged_pairs(t: int, column: str) -> Column:
        return F.transform(_pairs(F.col(column)), lambda h, n: F.struct(h.alias("h"), F.lit(t).alias("t"), F.floor(n / PACKED_ROWS).cast("int").alias("part")))

    tagged = F.concat(*[tagged_pairs(t, c) for t, c in enumerate(texts.values())])
    pairs = rows.select(*key, F.explode(tagged).alias("p")).select(*key, F.col("p.h").alias("h"), F.col("p.t").alias("t"), F.col("p.part").alias("part"))
    pairs = pairs.withColumn("g", F.xxhash64("h"))
    sums = pairs.groupBy(*key, "t", "part").agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"h{k}") for k, c in enumerate(_packed(F.col("h")))], *[c.alias(f"g{k}") for k, c in enumerate(_packed(F.col("g")))])
    ones = F.concat(_counters([F.col(f"h{k}") for k in range(PLANES)]), _counters([F.col(f"g{k}") for k in range(PLANES)]))
    signs = sums.select(*key, "t", _signs(ones, F.col("n")).alias("s"))
    zero = F.array_repeat(F.lit(0).cast("long"), 6 * PLANES)

    def total(t: int) -> Column:
        parts = F.collect_list(F.when(F.col("t") == t, F.col("s")))
        return F.aggregate(parts, zero, lambda acc, s: F.zip_with(acc, s, lambda x, y: x + y))

    return signs.groupBy(*key).agg(*[total(t).alias(f"{name}_signs") for t, name in enumerate(texts)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = common.id_text(docs).withColumn("row", F.monotonically_increasing_id())
    rows = common.persist_table(rows)
    signs = _sketched(rows, ["row"], {"own": "text"})
    none = F.array_repeat(F.lit(0).cast("long"), 6 * PLANES)
    both = rows.select("row", "doc_id", _lanes(_paragraphs(F.col("text"))).alias("lanes")).join(signs, "row", "left")
    return both.select("doc_id", F.concat("lanes", _sign_text(F.coalesce("own_signs", none))).alias("fingerprint"))


def _blocks(rows: DataFrame, docs_a_block: int) -> DataFrame:
    """Rows (block, copy, doc_id, text): near ids share a block; the first row of a block is also the last, a copy, of the block before."""
    n = rows.count()
    wanted = max(1, min(BLOCKS, n // docs_a_block))
    quantiles = max(1, min(QUANTILES, wanted))
    edges = [int(x) for x in sorted(set(rows.approxQuantile("doc_id", [k / quantiles for k in range(quantiles + 1)], 0.25 / quantiles)))] if n else []
    parts = max(1, wanted // quantiles)
    place = F.lit(0).cast("long")
    if len(edges) > 1:
        # between two quantiles, equal spans of ids; so many blocks that a few documents share each
        lows, spans = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (edges[:-1], [max(1, -(-(y - x) // parts)) for x, y in zip(edges, edges[1:])]))
        found = F.greatest(F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
        inside = F.floor((F.col("doc_id") - F.get(lows, "found")) / F.get(spans, "found"))
        place = F.col("found") * parts + F.least(F.greatest(inside, F.lit(0).cast("long")), F.lit(parts - 1).cast("long"))
        rows = rows.withColumn("found", found.cast("long"))
    placed = rows.withColumn("block", F.coalesce(place, F.lit(0).cast("long"))).select("block", "doc_id", "text")
    lowest = F.lit(-(1 << 63)).cast("long")
    # the id of each block's first row, and the block before; at most BLOCKS rows of two numbers, in one task
    first = placed.select("block", F.coalesce("doc_id", lowest).alias("id")).groupBy("block").agg(F.min("id").alias("first"))
    every = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("block").over(every.orderBy("block")), F.max("block").over(every))
    links = common.persist_table(first.select("first", before.alias("target")))
    marked = placed.join(F.broadcast(links), F.coalesce(F.col("doc_id"), lowest) == F.col("first"), "left")
    targets = F.filter(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("copy")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("block"), F.lit(True).alias("copy")))), lambda t: t.isNotNull())
    return marked.select("doc_id", "text", F.explode(targets).alias("t")).select("t.block", "t.copy", "doc_id", "text")


def edited(docs: DataFrame, *, docs_a_block: int = DOCS_A_BLOCK) -> DataFrame:
    """Each whole text's fingerprint, and that of the text whose last half is replaced by the start of the next document.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.
    """
    # The join below asks for blocks that aren't null on one side; said here, both sides read one exchange of the texts.
    placed = _blocks(common.id_text(docs), docs_a_block).where(F.col("block").isNotNull())
    order = Window.partitionBy("block").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    rows = placed.select("block", "copy", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    size = F.length("text").cast("long")
    half = F.floor(size / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), (size - half).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edit", F.when(~F.col("copy"), text).otherwise(""))

    key = ["block", "place"]
    after = Window.partitionBy("block").orderBy("place")
    # both sides below lie by block already, so the next row is found before the rows are dealt out by key
    none = F.array_repeat(F.lit(0).cast("long"), 6 * PLANES)
    signs = _sketched(rows, key, {"own": "text", "edit": "edit"})
    adjoining = F.lead("place").over(after) == F.col("place") + 1
    signs = signs.withColumn("next_signs", F.when(adjoining, F.lead("own_signs").over(after)))
    likely = signs.select(
        *key, _sign_text(F.col("own_signs")).alias("own_text"), _sign_text(F.col("edit_signs")).alias("edit_text"),
        _cosine(F.col("own_signs"), F.col("edit_signs")).alias("like_edit"), _cosine(F.col("own_signs"), F.coalesce("next_signs", none)).alias("like_next"),
    )
    exact = rows.select(*key, "copy", "doc_id", size.alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), _lanes(_paragraphs(F.col("text"))).alias("lanes"), _lanes(_paragraphs(F.col("edit"))).alias("edit_lanes"))
    exact = exact.withColumns({"same_edit": F.col("edit_lanes") == F.col("lanes"), "same_next": F.coalesce(F.lead("lanes").over(after) == F.col("lanes"), F.lit(False))}).where("not copy")
    both = exact.join(likely, key, "left")
    zero = F.lit("0" * (6 * PLANES * _DIGITS))

    def near(same: str, like: str) -> Column:
        return F.when(F.col(same), F.lit(1.0)).otherwise(F.coalesce(like, F.lit(0.0)))

    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat("lanes", F.coalesce("own_text", zero)).alias("fingerprint"), F.concat("edit_lanes", F.coalesce("edit_text", zero)).alias("edited_fingerprint"),
        near("same_edit", "like_edit").alias("near_edited"), near("same_next", "like_next").alias("near_next"),
    )
