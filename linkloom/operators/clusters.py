"""Clusters of similar records: blocking, similarity, components, splits, merges, profiles, names and routes.

Records are feature sets (`features.feature_sets`) with a numeric ``id``, their position in the input.  A cluster is named by
the smallest id in it; a (id, cluster) table is a partition of the records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon, text, urls
from ..shipping import ship
from . import features as feature
from .features import SETS
from .skew import blocks_within, compared, numbered, pairs_within, top, written  # noqa: F401 (blocks_within: what tests hold `compared` against)

LINK, SPLIT, MERGE = 0.34, 0.50, 0.68
#: Parts of the score.
WEIGHTS = {
    "text_score": 0.35, "hint_score": 0.20, "domain_score": 0.15, "root_score": 0.10, "type_score": 0.05, "quality_score": 0.10, "time_score": 0.04,
    "canonical_score": 0.25, "bonus": 0.20,
}


@dataclass(frozen=True)
class Options:
    """Sizes that steer clustering and routing."""

    min_cluster: int = 10
    discovery_min: int = 3
    inline: int = 20
    discovery: str = lexicon.DISCOVERY_ROOT
    tidy: str = lexicon.DEFAULT_CATEGORY


def blocking_keys() -> Column:
    """Keys under which a record meets others: primary topic, registered domain, canonical link, two site words, four hints, two roots with the kind, six tokens.

    "First" is by name; roots by weight.  Generic platforms have no domain key, no topic that names a code host and none of three roots.
    """
    c = F.col
    tagged = lambda tag, values: F.transform(values, lambda v: F.concat(F.lit(tag + ":"), v))
    one = lambda tag, value, where: F.when(where, F.array(F.concat(F.lit(tag + ":"), value))).otherwise(F.array().cast("array<string>"))
    by_weight = F.array_sort(F.transform(F.map_entries("roots"), lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("root"))))
    roots = F.filter(F.slice(by_weight, 1, 2), lambda e: (c("confidence") >= 0.75) & (e["down"] < 0) & ~(c("platform") & e["root"].isin(*lexicon.PLATFORM_ROOTS)))
    return F.array_distinct(F.flatten(F.array(
        one("primary", text.label(c("topic")), (c("topic") != "") & ~(c("platform") & feature.source_like_topic(c("topic")))),
        one("domain", c("registered"), (c("registered") != "") & ~c("platform")), one("canonical", c("canonical"), c("canonical") != ""),
        tagged("site", F.slice(F.array_sort("site"), 1, 2)), tagged("hint", F.slice(F.array_sort("hints"), 1, 4)),
        F.transform(roots, lambda e: F.concat(F.lit("root:"), e["root"], F.lit(":"), c("kind"))),
        tagged("token", F.slice(F.array_sort(F.array_union(F.array_union("topics", "hints"), "path")), 1, 6)),
    )))


#: Columns that `similarity` compares.
COMPARED = (*SETS, "low_domain", "registered", "canonical", "topic", "confidence", "roots")


def candidate_pairs(features: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b), a < b, of records that share a key, each pair once; where no key is shared at all, all pairs.

    Pairs within a key are what this operator returns, so they grow with the square of a block; large blocks are dealt out in parts.
    ``carry`` are columns to bring along, of both records: `COMPARED` saves `similarity` its joins of all pairs.
    """
    more = features.select("id", *carry) if carry else None
    found = pairs_within(features.select("id", F.explode(blocking_keys()).alias("key")), "key", carry=more)
    if not found.isEmpty():
        return found
    return pairs_within(features.select("id", F.lit("all").alias("key")), "key", carry=more)


def similarity(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs (a, b) with all eleven metrics and the score, from 0 to 1.

    Features are those of `features.feature_sets`, with a numeric id; pairs may carry them (`candidate_pairs`).
    """
    both = pairs
    for side, end in ("aa", "bb"):
        if f"tokens_{end}" not in pairs.columns:
            both = both.join(features.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{end}") for c in COMPARED]), side)
    l, r = (lambda x: F.col(f"{x}_a")), (lambda x: F.col(f"{x}_b"))  # noqa: E731, E741
    j = lambda x: text.jaccard(l(x), r(x))
    flag = lambda where: F.when(where, 1.0).otherwise(0.0)
    same = lambda x: (l(x) != "") & (l(x) == r(x))
    union = lambda side, *names: F.array_distinct(F.flatten(F.array(*map(side, names))))
    both = both.withColumns({
        "topic_score": j("topics"), "type_score": flag(F.arrays_overlap(l("kinds"), r("kinds"))), "canonical_score": flag(same("canonical")), "time_score": j("times"),
        "text_score": F.greatest(text.jaccard(union(l, "tokens", "topics"), union(r, "tokens", "topics")), text.jaccard(union(l, "path", "tokens", "hints"), union(r, "path", "tokens", "hints"))),
        "hint_score": F.greatest(j("hints"), j("topics") * 0.7), "platform": same("registered") & urls.generic_platform(l("registered")),
    })
    domain = F.greatest(flag(same("low_domain")), 0.85 * flag(same("registered")), j("site") * 0.7, j("domain_tokens") * 0.4)
    capped = F.least(domain, F.greatest(j("site") * 0.25, j("domain_tokens") * 0.15, F.col("canonical_score")))
    shared = F.array_intersect(l("quality"), r("quality"))
    floor = F.when(F.size(shared) == 0, 0.0).when(F.arrays_overlap(shared, F.array(F.lit(lexicon.OFFICIAL), F.lit(lexicon.COMMUNITY))), 0.7).otherwise(0.5)
    bonus = (l("registered") != "") & (r("registered") != "") & (l("registered") != r("registered")) & same("topic") & (F.col("topic_score") >= 0.25)
    both = both.withColumns({
        "domain_score": F.when(F.col("platform"), capped).otherwise(domain), "root_score": text.weighted_jaccard(l("roots"), r("roots")),
        "quality_score": F.greatest(j("quality"), floor), "bonus": flag(bonus),
    })
    c = F.col
    sure = lambda least: (l("confidence") >= least) & (r("confidence") >= least)
    plain = lambda side: ~text.default_category(side("topic"))
    topics_part = sure(0.72) & (l("topic") != r("topic")) & plain(l) & plain(r)
    penalties = (
        (0.28, sure(0.8) & (F.size(F.array_intersect(F.map_keys(l("roots")), F.map_keys(r("roots")))) == 0) & (c("hint_score") < 0.15)),
        (0.34, c("platform") & topics_part & (c("topic_score") < 0.35) & (c("hint_score") < 0.35)),
        (0.18, same("registered") & (c("type_score") == 0) & (c("text_score") < 0.25) & (c("hint_score") < 0.15)),
        (0.30, c("platform") & (c("canonical_score") == 0) & (c("topic_score") < 0.2) & (c("text_score") < 0.28) & (c("hint_score") < 0.25)),
    )
    both = both.withColumn("penalty", F.greatest(*[F.when(where, size).otherwise(0.0) for size, where in penalties]))
    raw = sum((w * c(f"{name}") for name, w in WEIGHTS.items()), F.lit(0.0)) - c("penalty")
    raw = F.when((c("hint_score") < 0.2) & (c("text_score") < 0.15), raw * 0.6).otherwise(raw)
    both = both.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return both.select("a", "b", "topic_score", *WEIGHTS, "penalty", "score")


def _keys(features: DataFrame) -> DataFrame:
    """(id, key) of the records' blocking keys; one key for all where no key is shared at all."""
    keys = written(features.select("id", F.explode(blocking_keys()).alias("key")))
    if keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return features.select("id", F.lit("all").alias("key"))
    return keys


def _compared(features: DataFrame, keys: DataFrame | None, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` gives for the blocks of candidate pairs (or of those that share a key of ``keys``), with what `kernel.Similarity` reads."""
    ship(features.sparkSession)
    return compared(_keys(features) if keys is None else keys, "key", _carried(features), run, schema)


def _carried(features: DataFrame) -> DataFrame:
    more = {"generic": F.coalesce(urls.generic_platform(F.col("registered")), F.lit(False)), "plain": ~text.default_category(F.col("topic"))}
    return features.select("id", *COMPARED).withColumns(more).withColumn("roots", F.coalesce("roots", F.create_map().cast("map<string,double>")))


def _against(one: DataFrame, others: DataFrame, n: int) -> DataFrame:
    """Blocks of one record with about 2000 of ``n`` others each, as `blocks_within` deals them out."""
    parts = n // 2000 + 1
    spot = lambda part: {"i": F.lit(0), "j": F.lit(1), "part": F.lit(part), "before": F.array().cast("array<bigint>")}
    met = _carried(others).withColumn("number", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumns(spot(1))
    return met.unionByName(_carried(one).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).withColumns(spot(0)))


def scored_pairs(features: DataFrame, keys: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """`similarity` of all `candidate_pairs` (or of pairs that share a key of ``keys``) that score at least ``floor``, block by block.

    Records travel once for each part that they meet, pairs not at all.
    """
    return _compared(features, keys, *_scorer(floor))


def _scorer(floor: float) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    weights, names = dict(WEIGHTS), ("topic_score", *WEIGHTS, "penalty", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from linkloom.operators import kernel

        return kernel.scored(batches, weights, names, floor)

    return run, ", ".join(["a long", "b long", *[f"{n} double" for n in names]])


def strong_links(features: DataFrame, *floors: float, keys: DataFrame | None = None) -> DataFrame:
    """(a, b, floor): for each floor, enough candidate pairs (or pairs that share a key of ``keys``) of at least this score to join all records that such pairs join.

    The records that they connect are those that all these pairs connect, so `components` finds the same clusters without a row for each pair.
    """
    weights = dict(WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from linkloom.operators import kernel

        return kernel.linked(batches, weights, floors)

    return _compared(features, keys, run, "a long, b long, floor double")


def link_counts(features: DataFrame, floor: float = LINK) -> DataFrame:
    """(id, cluster, links): for each record the smallest id that candidate pairs of at least this score lead to, and how many of these pairs it is in.

    Every pair is scored and counted where its block lies; records and one link for each leave it, pairs do not.
    """
    weights = dict(WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from linkloom.operators import kernel

        return kernel.counted(batches, weights, floor)

    found = written(_compared(features, None, run, "a long, b long, links long"))
    whole = components(features, found.where("b is not null"))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    return whole.join(counts, "id", "left").select("id", "cluster", F.coalesce("links", F.lit(0)).alias("links"))


def key_counts(features: DataFrame) -> DataFrame:
    """(id, cluster, links): for each record the smallest id that shared keys lead to, and how many others share a key with it: its `candidate_pairs`, counted but not made.

    Records with the same keys are one class; those that meet a class are the sum of its keys' records, less what classes that have two or
    more of its keys count too often.  Keys within a larger key are left out, so most classes have one key.
    """
    rows, counts = numbered(_keys(features), "key")
    rows = written(rows.select("id", "number"))
    first = rows.groupBy("number").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n"))
    whole = components(features, rows.join(first, "number").where("id <> b").select(F.col("id").alias("a"), "b"))
    kinds = written(rows.groupBy("id").agg(F.array_sort(F.collect_list("number")).alias("numbers")))
    classes = written(kinds.groupBy("numbers").agg(F.count(F.lit(1)).alias("size")))
    met = classes.select("numbers", F.explode("numbers").alias("number")).join(first, "number").groupBy("numbers").agg(F.sum("n").alias("met"))
    two = F.flatten(F.transform("numbers", lambda k: F.transform(F.filter("numbers", lambda m: m > k), lambda m: F.struct(k.alias("k"), m.alias("m")))))
    twice = classes.where(F.size("numbers") > 1).select("numbers", "size", F.explode(two).alias("pair"))
    other = twice.select(F.col("numbers").alias("theirs"), F.col("size").alias("times"), "pair")
    common = F.array_intersect("numbers", "theirs")
    least = F.struct(F.get(common, F.lit(0)).alias("k"), F.get(common, F.lit(1)).alias("m"))
    again = twice.join(other, "pair").where(F.col("pair") == least).groupBy("numbers").agg(F.sum(F.col("times") * (F.size(common) - 1)).alias("again"))
    links = met.join(again, "numbers", "left").select("numbers", (F.col("met") - F.coalesce("again", F.lit(0)) - 1).alias("links"))
    found = kinds.join(links, "numbers").select("id", "links")
    return whole.join(found, "id", "left").select("id", "cluster", F.coalesce("links", F.lit(0)).alias("links"))


def _within(keys: DataFrame, members: DataFrame) -> DataFrame:
    """(id, key): records share a key if they share a cluster and a key."""
    return keys.join(members.select("id", "cluster"), "id").select("id", F.concat_ws(" ", "cluster", "key").alias("key"))


def overlaps(members: DataFrame, features: DataFrame) -> DataFrame:
    """(cluster, mean): the mean word overlap of the candidate pairs within each cluster that has some."""
    ship(features.sparkSession)
    keys = _within(_keys(features), members)
    carry = members.select("id", "cluster").join(features.select("id", F.array_distinct(F.concat("tokens", "topics", "hints")).alias("words")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from linkloom.operators import kernel

        return kernel.overlaps(batches)

    kind = members.schema["cluster"].dataType.simpleString()
    sums = compared(keys, "key", carry, run, f"cluster {kind}, total double, n long")
    return sums.groupBy("cluster").agg((F.sum("total") / F.sum("n")).alias("mean"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id reachable over (a, b) edges; nodes without edges are their own.

    Labels fall to the smallest neighbour's label, then to that label's label, until none falls;
    each round is written to the shared folder, so a lost executor costs one round.
    """
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())  # edges are made once
    labels, total = written(nodes.select("id", F.col("id").alias("cluster"))), None
    while (now := labels.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]) != total:
        total = now
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "cluster")
        near = labels.unionByName(heard).groupBy("id").agg(F.min("cluster").alias("cluster"))
        up = labels.select(F.col("id").alias("cluster"), F.col("cluster").alias("above"))
        labels = written(near.join(up, "cluster").select("id", F.least("above", "cluster").alias("cluster")))
    return labels


#: What topics, kinds, domains and overlap weigh in a cluster's consistency.
PURITY = {"topic_purity": 0.35, "kind_purity": 0.2, "domain_share": 0.15, "overlap": 0.3}


def _purity(members: DataFrame, features: DataFrame) -> DataFrame:
    """Of each cluster: size, purity of topics and kinds, concentration of domains, and their part of its consistency."""
    rows = members.select("id", "cluster").join(features, "id")
    rows = rows.withColumns({"hint": F.array_min("hints"), "root": feature.top_root(F.col("roots")), "site_domain": F.nullif("registered", F.lit(""))})
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))

    def purity(column: str) -> DataFrame:
        counts = rows.where(F.col(column).isNotNull()).groupBy("cluster", column).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("cluster").agg(F.max("n").alias(f"{column}_most"))

    out = sizes
    for column in ("topic", "hint", "root", "kind", "site_domain"):
        out = out.join(purity(column), "cluster", "left")
    share = {c: F.coalesce(F.col(f"{c}_most") / F.col("size"), F.lit(0.0)) for c in ("topic", "hint", "root", "kind", "site_domain")}
    out = out.select("cluster", "size", F.greatest(share["topic"], share["hint"], share["root"]).alias("topic_purity"), share["kind"].alias("kind_purity"), share["site_domain"].alias("domain_share"))
    return out.withColumn("pure", F.col("topic_purity") * PURITY["topic_purity"] + F.col("kind_purity") * PURITY["kind_purity"] + F.col("domain_share") * PURITY["domain_share"])


def consistency(members: DataFrame, features: DataFrame) -> DataFrame:
    """Of each cluster: size, purity of topics (or hints or roots, whichever is purest) and kinds, concentration of domains, mean word overlap of its candidate pairs, and the weighted sum.

    Members are (id, cluster); a cluster without pairs has overlap 1, one of a single record is consistent.
    """
    out = _purity(members, features).join(overlaps(members, features), "cluster", "left").withColumn("overlap", F.coalesce("mean", F.lit(1.0)))
    value = F.col("pure") + F.col("overlap") * PURITY["overlap"]
    return out.select("cluster", "size", "topic_purity", "kind_purity", "domain_share", "overlap", F.when(F.col("size") <= 1, F.lit(1.0)).otherwise(value).alias("consistency"))


def inconsistent(members: DataFrame, features: DataFrame, *, least: int, floor: float) -> DataFrame:
    """(cluster): clusters of at least ``least`` records whose `consistency` is below ``floor``.

    The overlap of all pairs is read of those alone that it decides: it lies between 0 and 1, so the rest of the sum settles the others.
    """
    low = written(_purity(members, features).where((F.col("size") >= max(2, least)) & (F.col("pure") < floor)))
    sure = F.col("pure") + PURITY["overlap"] < floor
    rest = low.where(~sure)
    if rest.isEmpty():
        return low.select("cluster")
    means = overlaps(members.join(rest.select("cluster"), "cluster", "left_semi"), features)
    value = F.col("pure") + F.coalesce("mean", F.lit(1.0)) * PURITY["overlap"]
    return written(low.join(means, "cluster", "left").where(sure | (value < floor)).select("cluster"))


def split(members: DataFrame, scored: DataFrame, quality: DataFrame, *, least: int = 4, floor: float = 0.52) -> DataFrame:
    """(id, cluster) with every large inconsistent cluster parted by its links of at least SPLIT, if that gives several parts but not single records."""
    flagged = quality.where((F.col("size") >= least) & (F.col("consistency") < floor)).select("cluster")
    inside = members.join(flagged, "cluster", "left_semi").select("id", "cluster")
    links = scored.where(F.col("score") >= SPLIT).join(inside.select(F.col("id").alias("a"), F.col("cluster").alias("x")), "a").join(inside.select(F.col("id").alias("b"), F.col("cluster").alias("y")), "b").where("x = y")
    return _parted(members, inside, links)


def split_inconsistent(members: DataFrame, features: DataFrame, *, least: int = 4, floor: float = 0.52) -> DataFrame:
    """What `split` gives of all candidate pairs and of `consistency`; records are compared in the clusters alone that are parted."""
    flagged = inconsistent(members, features, least=least, floor=floor)
    inside = written(members.join(flagged, "cluster", "left_semi").select("id", "cluster"))
    if inside.isEmpty():
        return members.select("id", "cluster")
    return _parted(members, inside, strong_links(features, SPLIT, keys=_within(_keys(features), inside)))


def _parted(members: DataFrame, inside: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster) with clusters of ``inside`` parted by links, where that gives several parts but not single records."""
    parts = components(inside, links.select("a", "b")).withColumnRenamed("cluster", "part")
    counts = inside.join(parts, "id").groupBy("cluster").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("size"))
    good = counts.where("parts > 1 and parts < size").select("cluster")
    moved = inside.join(good, "cluster", "left_semi").join(parts, "id").select("id", F.col("part").alias("new"))
    return members.select("id", "cluster").join(moved, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))


def _mode(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(cluster, name): the most frequent value that isn't blank, ties by first appearance."""
    counts = rows.where(F.col(column) != "").groupBy("cluster", column).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("at"))
    return counts.groupBy("cluster").agg(F.max_by(column, F.struct("n", -F.col("at"))).alias(name))


def centroids(members: DataFrame, features: DataFrame) -> DataFrame:
    """One feature set for each cluster, with the cluster as its id: unions of sets, most frequent topic, kind and domains, shares of roots, mean confidence."""
    rows = members.select("id", "cluster").join(features, "id")
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(s)))).alias(s) for s in SETS]
    out = rows.groupBy("cluster").agg(*sets, F.bround(F.avg("confidence"), 3).alias("confidence"), F.count(F.lit(1)).alias("size"))
    out = out.join(_mode(rows, "topic", "topic"), "cluster", "left").join(_mode(rows, "kind", "kind"), "cluster", "left")
    out = out.join(_mode(rows, "low_domain", "low_domain"), "cluster", "left").join(_mode(rows, "registered", "registered"), "cluster", "left")
    weights = rows.select("cluster", F.explode("roots").alias("root", "w")).groupBy("cluster", "root").agg(F.sum("w").alias("w"))
    share = F.coalesce(F.bround(F.col("w") / F.sum("w").over(Window.partitionBy("cluster")), 4), F.lit(0.0))
    maps = weights.select("cluster", "root", share.alias("s")).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("root", "s"))).alias("roots"))
    out = out.join(maps, "cluster", "left")
    fill = {"topic": F.coalesce("topic", F.lit(lexicon.UNSORTED)), "kind": F.coalesce("kind", F.lit(lexicon.UNKNOWN)), "low_domain": F.coalesce("low_domain", F.lit("")), "registered": F.coalesce("registered", F.lit("")), "roots": F.coalesce("roots", F.create_map().cast("map<string,double>")), "canonical": F.lit("")}
    return out.withColumns(fill).withColumnRenamed("cluster", "id")


def merge_similar(members: DataFrame, features: DataFrame, floor: float = MERGE) -> DataFrame:
    """(id, cluster, place) after merging the two most similar clusters again and again while their centroids score at least ``floor``; of equal pairs the first.

    Members are (id, cluster, place); places order the clusters.  All centroids meet, as matrices: a large one has most words of the records, so
    meeting under words would list the square of them.  They all meet once; after a merge the new centroid meets the others.  Each step
    sends one pair to the driver; steps depend on each other.
    """
    now = written(members.select("id", "cluster", "place"))
    c = written(centroids(now, features))
    n, pairs = c.count(), written(scored_pairs(c, c.select("id", F.lit("all").alias("key")), floor).select("a", "b", "score"))
    while True:
        places = now.groupBy("cluster").agg(F.min("place").alias("place"))
        good = pairs.join(places.select(F.col("cluster").alias("a"), F.col("place").alias("x")), "a").join(places.select(F.col("cluster").alias("b"), F.col("place").alias("y")), "b")
        best = good.orderBy(F.col("score").desc(), F.least("x", "y"), F.greatest("x", "y")).limit(1).collect()
        if not best:
            return now
        pair = best[0]
        first, second = (pair["a"], pair["b"]) if pair["x"] <= pair["y"] else (pair["b"], pair["a"])
        place = min(pair["x"], pair["y"])
        both = F.col("cluster").isin(first, second)
        spot = F.struct(F.lit(place["parent"]).alias("parent"), F.lit(place["own"]).alias("own"))
        now = written(now.select("id", F.when(both, F.lit(min(first, second))).otherwise(F.col("cluster")).alias("cluster"), F.when(both, spot).otherwise(F.col("place")).alias("place")))
        new = written(centroids(now.where(F.col("cluster") == min(first, second)), features))
        others, n = c.where(~F.col("id").isin(first, second)), n - 1
        met = _against(new, others, n).groupBy("number", "i", "j").applyInArrow(*_scorer(floor)).select("a", "b", "score")
        pairs = written(pairs.where(~F.col("a").isin(first, second) & ~F.col("b").isin(first, second)).unionByName(met))
        c = written(others.unionByName(new))


def strong_groups(rows: DataFrame, *, floor: float = 0.72) -> DataFrame:
    """(id, cluster, part): records of clusters that part by strong categories, the part of the remainder empty; other clusters are left out.

    Rows have id, cluster, category, confidence and platform.  A cluster of three or more parts when two groups of two records
    (one, in a platform's cluster of up to five) cover enough of it: 66 % where platforms make 45 % of it; elsewhere 70 %, the second group 20 %.
    """
    c = F.col
    whole = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg(F.when(c("platform"), 1.0).otherwise(0.0)).alias("platforms")).where("size >= 3")
    strong = (c("confidence") >= floor) & ~text.default_category(c("category"))
    groups = rows.where(strong).groupBy("cluster", "category").agg(F.count(F.lit(1)).alias("n")).join(whole, "cluster")
    groups = groups.where(c("n") >= F.when((c("platforms") >= 0.45) & (c("size") <= 5), 1).otherwise(2))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(c("n").desc(), "category")))
    able = ranked.groupBy("cluster").agg(F.sum("n").alias("covered"), F.max(F.when(c("rank") == 2, c("n"))).alias("second"), F.first("size").alias("size"), F.first("platforms").alias("platforms"))
    enough = F.when(c("platforms") >= 0.45, c("covered") >= 0.66 * c("size")).otherwise((c("covered") >= 0.7 * c("size")) & (c("second") >= 0.2 * c("size")))
    able = able.where(c("second").isNotNull() & enough).select("cluster")
    named = groups.join(able, "cluster", "left_semi").select("cluster", "category", F.lit(True).alias("own"))
    parted = rows.join(able, "cluster", "left_semi").join(named, ["cluster", "category"], "left")
    return parted.select("id", "cluster", F.when(F.coalesce("own", F.lit(False)) & strong, c("category")).otherwise("").alias("part"))


def keyword_groups(rows: DataFrame, least: int) -> DataFrame:
    """(id, cluster, part): each record under its most frequent keyword (the first of equals); groups below ``least`` and records without keywords together under 其他.

    Rows have id, cluster, name and the columns of `features.cluster_text`.
    """
    words = rows.select("id", "cluster", F.posexplode(text.keywords(F.concat_ws(" ", F.coalesce("name", F.lit("")), feature.cluster_text()), True)).alias("n", "word"))
    counts = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("first"))
    best = counts.groupBy("id").agg(F.max_by("word", F.struct("times", -F.col("first"))).alias("word"))
    named = rows.select("id", "cluster").join(best, "id", "left").withColumn("word", F.coalesce("word", F.lit(lexicon.OTHER)))
    large = named.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cluster", "word", F.lit(True).alias("large"))
    return named.join(large, ["cluster", "word"], "left").select("id", "cluster", F.when(F.coalesce("large", F.lit(False)), F.col("word")).otherwise(lexicon.OTHER).alias("part"))


def fallback_groups(rows: DataFrame, least: int) -> DataFrame:
    """(id, cluster, part) of clusters of three or more: by registered domain, if two domains that are no platforms have two records each; else by keyword."""
    site = F.when(F.col("registered") != "", F.col("registered")).otherwise(F.col("low_domain"))
    rows = rows.withColumn("site_key", F.when(urls.generic_platform(site), "").otherwise(site))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 2").select("cluster")
    rows = rows.join(sizes, "cluster", "left_semi")
    groups = rows.where("site_key <> ''").groupBy("cluster", "site_key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    able = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("cluster")
    kept = groups.join(able, "cluster", "left_semi").select("cluster", "site_key", F.lit(True).alias("own"))
    by_site = rows.join(able, "cluster", "left_semi").join(kept, ["cluster", "site_key"], "left")
    by_site = by_site.select("id", "cluster", F.when(F.coalesce("own", F.lit(False)), F.col("site_key")).otherwise("").alias("part"))
    return by_site.unionByName(keyword_groups(rows.join(able, "cluster", "left_anti"), least))


def domain_groups(rows: DataFrame) -> DataFrame:
    """(id, part): records by their domain as saved; none: 其他."""
    return rows.select("id", F.when(F.coalesce("domain", F.lit("")) == "", lexicon.OTHER).otherwise(F.col("domain")).alias("part"))


#: Columns that clusters are made by, and those that their profiles read beside these.
GROUPED = ("id", *COMPARED, "kind", "platform", "category", "name", "preferred_title", "preferred_description", "keywords_text", "page_type_hints", "site_name", "brand_terms", "headings_h2")
PROFILED = (
    *GROUPED, "record", "url", "domain", "rule_roots", "rule_confidence", "review_required", "confirmation_bucket", "fetch_status", "cluster_hints", "source_facets", "feature_fields",
)


def clusters(features: DataFrame, options: Options = Options()) -> DataFrame:
    """(id, cluster): components, inconsistent ones split, similar ones merged, then parted by strong categories or, if still inconsistent, by site or keyword."""
    f = written(features.select(*[x for x in features.columns if x in GROUPED]))
    whole = components(f, strong_links(f, LINK))
    parted = split_inconsistent(whole, f, least=max(4, options.min_cluster))
    placed = parted.join(whole.withColumnRenamed("cluster", "parent"), "id").select("id", "cluster", F.struct("parent", F.col("cluster").alias("own")).alias("place"))
    merged = merge_similar(placed, f).select("id", "cluster")
    rows = written(merged.join(f, "id"))
    strong = written(strong_groups(rows))
    weak = inconsistent(merged, f, least=max(6, 2 * options.min_cluster), floor=0.42)
    left = rows.join(strong.select("cluster").distinct(), "cluster", "left_anti").join(weak, "cluster", "left_semi")
    groups = written(fallback_groups(written(left), options.min_cluster))
    counts = groups.groupBy("cluster").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n")).where("parts > 1 and parts < n").select("cluster")
    moved = strong.unionByName(groups.join(counts, "cluster", "left_semi"))
    named = moved.join(moved.groupBy("cluster", "part").agg(F.min("id").alias("new")), ["cluster", "part"]).select("id", "new")
    return written(merged.join(named, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster")))


def ordered(members: DataFrame, features: DataFrame) -> DataFrame:
    """(cluster, size, first_record) by falling size, then the smallest record name as text."""
    sizes = members.join(features.select("id", "record"), "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("record").alias("first_record"))
    return sizes.orderBy(F.col("size").desc(), "first_record")


# ---- profiles -----------------------------------------------------------------------------------

def _strings(cells: Column) -> Column:
    return F.transform(cells, lambda x: x["value"])


def _first(cells: Column) -> Column:
    return F.get(cells, F.lit(0))


def distributions(rows: DataFrame) -> DataFrame:
    """Of each cluster: rule roots with support, categories, hints and domains with shares (the first four, eight hints), buckets and statuses with shares, mean confidence.

    Rows are features with their cluster.  Ties go by first appearance.
    """
    c = F.col
    weighed = F.transform(F.slice("rule_roots", 1, 3), lambda r: F.struct(r["root"].alias("root"), F.when(r["support"] > 0, r["support"]).when(r["total"] > 0, r["total"]).otherwise(1.0).alias("w")))
    by_category = F.when(c("category") != "", F.array(F.struct(text.category_root(c("category")).alias("root"), F.lit(1.0).alias("w"))))
    roots = rows.select("cluster", "id", F.posexplode(F.when(F.size("rule_roots") > 0, weighed).otherwise(by_category)).alias("n", "x"))
    host = F.when(F.coalesce("domain", F.lit("")) != "", c("domain")).otherwise(urls.host(F.coalesce("url", F.lit(""))))
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")
    domain = F.when(F.size(labels) > 2, urls.two_labels(F.array_join(labels, "."))).otherwise(host)
    hints = rows.select("cluster", "id", F.posexplode(F.slice("cluster_hints", 1, 4)).alias("n", "hint"))
    share = lambda where: F.bround(F.count_if(where) / F.count(F.lit(1)), 4)
    out = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.bround(F.avg("rule_confidence"), 4).alias("average_confidence"), share(c("review_required")).alias("review_share"),
        *[share(c("confirmation_bucket") == b).alias(f"{b}_share") for b in ("fetch_blocked", "rule_gap", "low_confidence")],
        F.avg(F.when(c("platform"), 1.0).otherwise(0.0)).alias("platform_share"),
    )
    status = F.when(c("fetch_status") == "", "unknown").otherwise(c("fetch_status"))
    parts = [
        top(roots, "cluster", c("x.root"), at=F.struct("id", "n"), weight=c("x.w"), limit=4, name="roots_found"), top(rows, "cluster", c("category"), at=c("id"), limit=4, name="categories"),
        top(hints, "cluster", F.trim("hint"), at=F.struct("id", "n"), limit=8, name="hints_found"), top(rows, "cluster", domain, at=c("id"), limit=4, name="domains"),
        top(rows, "cluster", c("confirmation_bucket"), at=c("id"), name="buckets"), top(rows, "cluster", status, at=c("id"), name="statuses"),
    ]
    for part in parts:
        out = out.join(part, "cluster", "left")
    empty = {"roots_found": "array<struct<value:string,n:double,share:double>>"} | dict.fromkeys(("categories", "hints_found", "domains", "buckets", "statuses"), "array<struct<value:string,n:bigint,share:double>>")
    return out.withColumns({k: F.coalesce(k, F.array().cast(kind)) for k, kind in empty.items()})


def provenance(rows: DataFrame, limit: int = 24) -> DataFrame:
    """(cluster, families, fields): how many of a cluster's records draw on each signal family and field, most frequent first."""
    used = rows.select("cluster", F.explode("feature_fields").alias("field"))
    families = rows.select("cluster", "id", F.explode(F.array_distinct(F.transform("feature_fields", lambda f: F.split_part(f, F.lit("."), F.lit(1))))).alias("family"))
    return top(families, "cluster", F.col("family"), order=[], name="families").join(top(used, "cluster", F.col("field"), order=[], limit=limit, name="fields"), "cluster")


def representative_tokens(rows: DataFrame, limit: int = 6) -> DataFrame:
    """(cluster, tokens): the most frequent topics, text and path tokens (a token counts up to three times a record) whose label says something.

    Of the first 6 * ``limit`` tokens by count, then by label; weak ones need two mentions in clusters above two records; labels once.
    Nothing left: the first tokens as they are.
    """
    c = F.col
    counts = rows.select("cluster", F.explode(F.concat("topics", "tokens", "path")).alias("token")).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("shown", text.label(c("token"))).withColumn("key", text.token(c("shown")))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(c("n").desc(), "key", F.lower("token"), "token"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ranked = counts.withColumn("rank", rank).where(c("rank") <= 6 * limit).join(sizes, "cluster")
    good = ~text.generic_label(c("shown")) & ~(text.weak(c("shown")) & (c("n") < F.when(c("size") <= 2, 1).otherwise(2)))
    ranked = ranked.withColumn("good", good)
    ranked = ranked.withColumn("once", c("good") & (F.row_number().over(Window.partitionBy("cluster", "key", "good").orderBy("rank")) == 1))
    pick = lambda where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("rank", "token")))), lambda x: x["token"])
    out = ranked.groupBy("cluster").agg(F.slice(pick(c("once")), 1, limit).alias("chosen"), F.slice(pick(F.lit(True)), 1, limit).alias("plain"))
    return out.select("cluster", F.when(F.size("chosen") > 0, c("chosen")).otherwise(c("plain")).alias("tokens"))


def _winner(rows: DataFrame, shown: Column, name: str, *, least: Column | None = None, order: list[Column] | None = None, also: Column | None = None) -> DataFrame:
    """(cluster, name): the most frequent label, ties by ``order``, then by name; a label needs ``least`` records where that is given."""
    counts = rows.withColumn("shown", shown).where("shown is not null and shown <> ''").groupBy("cluster", "shown", "size").agg(F.count(F.lit(1)).alias("n"))
    if least is not None:
        counts = counts.where(F.col("n") >= least)
    if also is not None:
        counts = counts.where(also)
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc(), *(order or []), "shown"))
    return counts.withColumn("rank", rank).where("rank = 1").select("cluster", F.col("shown").alias(name))


def label_candidates(rows: DataFrame) -> DataFrame:
    """(cluster, leaf, project, site_label, domain_label, hint_label, hint_label_root): the dominant labels of clusters.

    Rows are features with cluster, size and hint_category, the category that a cluster is read under; labels that are generic under it are none.
    """
    c = F.col
    root = F.split_part("hint_category", F.lit("/"), F.lit(1))
    usable = lambda x, under: F.when((x != "") & ~text.generic_label(x, under), x)
    leaf = text.category_leaf_label(c("category"), root)
    leaf = F.when((c("rule_confidence") >= 0.72) & ~text.weak(leaf), usable(leaf, F.when(root != "", root).otherwise(c("hint_category"))))
    project = usable(text.repository_label(F.coalesce("url", F.lit("")), F.when(c("registered") != "", c("registered")).otherwise(c("low_domain"))), root)
    site = F.filter(F.transform(F.concat(F.array("site_name"), F.slice("source_facets", 1, 2)), text.human_label), lambda x: (x != "") & ~text.generic_label(x, c("hint_category")))
    out = rows.select("cluster").distinct()
    out = out.join(_winner(rows, leaf, "leaf"), "cluster", "left").join(_winner(rows.where("platform"), project, "project", least=F.when(c("size") == 1, 1).otherwise(2)), "cluster", "left")
    out = out.join(_winner(rows.where("not platform"), F.get(site, F.lit(0)), "site_label"), "cluster", "left")
    out = out.join(_winner(rows.where("not platform"), text.domain_name(c("registered")), "domain_label"), "cluster", "left")
    hints = rows.select("cluster", "size", "platform", "hint_category", F.explode(F.slice("cluster_hints", 1, 4)).alias("hint")).withColumn("h", text.human_label(c("hint")))
    host = c("platform") & (text.label_key(c("h")).isin(*lexicon.GENERIC_PLATFORM_TOKENS) | feature.source_like_topic(c("h")))
    hints = hints.where(~host & (c("h") != "") & ~text.noisy(c("h")))
    order = [text.weak(c("shown")), -F.length(text.token(c("shown")))]
    firm = ~(text.weak(c("shown")) & (c("n") < 2))
    for name, under in (("hint_label", c("hint_category")), ("hint_label_root", root)):
        out = out.join(_winner(hints, usable(c("h"), under), name, order=order, also=firm), "cluster", "left")
    return out


def display_names(labels: DataFrame, tokens: DataFrame, shape: DataFrame) -> DataFrame:
    """(cluster, display_name) of `label_candidates`, `representative_tokens` (four) and (cluster, platform_share, hint_category).

    Where platforms make 45 % of a cluster: project, hint, leaf, site; elsewhere the hint.  Then the first token with a label; then leaf, site and
    domain; nothing: 其他.
    """
    c = F.col
    rows = shape.join(labels, "cluster", "left").join(tokens, "cluster", "left")
    root = F.split_part("hint_category", F.lit("/"), F.lit(1))
    ok = lambda x, under: F.when((x != "") & ~text.generic_label(x, under), x)
    platforms = c("platform_share") >= 0.45
    early = F.when(platforms, F.coalesce(ok(c("project"), root), ok(c("hint_label_root"), root), ok(c("leaf"), root), ok(c("domain_label"), root))).otherwise(ok(c("hint_label"), c("hint_category")))
    shown = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), text.label)
    spoken = F.get(F.filter(shown, lambda x: ~text.generic_label(x, c("hint_category")) & ~(platforms & text.weak(x))), F.lit(0))
    late = F.coalesce(ok(c("leaf"), root), ok(c("site_label"), root), ok(c("domain_label"), root))
    return rows.select("cluster", F.coalesce(early, spoken, late, F.lit(lexicon.OTHER)).alias("display_name"))


def reasons(rows: DataFrame) -> DataFrame:
    """(cluster, reason): what holds a cluster together, in words; equal counts go by the name's letters and digits, whatever the input's order."""
    c = F.col
    order = [text.token(c("value")), F.lower("value")]
    some = lambda df, value, limit, name: top(df, "cluster", value, order=order, limit=limit, name=name).select("cluster", F.array_join(_strings(c(name)), ", ").alias(name))
    out = rows.select("cluster").distinct()
    hints = rows.select("cluster", F.explode("hints").alias("hint"))
    for part in (some(rows, c("topic"), 2, "r_topic"), some(hints, c("hint"), 3, "r_hint"), some(rows, feature.top_root(c("roots")), 2, "r_root"), some(rows, c("kind"), 1, "r_kind"), some(rows, c("registered"), 2, "r_site")):
        out = out.join(part, "cluster", "left")
    parts = (("主题重合集中在 ", "r_topic", ""), ("聚类线索来自 ", "r_hint", ""), ("规则先验主要指向 ", "r_root", ""), ("资源类型以", "r_kind", "为主"), ("站点分布参考 ", "r_site", ""))
    said = F.array_compact(F.array(*[F.concat(F.lit(a), c(x), F.lit(b)) for a, x, b in parts]))
    return out.select("cluster", F.when(F.size(said) > 0, F.array_join(said, "；")).otherwise("基于综合特征相似度聚类").alias("reason"))


def profiles(members: DataFrame, features: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each cluster: distributions, label and how it was found, reason, tokens, route with its factors, stable id and place in the order.

    Features are of classified records; members are (id, cluster).
    """
    c, o = F.col, options
    rows = written(members.select("id", "cluster").join(features.select(*[x for x in features.columns if x in PROFILED]), "id"))
    out = distributions(rows)
    first = _first(c("categories"))
    hint = F.coalesce(first["value"], _first(c("roots_found"))["value"], F.lit(o.discovery))
    out = written(out.withColumns({"hint_category": hint, "dominant": F.coalesce(first["value"], F.lit("")), "dominant_share": F.coalesce(first["share"], F.lit(0.0))}))
    named = written(rows.join(out.select("cluster", "size", "hint_category"), "cluster"))
    tokens = written(representative_tokens(rows))
    names = display_names(label_candidates(named), representative_tokens(rows, 4), out.select("cluster", "platform_share", "hint_category"))
    ids = rows.groupBy("cluster").agg(text.stable_id("bc_", F.collect_list(F.when(c("canonical") != "", c("canonical")).otherwise(F.coalesce("url", "record")))).alias("cluster_id"))
    out = out.join(names, "cluster").join(tokens, "cluster", "left").join(reasons(rows), "cluster").join(ids, "cluster")
    leaf_root = text.category_root(c("dominant"))
    out = out.withColumns({"leaf_label": F.when(c("dominant") != "", text.category_leaf_label(c("dominant"), leaf_root)).otherwise(""), "context": F.when(c("dominant") != "", leaf_root).otherwise(text.category_root(c("hint_category")))})
    single, shared = (c("size") == 1) & (c("leaf_label") != ""), (c("leaf_label") != "") & (c("dominant_share") >= 0.6)
    label = F.when(single | shared, c("leaf_label")).otherwise(c("display_name"))
    basis = F.when(single, "single_leaf").when(shared, "dominant_leaf").otherwise("hint_or_token")
    out = out.withColumns({"label_1": label, "basis_1": basis})
    rescue = text.generic_label(c("label_1"), c("context")) & (c("leaf_label") != "")
    out = out.withColumns({"label_2": F.when(rescue, c("leaf_label")).otherwise(c("label_1")), "basis_2": F.when(rescue, "dominant_leaf_fallback").otherwise(c("basis_1"))})
    spoken = F.get(F.filter(F.transform(_strings(c("hints_found")), text.human_label), lambda x: (x != "") & ~text.generic_label(x, c("context"))), F.lit(0))
    by_topic = text.generic_label(c("label_2"), c("context")) & spoken.isNotNull()
    out = out.withColumns({"label": F.when(by_topic, spoken).otherwise(c("label_2")), "label_basis": F.when(by_topic, "discovered_topic_fallback").otherwise(c("basis_2"))})
    out = route(out, o).drop("label_1", "label_2", "basis_1", "basis_2", "display_name")
    order = Window.orderBy(c("destination_root") == o.discovery, "destination_root", c("size").desc(), "label", "cluster_id")  # a row for each cluster
    return out.withColumn("cluster_order", F.row_number().over(order))


def host_label(label: Column, domains: Column) -> Column:
    """A label that is the first part of one of the cluster's hosts."""
    key = text.token(label)
    return (key != "") & F.exists(domains, lambda d: text.token(F.split_part(F.btrim(F.lower(d["value"]), F.lit(".")), F.lit("."), F.lit(1))) == key)


def route(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Profiles with where a cluster goes (its root, discovery, or the tidy root), the factors and the reasons.

    Rows have size, roots_found, categories, hints_found and domains as arrays of (value, n, share), average_confidence, fetch_blocked_share,
    review_share, label.  Discovery needs a topic, enough records, and none of four guards.
    """
    c, o, lit = F.col, options, F.lit
    one, two = _first(c("roots_found")), F.get("roots_found", lit(1))
    dominant = F.coalesce(_first(c("categories"))["value"], lit(""))
    zero = lambda x: F.coalesce(x, lit(0.0))
    rooted = F.size("roots_found") > 0
    ours = F.filter("categories", lambda x: ~text.default_category(x["value"]) & (~rooted | (text.category_root(x["value"]) == F.coalesce(one["value"], lit("")))))
    hosted = F.filter("domains", lambda d: urls.generic_platform(F.lower(d["value"])))
    rows = rows.withColumns({
        "top_support": zero(one["share"]), "second_support": zero(two["share"]), "rule_purity": F.bround(F.when(rooted, one["share"]).otherwise(zero(_first(c("categories"))["share"])), 4),
        "normal_support": F.bround(F.aggregate(ours, lit(0.0), lambda t, x: t + x["share"]), 4), "generic_platform_share": zero(F.array_max(F.transform(hosted, lambda d: d["share"]))),
        "source_host_label": host_label(c("label"), c("domains")),
    })
    guards = {
        "fetch_blocked_guard": c("fetch_blocked_share") >= 0.5, "review_required_guard": c("review_share") >= 0.75,
        "generic_platform_guard": (c("generic_platform_share") >= 0.8) & (c("normal_support") < 0.25), "source_host_label_guard": c("source_host_label") & (c("normal_support") < 0.5),
    }
    held = F.array_compact(F.array(*[F.when(w, lit(k)) for k, w in guards.items()]))
    rows = rows.withColumn("discovery_allowed", F.size(held) == 0)
    free = c("discovery_allowed") & (F.size("hints_found") > 0) & (c("size") >= o.discovery_min)
    elsewhere = F.when(free, lit(o.discovery)).otherwise(lit(o.tidy))
    plain = text.default_category(dominant)
    own = text.category_root(dominant)
    destination = (
        F.when((c("size") == 1) & (dominant != "") & ~plain, own).when(plain & (c("average_confidence") < 0.55), elsewhere)
        .when(~rooted, F.when(free, lit(o.discovery)).when((zero(_first(c("categories"))["share"]) >= 0.5) & ~plain, own).otherwise(lit(o.tidy)))
        .when((c("normal_support") < 0.25) & (c("average_confidence") < 0.65), elsewhere)
        .when((c("rule_purity") < 0.45) | (F.bround(c("top_support") - c("second_support"), 6) < 0.1), elsewhere).otherwise(one["value"])
    )
    rows = rows.withColumn("destination_root", destination)
    went = F.when(c("destination_root") == o.discovery, "routed_to_discovery").when(c("destination_root") == o.tidy, "routed_to_tidy").otherwise("routed_to_normal_root")
    return rows.withColumn("route_reasons", F.concat(held, F.array(went)))


def suggestions(profiles: DataFrame, options: Options = Options(), least: int = 4) -> DataFrame:
    """What to do about clusters of at least ``least`` records that give a reason to, by falling size, then label.

    Profiles are those of `route`, with tokens and label.
    """
    c, o = F.col, options
    target = F.coalesce(_first(c("categories"))["value"], F.lit(""))
    share = F.coalesce(F.array_max(F.transform(F.filter("domains", lambda d: urls.generic_platform(F.lower(d["value"]))), lambda d: d["share"])), F.lit(0.0))
    tokens = F.when(F.size(F.coalesce("tokens", F.array().cast("array<string>"))) > 0, c("tokens")).otherwise(_strings(c("hints_found")))
    proposed = F.filter(_strings(F.slice("domains", 1, 3)), lambda d: ~urls.generic_platform(F.lower(d)) & text.specific_domain(d))
    mixed = (F.size("categories") > 1) & (_first(c("categories"))["share"] < 0.7)
    triggers = {
        "generic_platform_cluster": share >= 0.45, "cluster_fell_back_to_discovery_root": c("destination_root") == o.discovery, "cluster_needs_manual_tidy": c("destination_root") == o.tidy,
        "fetch_blocked_cluster": c("fetch_blocked_share") >= 0.5, "low_rule_purity": c("rule_purity") < 0.45, "generic_existing_category": text.default_category(target), "mixed_existing_categories": mixed,
    }
    found = F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in triggers.items()]))
    rows = profiles.where(c("size") >= least).withColumns({"trigger_reasons": found, "target_category": target, "proposed_domains": proposed, "keywords_found": tokens}).where(F.size("trigger_reasons") > 0)
    has = lambda x: F.array_contains("trigger_reasons", x)
    split_it = has("mixed_existing_categories") & (has("generic_platform_cluster") | (c("rule_purity") < 0.45))
    spoken, normal = F.size("keywords_found") > 0, ~c("destination_root").isin(o.discovery, o.tidy)
    kind = (
        F.when(has("fetch_blocked_cluster"), "investigate_fetch_failures").when(split_it, "split_mixed_cluster").when(text.default_category(c("target_category")) & spoken, "create_topic")
        .when((F.size("proposed_domains") > 0) & (c("rule_purity") >= 0.45), "add_specific_domain").when((c("target_category") != "") & spoken, "add_alias").otherwise("demote_noisy_keyword_or_folder_signal")
    )
    rows = rows.withColumn("type", kind)
    root = (
        F.when(c("type").isin("investigate_fetch_failures", "create_topic"), "").when(c("type") == "split_mixed_cluster", F.when(normal, c("destination_root")).otherwise(""))
        .when(c("type").isin("add_specific_domain", "add_alias"), text.category_root(c("target_category"))).otherwise(F.when(c("destination_root") != o.discovery, c("destination_root")).otherwise(""))
    )
    rows = rows.withColumns({"target_root": root, "proposed_keywords": F.slice("keywords_found", 1, 6)}).drop("keywords_found")
    return rows.orderBy(c("size").desc(), "label")


def representatives(members: DataFrame, features: DataFrame, limit: int = 5) -> DataFrame:
    """(cluster, records): the first ``limit`` records of each cluster."""
    rows = members.select("id", "cluster").join(features.select("id", "record", "name", "url", "domain", "category", "resource_type"), "id")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= limit)
    return few.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record", "name", "url", "domain", "category", "resource_type"))), lambda x: x.dropFields("rank")).alias("records"))
