"""Similarity, blocking, splits and merges against plain versions."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import clusters, skew

SETS = ("tokens", "topics", "hints", "path", "site", "domain_tokens", "kinds", "quality", "times")
SCHEMA = "id long, low_domain string, registered string, canonical string, topic string, kind string, confidence double, roots map<string,double>, " + ", ".join(f"{s} array<string>" for s in SETS)


def row(n, domain="a.x.org", registered="x.org", canonical="", topic="t", kind="k", confidence=0.0, roots=None, **sets):
    return (n, domain, registered, canonical or f"c{n}", topic, kind, confidence, roots or {}, *[sorted(sets.get(s, ("k",) if s == "kinds" else ())) for s in SETS])


ROWS = [
    row(1, tokens="abc", topics="ab", hints="pq", path="pq", site="x", domain_tokens="ax", roots={"r": 0.5, "s": 0.5}, confidence=0.9, quality=["官方"], times=["2020"]),
    row(2, canonical="c1", tokens="abd", topics="a", hints="p", path="p", site="x", domain_tokens="ax", roots={"r": 1.0}, confidence=0.9, quality=["官方", "z"], times=["2020", "w"]),
    row(3, domain="b.x.org", tokens="zy", topics="v", hints="m", roots={"u": 1.0}, confidence=0.85, kinds=["other"]),
    row(4, domain="q.net", registered="q.net", tokens="ab", topics="ab", hints="q", domain_tokens="q"),
    row(5, domain="github.com", registered="github.com", topic="one", tokens="ab", topics="j", confidence=0.75, domain_tokens="g", quality=["z"]),
    row(6, domain="github.com", registered="github.com", topic="two", tokens="cd", topics="i", confidence=0.75, domain_tokens="g", quality=["z", "y"]),
    row(7, domain="github.com", registered="github.com", topic="待整理", canonical="same", tokens="cd", topics="i", confidence=0.75, domain_tokens="g"),
    row(8, domain="github.com", registered="github.com", topic="two", canonical="same", tokens="ce", topics="i", confidence=0.75, domain_tokens="gh"),
    row(9, domain="", registered="", canonical="", topic=""),
]


def brute(x, y):
    x, y = ({k: set(v) if isinstance(v, list) else v for k, v in zip(SCHEMA_NAMES, r)} for r in (x, y))
    jac = lambda p, q: len(p & q) / len(p | q) if p and q else 0.0
    topic = jac(x["topics"], y["topics"])
    same = lambda k: float(bool(x[k]) and x[k] == y[k])
    registered, canonical = same("registered"), same("canonical")
    platform = registered and x["registered"] == "github.com"
    site, parts = jac(x["site"], y["site"]), jac(x["domain_tokens"], y["domain_tokens"])
    domain = max(same("low_domain"), 0.85 * registered, 0.7 * site, 0.4 * parts)
    if platform:
        domain = min(domain, max(0.25 * site, 0.15 * parts, canonical))
    text = max(jac(x["tokens"] | x["topics"], y["tokens"] | y["topics"]), jac(x["path"] | x["tokens"] | x["hints"], y["path"] | y["tokens"] | y["hints"]))
    hint, kind = max(jac(x["hints"], y["hints"]), 0.7 * topic), float(bool(x["kinds"] & y["kinds"]))
    names = set(x["roots"]) | set(y["roots"])
    most = sum(max(x["roots"].get(k, 0), y["roots"].get(k, 0)) for k in names)
    root = sum(min(x["roots"].get(k, 0), y["roots"].get(k, 0)) for k in names) / most if most else 0.0
    common = x["quality"] & y["quality"]
    quality = max(jac(x["quality"], y["quality"]), (0.7 if common & {"官方", "社区"} else 0.5) if common else 0)
    bonus = float(bool(x["registered"] and y["registered"] and x["registered"] != y["registered"] and x["topic"] and x["topic"] == y["topic"] and topic >= 0.25))
    sure, penalty = min(x["confidence"], y["confidence"]), 0.0
    if sure >= 0.8 and not set(x["roots"]) & set(y["roots"]) and hint < 0.15:
        penalty = 0.28
    if platform and sure >= 0.72 and x["topic"] != y["topic"] and not {"待整理", ""} & {x["topic"], y["topic"]} and topic < 0.35 and hint < 0.35:
        penalty = max(penalty, 0.34)
    if registered and not kind and text < 0.25 and hint < 0.15:
        penalty = max(penalty, 0.18)
    if platform and not canonical and topic < 0.2 and text < 0.28 and hint < 0.25:
        penalty = max(penalty, 0.30)
    score = 0.35 * text + 0.2 * hint + 0.15 * domain + 0.1 * root + 0.05 * kind + 0.1 * quality + 0.04 * jac(x["times"], y["times"]) + 0.25 * canonical + 0.2 * bonus - penalty
    return penalty, max(0.0, min(1.0, score * 0.6 if hint < 0.2 and text < 0.15 else score))


SCHEMA_NAMES = [c.strip().split(" ")[0] for c in SCHEMA.replace("map<string,double>", "map").split(",")]


def test_full_similarity(spark):
    features = spark.createDataFrame(ROWS, SCHEMA)
    pairs = spark.createDataFrame([(x[0], y[0]) for x, y in combinations(ROWS, 2)], "a long, b long")
    got = {(r["a"], r["b"]): (r["penalty"], r["score"]) for r in clusters.similarity(pairs, features).collect()}
    want = {(x[0], y[0]): brute(x, y) for x, y in combinations(ROWS, 2)}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert {0.28, 0.34, 0.30} <= {p for p, _ in want.values()}


def test_blocking_keys(spark):
    f = spark.createDataFrame([ROWS[0], ROWS[4]], SCHEMA).withColumn("platform", F.col("registered") == "github.com")
    first, platform = [set(r[0]) for r in f.select(clusters.blocking_keys()).collect()]
    assert {"domain:x.org", "canonical:c1", "site:x", "hint:p", "hint:q", "root:r:k", "root:s:k", "token:a", "token:b"} <= first
    assert not any(k.startswith(("domain:", "site:", "root:")) for k in platform) and "primary:one" in platform


def test_pairs_of_large_blocks_and_without_blocks(spark):
    rows = spark.createDataFrame([(n, "hot" if n < 60 else f"k{n % 3}") for n in range(80)], "id long, key string")
    want = {(a, b) for a, b in combinations(range(80), 2) if (a < 60) == (b < 60) and (a < 60 or a % 3 == b % 3)}
    for size in (7, 1000):
        assert {tuple(r) for r in skew.pairs_within(rows, "key", size=size).collect()} == want
    lone = spark.createDataFrame([row(n, domain=f"h{n}.org", registered=f"h{n}.org", topic=f"t{n}", tokens="ab") for n in range(3)], SCHEMA).withColumn("platform", F.lit(False))
    assert {tuple(r) for r in clusters.candidate_pairs(lone).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_merge_one_pair_after_the_other(spark):
    """Against a plain loop: the two most similar centroids first, until none reach the floor."""
    words = {0: "abcd", 1: "abce", 2: "abcde", 3: "xyz", 4: "wxyz", 5: "q", 6: "mnop", 7: "mnopr"}
    rows = [row(n, domain=f"s{n % 2}.org", registered=f"s{n % 2}.org", topic="t", tokens=w, topics=w[:2], hints=w[:1], quality=["z"], roots={"r": 1.0}) for n, w in words.items()]
    rows = [(*r[:3], "", *r[4:]) for r in rows]
    f = spark.createDataFrame(rows, SCHEMA).withColumn("platform", F.lit(False))
    members = f.select("id", F.col("id").alias("cluster"), F.struct(F.col("id").alias("parent"), F.col("id").alias("own")).alias("place"))
    got = defaultdict(set)
    for r in clusters.merge_similar(members, f).collect():
        got[r["cluster"]].add(r["id"])

    live = [[r] for r in rows]

    def centre(group):
        out = [group[0][0], *[max((g[k] for g in group), key=lambda v, k=k: ([g[k] for g in group].count(v), -[g[k] for g in group].index(v))) for k in range(1, 6)], 0.0, {"r": 1.0}]
        return (*out, *[sorted(set().union(*(g[k] for g in group))) for k in range(8, len(group[0]))])

    while True:
        best = max(((brute(centre(x), centre(y))[1], -i, -j) for i, x in enumerate(live) for j, y in enumerate(live) if i < j), default=(0,))
        if best[0] < clusters.MERGE:
            break
        i, j = -best[1], -best[2]
        live[i] += live.pop(j)
    assert sorted(got.values(), key=min) == sorted(({r[0] for r in g} for g in live), key=min) and len(live) < len(rows)


def test_split_by_strong_links(spark):
    links = [(0, 50, 0.6), (50, 100, 0.4), (100, 150, 0.6), (150, 200, 0.49)]
    members = spark.createDataFrame([(n, 0) for n in (0, 50, 100, 150, 200)], "id long, cluster long")
    scored = spark.createDataFrame(links, "a long, b long, score double")
    loose = spark.createDataFrame([(0, 5, 0.3)], "cluster long, size long, consistency double")
    got = {r["id"]: r["cluster"] for r in clusters.split(members, scored, loose).collect()}
    assert got == {0: 0, 50: 0, 100: 100, 150: 100, 200: 200}
    firm = spark.createDataFrame([(0, 5, 0.9)], "cluster long, size long, consistency double")
    assert {r["cluster"] for r in clusters.split(members, scored, firm).collect()} == {0}


def test_pairs_are_not_shuffled_to_make_them_distinct(spark):
    """Records that share many keys meet once, from the first of them, also where a key's records lie in several parts."""
    rows = spark.createDataFrame([(n, f"{k}{n % m}") for n in range(60) for k, m in (("x", 2), ("y", 3), ("z", 7))], "id long, key string")
    pairs = skew.pairs_within(rows, "key", size=8)
    assert "Aggregate [a" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = [(a, b) for a, b in combinations(range(60), 2) if any(a % m == b % m for m in (2, 3, 7))]
    assert sorted(map(tuple, pairs.collect())) == want


def test_pairs_that_carry_features_are_not_joined_again(spark):
    f = skew.written(spark.createDataFrame(ROWS, SCHEMA).withColumn("platform", F.col("registered") == "github.com"))
    pairs = clusters.candidate_pairs(f, clusters.COMPARED)
    scored = clusters.similarity(pairs, f)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(scored) == joins(pairs)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, clusters.similarity(clusters.candidate_pairs(f), f).collect()))


def test_blocks_give_all_pairs_and_what_they_link(spark, monkeypatch):
    """Blocks compared as matrices against expressions: metrics, components at two floors, pairs in several parts and tiles."""
    from linkloom.operators import kernel

    f = skew.written(spark.createDataFrame([(r[0] + 10 * k, *r[1:]) for k in range(3) for r in ROWS], SCHEMA).withColumn("platform", F.col("registered") == "github.com"))
    want = clusters.similarity(clusters.candidate_pairs(f), f)
    assert sorted(map(tuple, clusters.scored_pairs(f).collect())) == sorted(map(tuple, want.collect()))
    links = clusters.strong_links(f, clusters.LINK, clusters.SPLIT)
    for floor in (clusters.LINK, clusters.SPLIT):
        plain = clusters.components(f, want.where(F.col("score") >= floor))
        assert sorted(clusters.components(f, links.where(F.col("floor") == floor)).collect()) == sorted(plain.collect())
    weights = dict(clusters.WEIGHTS)
    monkeypatch.setattr(kernel, "TILE", 40)
    carry = f.select("id", *clusters.COMPARED).withColumns({"generic": F.col("registered") == "github.com", "plain": ~F.col("topic").isin("", "待整理")})
    for size in (4, 100):
        blocks = skew.blocks_within(clusters._keys(f), "key", carry, size).toArrow()
        groups = {}
        for n, cell in enumerate(zip(*(blocks[c].to_pylist() for c in ("number", "i", "j")))):
            groups.setdefault(cell, []).append(n)
        rows = [tuple(r.values()) for g in groups.values() for b in kernel.scored(iter(blocks.take(g).to_batches()), weights, ("score",)) for r in b.to_pylist()]
        assert sorted(rows) == sorted(map(tuple, want.select("a", "b", "score").collect()))


def test_consistency_makes_no_row_for_a_pair(spark):
    """The mean overlap of a cluster's candidate pairs, each counted once, without rows of pairs: consistency takes records alone."""
    f = skew.written(spark.createDataFrame(ROWS, SCHEMA).withColumn("platform", F.col("registered") == "github.com"))
    members = f.select("id", (F.col("id") % 2).alias("cluster"))
    words = {r[0]: set(r[8]) | set(r[9]) | set(r[10]) for r in ROWS}
    jac = lambda p, q: len(p & q) / len(p | q) if p and q else 0.0
    pairs = [tuple(r) for r in clusters.candidate_pairs(f).collect() if r["a"] % 2 == r["b"] % 2]
    want = {k: [jac(words[a], words[b]) for a, b in pairs if a % 2 == k] for k in (0, 1)}
    got = {r["cluster"]: r["overlap"] for r in clusters.consistency(members, f).collect()}
    assert got == {k: pytest.approx(sum(v) / len(v)) for k, v in want.items()}


def test_keys_within_a_larger_key_are_left_out(spark):
    rows = spark.createDataFrame([(n, k) for n in range(12) for k in ("all", f"m{n % 3}")] + [(12, "m0"), (13, "x")], "id long, key string")
    blocks = skew.blocks_within(rows, "key", rows.select("id").distinct(), 5).collect()
    assert {r["number"] for r in blocks} == {r["number"] for r in blocks if r["before"] or r["id"] != 12} and len({r["number"] for r in blocks}) == 2


def test_class_and_number_of_links_of_each_record(spark, monkeypatch):
    """Every link is counted on both of its records and none is lost, also where a key's records lie in several parts; no row for a pair is made."""
    f = skew.written(spark.createDataFrame([(r[0] + 10 * k, *r[1:]) for k in range(3) for r in ROWS], SCHEMA).withColumn("platform", F.col("registered") == "github.com"))
    pairs = clusters.similarity(clusters.candidate_pairs(f), f).where(F.col("score") >= clusters.LINK)
    whole = dict(clusters.components(f, pairs).collect())
    want = {k: (c, 0) for k, c in whole.items()}
    for a, b in pairs.select("a", "b").collect():
        want[a], want[b] = (want[a][0], want[a][1] + 1), (want[b][0], want[b][1] + 1)
    dealt = skew.blocks_within
    for size in (4, 2000):
        monkeypatch.setattr(clusters, "blocks_within", lambda rows, key, carry, size=size: dealt(rows, key, carry, size))
        assert {r["id"]: (r["cluster"], r["links"]) for r in clusters.link_counts(f).collect()} == want


def test_overlaps_are_read_where_they_decide(spark, monkeypatch):
    """Inconsistent clusters and their parts are those of `consistency` and `split`; where the rest of the sum settles all clusters no record is compared."""
    f = skew.written(spark.createDataFrame([(r[0] + 10 * k, *r[1:]) for k in range(3) for r in ROWS], SCHEMA).withColumn("platform", F.col("registered") == "github.com"))
    members = skew.written(f.select("id", (F.col("id") % 4).alias("cluster")))
    quality, pairs = skew.written(clusters.consistency(members, f)), skew.written(clusters.scored_pairs(f))
    values = sorted(r["consistency"] for r in quality.collect())
    for floor in (values[1], values[2] + 1e-9):
        want = {r[0] for r in quality.where((F.col("size") >= 4) & (F.col("consistency") < floor)).select("cluster").collect()}
        assert {r[0] for r in clusters.inconsistent(members, f, least=4, floor=floor).collect()} == want
        parts = clusters.split(members, pairs, quality, floor=floor)
        assert sorted(clusters.split_inconsistent(members, f, floor=floor).collect()) == sorted(parts.collect())
    monkeypatch.setattr(clusters, "overlaps", None)
    assert clusters.inconsistent(members, f, least=4, floor=0.0).isEmpty() and clusters.inconsistent(members, f, least=4, floor=2.0).count() == 4


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    edge = F.udf(lambda n: made.add(1) or n + 1, "long")
    edges = spark.range(5).select(F.col("id").alias("a"), edge("id").alias("b"))
    assert {r["cluster"] for r in clusters.components(spark.range(6), edges).collect()} == {0} and made.value == 5


def test_packed_chunks_give_what_rows_give(spark, monkeypatch):
    """Keys of several parts are packed; parts of several chunks, chunks against themselves and others: every pair once, with its metrics."""
    rows = [(r[0] + 10 * k, *r[1:]) for k in range(9) for r in ROWS]
    f = skew.written(spark.createDataFrame(rows, SCHEMA).withColumn("platform", F.col("registered") == "github.com"))
    want = sorted(map(tuple, clusters.similarity(clusters.candidate_pairs(f), f).collect()))
    dealt = skew.compared
    for chunk, strips in ((3, 2), (5, 100)):
        monkeypatch.setattr(skew, "STRIPS", strips)
        monkeypatch.setattr(clusters, "compared", lambda *given, chunk=chunk: dealt(*given, chunk))
        assert sorted(map(tuple, clusters.scored_pairs(f).collect())) == want
    plain = spark.createDataFrame([(a, b) for a, b, *m in want if m[-1] >= clusters.LINK], "a long, b long")
    got = clusters.link_counts(f)
    assert {r["id"]: r["links"] for r in got.collect()} == {r[0]: plain.where(f"a = {r[0]} or b = {r[0]}").count() for r in rows[:3]} | {r["id"]: r["links"] for r in got.where(~F.col("id").isin([r[0] for r in rows[:3]])).collect()}
    assert sorted(got.select("id", "cluster").collect()) == sorted(clusters.components(f, plain).collect())


def test_a_block_sends_one_link_for_a_record(monkeypatch):
    from linkloom.operators import kernel

    monkeypatch.setattr(kernel, "TILE", 4)
    joined = kernel.Joined()
    for a, b in ((9, 4), (4, 7), (7, 9), (20, 31), (31, 30), (2, 3), (30, 20), (3, 9)):
        joined.add(np.array([a]), np.array([b]))
    a, b = joined.reduce()
    assert sorted(zip(b.tolist(), a.tolist())) == [(3, 2), (4, 2), (7, 2), (9, 2), (30, 20), (31, 20)]


def test_pages_that_share_a_key_are_counted(spark, monkeypatch):
    """As many as `candidate_pairs` has, without its rows: classes of several keys, of one, of none."""
    keys = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (4, "c"), (5, "c"), (6, "z"), (7, "a"), (7, "b"), (8, "y"), (9, "y"), (10, "a"), (11, "b"), (11, "c"), (11, "a")]
    monkeypatch.setattr(clusters, "_keys", lambda f: spark.createDataFrame(keys, "id long, key string"))
    of = {n: {k for m, k in keys if m == n} for n in range(1, 12)}
    got = {r["id"]: (r["cluster"], r["links"]) for r in clusters.key_counts(spark.createDataFrame([(n,) for n in of], "id long")).collect()}
    assert got == {n: (8 if n in (8, 9) else 6 if n == 6 else 1, sum(bool(of[n] & of[m]) for m in of if m != n)) for n in of}


def test_pages_carry_no_texts_that_nothing_reads(spark):
    from linkloom.plans import structure

    texts = {"semantic_text", "main_text", "main_text_preview", "description_candidates", "t_description", "t_semantic_text", "t_content_preview"}
    assert not texts & set(structure.page_features(spark, "/root/testdata/sf0.001").columns)
