"""Classification on literal records: gates, ambiguity, homepages, assignments, platforms, lineage."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import rules, signals
from linkloom.operators.rules import Rule

RULES, OPTIONS = rules.bundle({
    "categories": {
        "storage/Rocks": {"keywords": ["rocksdb", "lsm-tree"]}, "papers/Venues": {"keywords": ["sigmod", "vldb"]}, "storage/Tidy": {"domains": ["book.tidydb.io"], "keywords": ["tidydb", "tidykv"], "title_patterns": ["TidyDB"]},
        "storage/Elephant": {"keywords": ["elephantdb", "wal"], "title_patterns": ["ElephantDB"]}, "skipped": {"topic": False, "keywords": ["rocksdb"]}, "listed": {"keywords": ["rocksdb"]},
    },
    "topics": {"storage/Rocks": {"keywords": ["compaction"]}}, "non_topic_categories": ["listed"],
})
CASES = [
    dict(id="tie", name="Research publications", url="https://people.example.edu/publications", path_segments=["publications"], meta_description="SIGMOD and VLDB papers on RocksDB and LSM-tree", meta_keywords="sigmod,vldb,rocksdb,lsm-tree"),
    dict(id="home", name="A blog", url="https://e.org/", path_segments=[], fetch_status="success", main_text_preview="ElephantDB WAL notes, elephantdb again"),
    dict(id="strong", name="TidyDB Guide", url="https://book.tidydb.io/a/b", path_segments=["a", "b"], fetch_status="error", reason_code="dns_connection", review_required=True, meta_keywords="tidydb,tidykv"),
    dict(id="limited", name="ElephantDB deep dive", url="https://e.org/p/x", path_segments=["p", "x"], fetch_status="broken", reason_code="access_denied", access_pattern="access_limited", review_required=True),
    dict(id="gone", name="Elsewhere", meta_description="wal, elephantdb", url="https://e.org/p/y", path_segments=["p", "y"], fetch_status="broken", reason_code="not_found", access_pattern="missing", review_required=True),
    dict(id="open", name="AcmeFlow release notes", url="https://acmeflow.dev/releases/v1", path_segments=["releases", "v1"], fetch_status="success"),
    dict(id="suffix", name="Docker 网络排障 - 简书", url="https://www.jianshu.com/p/docker", path_segments=["p", "docker"], fetch_status="success", site_given="简书", site_brands=["创作你的创作"]),
    dict(id="hosted", name="GitHub - o/rocks-tool: helper", url="https://github.com/o/rocks-tool", path_segments=["o", "rocks-tool"], fetch_status="success"),
    dict(id="reserved", name="Topics", url="https://github.com/topics/db", path_segments=["topics", "db"], fetch_status="success"),
    dict(id="by_home", name="Kubernetes page", url="https://k.example.org/x", path_segments=["x"], fetch_status="timeout", reason_code="timeout", review_required=True, site_given="Example Portal", site_brands=["Portal"], site_fetch_status="success", site_source="fetched"),
    dict(id="given", name="Anything", url="https://e.org/given", path_segments=["given"], fetch_status="success"),
    dict(id="weak", name="Something else", url="https://e.org/weak", path_segments=["weak"], fetch_status="success"),
    dict(id="plain", name=None, url=None), dict(id="blank", name="", url="", path_segments=[], fetch_status=""),
    dict(id="trusted", name="ElephantDB trusted", url="https://e.org/p/z", path_segments=["p", "z"], fetch_status="broken", reason_code="trusted_access", review_required=False, trusted_override=True),
    dict(id="coded", name="20240101123456", og_title="Rocks compaction", url="https://e.org/c", path_segments=["c"], fetch_status="success", meta_description="rocksdb compaction"),
]


@pytest.fixture(scope="module")
def got(spark):
    fields = sorted({k for c in CASES for k in c})
    schema = ", ".join(f"{f} {signals.RECORD[f]}" for f in fields)
    rows = spark.createDataFrame([[c.get(f) for f in fields] for c in CASES], schema)
    order = F.create_map(*[F.lit(x) for n, c in enumerate(CASES) for x in (c["id"], n)])
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "//([^/]*)", 1)
    rows = rows.withColumns({"ord": order[F.col("id")].cast("long"), "domain": host})
    given = spark.createDataFrame([("https://e.org/given", "assigned/Topic", 0.95, "bc_1"), ("HTTPS://E.org//weak!", "assigned/Low", 0.4, "bc_2")], "identity string, category string, confidence double, source_cluster_id string")
    out = rules.classify(signals.signals(rows), RULES, OPTIONS, given)
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == len(CASES)
    return rows


def test_bundle_merges_topics_and_drops_what_is_no_topic():
    assert [r.category for r in RULES] == ["storage/Rocks", "papers/Venues", "storage/Tidy", "storage/Elephant"]
    assert RULES[0] == Rule("storage/Rocks", (), ("rocksdb", "lsm-tree", "compaction"), ())


def test_near_ties_across_roots_fall_back(got):
    r = got["tie"]
    assert (r["category"], r["cross_root_ambiguous"]) == ("待整理", True) and "cross_root_score_ambiguity" in r["needs_confirmation_reasons"]


def test_homepages_need_more_than_their_whole_text(got):
    r = got["home"]
    assert (r["category"], r["homepage_aggregate_only"]) == ("待整理", True) and "homepage_aggregate_only" in r["needs_confirmation_reasons"]


@pytest.mark.parametrize("case, category, kept, bucket", [("strong", "storage/Tidy", True, "fetch_blocked"), ("limited", "storage/Elephant", True, "fetch_blocked"), ("gone", "待整理", False, "fetch_blocked"), ("trusted", "storage/Elephant", False, "low_confidence")])
def test_review_gate(got, case, category, kept, bucket):
    r = got[case]
    assert (r["category"], r["review_topic_preserved"], r["confirmation_bucket"]) == (category, kept, bucket)
    assert ("待审阅" in r["quality_signals"]) == (case == "gone") and r["needs_confirmation"] == (case != "trusted")


def test_open_topics_make_a_rule_gap(got):
    r = got["open"]
    assert (r["category"], r["primary_topics"], r["confirmation_bucket"]) == ("待整理", [], "rule_gap")
    assert [t["topic"] for t in r["open_topics"]][:1] == ["Acmeflow"] and r["open_topics"][0]["sources"] == ["domain", "name", "title"]
    assert "rule_coverage_gap_on_successful_fetch" in r["needs_confirmation_reasons"] and "Acmeflow" in r["cluster_hints"]


def test_platforms_are_no_topics(got):
    r = got["suffix"]
    topics = [t["topic"].lower() for t in r["open_topics"]]
    assert "docker" in topics and "简书" not in topics and "简书" not in r["cluster_hints"] and "创作你的创作" not in r["cluster_hints"]
    assert "github" not in [t["topic"].lower() for t in got["hosted"]["open_topics"]] + [h.lower() for h in got["hosted"]["cluster_hints"]]


def test_repositories_need_a_project_path(got):
    assert got["hosted"]["resource_type"] == "仓库" and got["reserved"]["resource_type"] != "仓库"


def test_what_only_the_homepage_says_is_left_out(got):
    r = got["by_home"]
    assert not {"portal", "example portal"} & {x.lower() for x in r["cluster_hints"]} and "portal" not in [t["topic"].lower() for t in r["open_topics"]]
    assert "fetch_limited_signal" in r["needs_confirmation_reasons"]


def test_assignments(got):
    r = got["given"]
    assert (r["category"], r["primary_topics"], r["rule_confidence"], r["score"], r["assigned"]) == ("assigned/Topic", ["assigned/Topic"], 0.95, 25.0, True)
    assert [x["root"] for x in r["rule_roots"]] == ["assigned"] and r["rule_candidates"][0]["signals"] == ["llm_cluster_assignment"] and r["top_decision_drivers"][0]["driver"] == "llm_cluster_assignment"
    assert "identity.canonical_identity" in r["used_signal_fields"] and "score_below_min" not in r["needs_confirmation_reasons"]
    low = got["weak"]  # found by its link's letters, too unsure to apply
    assert (low["assigned"], low["a_category"], low["category"]) == (False, "assigned/Low", "待整理")


def test_nothing_known(got):
    for case in ("plain", "blank"):
        r = got[case]
        assert (r["category"], r["scores"], r["resource_type"], r["open_topics"], r["primary_topics"]) == ("待整理", [], "未知", [], ["待整理"])
        assert "低信息量页" in r["quality_signals"] and r["confirmation_bucket"] == "low_confidence"


def test_coded_names_give_way(got):
    r = got["coded"]
    assert r["preferred_title"] == "Rocks compaction" and r["title_candidates"] == ["20240101123456", "Rocks compaction"] and r["scores"][0]["category"] == "storage/Rocks"


def test_lineage(got):
    r = got["strong"]
    drivers = [d["driver"] for d in r["top_decision_drivers"]]
    assert drivers[0] == "rule_category" and drivers[-1] == "review_gate" and len(drivers) <= 4 and r["top_decision_drivers"][0]["summary"].startswith("storage/Tidy (")
    assert {"identity.domain", "content.title_candidates", "health_access.fetch_status"} <= set(r["used_signal_fields"]) and r["used_signal_families"] == sorted(r["used_signal_families"])


def test_counts_of_keywords_and_rounding(spark):
    scores = "array<struct<down:double,ord:int,category:string,domain:int,keyword:int,title:int,content:int,total:double,signals:array<string>>>"
    one = [(-20.0, 0, "a/x", 0, 40, 0, 0, 20.0, ["keywords"]), (-11.0, 1, "b/y", 0, 20, 0, 20, 11.0, ["keywords", "content"]), (-10.6, 2, "a/z", 0, 0, 0, 80, 10.6, ["content"])]
    row = spark.createDataFrame([(one,)], f"s {scores}").select(rules.rule_roots(F.col("s")).alias("r"), rules.raw_confidence(F.col("s")).alias("c")).first()
    assert [(x["root"], x["total"], x["support"]) for x in row["r"]] == [("a", 30.6, 0.7356), ("b", 11.0, 0.2644)]
    assert row["c"] == 0.753  # 0.55 * 20 / 25 + 0.25 * 9 / 20 + 0.2


def test_merge_of_documents():
    assert rules.merge_payload({"a": [1, {"x": 1}], "b": {"c": 1}}, {"a": [{"x": 1}, 2], "b": {"d": 2}, "e": 3}) == {"a": [1, {"x": 1}, 2], "b": {"c": 1, "d": 2}, "e": 3}


def test_classification_carries_no_texts(spark, sf):
    """What is decided of documents is written without their texts (several copies of each were), and the query's files stay below the input's size."""
    import glob
    import os

    from linkloom.plans import classify

    out = classify.classified(spark, sf)
    assert not {"main_text", "main_text_preview", "semantic_text", "preferred_description", "description_candidates"} & set(out.columns) and not [x for x in out.columns if x.startswith("t_")]
    assert out.count() == classify.table(spark, sf, "documents").count()
    assert sum(os.path.getsize(f[len("file:"):] if f.startswith("file:") else f) for f in (x.replace("file://", "") for x in out.inputFiles())) < sum(map(os.path.getsize, glob.glob(f"{sf}/documents.parquet")))


def test_words_are_found_across_the_parts_of_a_text(spark):
    """Pieces are read once each, what is known of others counts, and a phrase may lie across two of them."""
    from pyspark.sql import functions as F

    from linkloom.functions import text

    df = spark.createDataFrame([("we Start", "now C++ 教程", "Clown")], "a string, b string, d string")
    words = ["we", "start now", "c++", "教程", "clown", "own", "ow"]
    low = [F.lower("a"), F.lower("b"), F.lower("a")]
    whole = F.concat_ws(" ", "a", "b", "d")
    got = df.select(text.found_keywords(whole, words, low, [text.words_in(F.lower("d"), words)]), text.found_keywords(whole, words)).first()
    assert set(got[0]) == set(got[1]) == {"we", "start now", "c++", "教程", "clown"}
