"""Feature sets of classified records: what they are compared and clustered by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon, text, urls
from .rules import homepage_only

_NONE = "array<string>"
#: Columns of a feature set beside the record's own.
SETS = ("tokens", "topics", "hints", "path", "site", "domain_tokens", "kinds", "quality", "times")


def cluster_text() -> Column:
    """The text that keyword groups are made of."""
    words = lambda x: F.array_join(F.col(x), " ")
    return text.joined(F.col("preferred_title"), F.col("preferred_description"), F.col("keywords_text"), words("page_type_hints"), F.col("site_name"), words("brand_terms"), words("headings_h2"))


def source_like_topic(topic: Column) -> Column:
    """A topic that names a code host rather than a subject."""
    low = F.lower(topic)
    return F.exists(F.array(*map(F.lit, ("github", "gitlab", "gitee", "git/", "/git"))), lambda w: F.contains(low, w))


def _slashed(x: Column) -> Column:
    return text.keywords(F.replace(x, F.lit("/"), F.lit(" ")))


def feature_sets(classified: DataFrame) -> DataFrame:
    """Classified records with their features.

    On platforms titles are cut to their leading part, words of platforms are dropped and the site says nothing; for pages
    known by their site's homepage alone the site says nothing either.  Sets are sorted arrays of distinct members.
    """
    c = F.col
    none = F.array().cast(_NONE)
    host = F.lower(F.when(c("domain") != "", c("domain")).otherwise(urls.host(F.coalesce("url", F.lit("")))))
    rows = classified.withColumns({"low_domain": host})
    labels = F.filter(F.split("low_domain", r"\."), lambda x: x != "")
    rows = rows.withColumn("registered", F.when(F.size(labels) <= 2, c("low_domain")).otherwise(urls.by_country(F.array_join(labels, "."))))
    rows = rows.withColumns({"platform": urls.generic_platform(c("registered")), "home_only": homepage_only()})
    cut = lambda x: F.when(c("platform"), text.leading_segment(x)).otherwise(x)
    less = lambda x: F.when(c("platform"), F.array_except(x, F.array(*map(F.lit, lexicon.GENERIC_PLATFORM_TOKENS)))).otherwise(x)
    words = lambda x: F.array_join(c(x), " ")
    sure = lambda least, x: F.when(c("rule_confidence") >= least, x).otherwise(none)
    rows = rows.withColumns({
        "title_tokens": less(text.keywords(text.joined(cut(c("preferred_title")), cut(words("title_candidates")), c("preferred_description"), words("headings_h1"), c("keywords_text")))),
        "path": text.path_keywords(F.coalesce("url", F.lit(""))), "hint_words": text.keywords(words("cluster_hints")), "semantic_words": text.keywords(c("semantic_text")),
        "domain_tokens": less(text.keywords(F.replace("low_domain", F.lit("."), F.lit(" ")))),
        "site": F.when(c("platform") | c("home_only"), none).otherwise(text.keywords(text.joined(F.replace("low_domain", F.lit("."), F.lit(" ")), c("site_name"), words("brand_terms"), words("source_facets")))),
        "by_name": F.transform(F.array_sort(F.transform("scores", lambda s: F.struct((-s["total"]).alias("down"), s["category"].alias("category")))), lambda s: s["category"]),
    })
    # words of title and path that name no kind of page: those in both first, then by name, four of them
    named = lambda x: F.filter(x, lambda w: ~w.isin(*lexicon.URL_TYPES))
    both = F.array_intersect(named(c("title_tokens")), named(c("path")))
    topical = F.slice(F.concat(F.array_sort(both), F.array_sort(F.array_except(F.array_union(named(c("title_tokens")), named(c("path"))), both))), 1, 4)
    primary = (
        F.when((c("rule_confidence") >= 0.75) & (F.size("rule_candidates") > 0), F.get("rule_candidates", F.lit(0))["category"]).when(F.size("open_topics") > 0, F.get("open_topics", F.lit(0))["topic"])
        .when(~c("category").isin("", lexicon.DEFAULT_CATEGORY, lexicon.UNSORTED), c("category")).when(F.size("cluster_hints") > 0, F.get("cluster_hints", F.lit(0)))
        .when(F.size("by_name") > 0, F.get("by_name", F.lit(0))).otherwise(F.lit(lexicon.UNSORTED))
    )
    rows = rows.withColumns({"topic": F.when(primary == "", F.lit(lexicon.UNSORTED)).otherwise(primary), "topical": topical})
    candidates = F.flatten(F.transform(F.slice("rule_candidates", 1, 3), lambda x: F.array(x["category"], x["leaf"])))
    collected = F.concat(
        c("hint_words"), sure(0.75, _slashed(c("category"))), sure(0.6, _slashed(F.array_join(F.concat(candidates, F.slice("by_name", 1, 3)), " "))),
        text.keywords(F.array_join(F.transform(F.slice("open_topics", 1, 4), lambda x: x["topic"]), " ")), c("topical"),
    )
    own = F.when(c("platform") & source_like_topic(c("topic")), _slashed(c("topic"))).otherwise(none)
    explicit = F.when(F.trim(F.coalesce("resource_type", F.lit(""))) != "", F.array(text.resource_name(c("resource_type")))).otherwise(none)
    listed = F.array_distinct(F.concat(explicit, F.transform("resource_facets", text.resource_name), text.url_types(c("path"))))
    says = lambda told, *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(told, w))
    guess = (
        F.when(F.contains("low_domain", F.lit("github")) | F.arrays_overlap("path", F.array(F.lit("repo"), F.lit("repos"))), F.lit("仓库"))
        .otherwise(text.let(F.lower("semantic_text"), lambda told: F.when(says(told, "paper", "arxiv", "论文"), F.lit("论文")).when(says(told, "tool", "tools", "playground", "generator"), F.lit("工具")).otherwise(F.lit(lexicon.UNKNOWN))))
    )
    shown = lambda x: F.filter(F.transform(x, text.human_label), lambda v: v != "")
    heavier = F.transform("rule_roots", lambda r: F.struct(r["root"].alias("key"), F.when(r["support"] > 0, r["support"]).otherwise(r["total"]).alias("value")))
    extra = lambda where, name: F.when(where, F.lit(name))
    used = F.concat(F.array(*map(F.lit, lexicon.FEATURE_FIELDS)), F.array_compact(F.array(
        extra(F.size("site_type_candidates") > 0, "structure.site_type_candidates"), extra(F.size("schema_types") > 0, "structure.schema_types"), extra(F.size("headings_h2") > 0, "structure.headings_h2"),
        extra(c("review_required") | c("trusted_override"), "health_access.review_required"), extra(c("route").isNotNull(), "health_access.fetch_context"),
    )))
    tidy = lambda x: F.array_sort(F.array_distinct(x))
    bucket = F.array("time_bucket.year", "time_bucket.year_month", "time_bucket.year_week")
    rows = rows.withColumns({
        "tokens": tidy(F.concat("title_tokens", less(c("semantic_words")))), "topics": tidy(F.array_except(less(collected), own)), "hints": tidy(less(c("hint_words"))), "path": tidy(c("path")), "site": tidy(c("site")),
        "domain_tokens": tidy(c("domain_tokens")), "kinds": F.when(F.size(listed) > 0, tidy(listed)).otherwise(F.array(guess)), "quality": tidy(shown(F.concat("quality_signals", "quality_facets"))),
        "times": tidy(F.filter(bucket, lambda v: v != "")), "roots": F.map_from_entries(heavier), "confidence": c("rule_confidence"), "canonical": c("canonical_identity"), "feature_fields": tidy(used),
    })
    return rows.withColumn("kind", text.choose_resource(c("kinds"))).drop("title_tokens", "hint_words", "semantic_words", "topical", "by_name")


def top_root(roots: Column) -> Column:
    """The heaviest root, ties by name; null without roots."""
    return F.array_min(F.transform(F.map_entries(roots), lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("root"))))["root"]
