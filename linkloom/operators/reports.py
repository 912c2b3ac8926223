"""Reports on a finished run: quality metrics and guardrails, label hygiene, summaries of clusters and bundles for an external taxonomy."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon, text, urls
from . import clusters, display, signals, trees
from .skew import top, written

QUALITY_VERSION, BOOTSTRAP_VERSION, FOLLOWUP_VERSION = "quality_report/v2", "taxonomy_bootstrap_clusters/v1", "taxonomy_followup_candidates/v1"
GUARDRAILS = ("folder_only", "low_confidence_normal", "platform_domain_suggestions", "blocked_discovery_clusters", "display_missing", "display_repeated")


def platform_share(domains: Column) -> Column:
    """The largest share of a generic platform among a cluster's domains."""
    hosted = F.filter(domains, lambda d: urls.generic_platform(F.lower(d["value"])))
    return F.coalesce(F.array_max(F.transform(hosted, lambda d: d["share"])), F.lit(0.0))


def _normal(root: Column, o: clusters.Options) -> Column:
    return ~root.isin(o.discovery, o.tidy)


def label_issues(profiles: DataFrame, options: clusters.Options = clusters.Options()) -> DataFrame:
    """Clusters whose label names a platform, a source or nothing, or their own host in discovery; largest first, then by label."""
    c = F.col
    key = text.token(c("label"))
    codes = {
        "generic_platform_label": key.isin(*lexicon.GENERIC_PLATFORM_TOKENS), "source_host_label": (c("destination_root") == options.discovery) & clusters.host_label(c("label"), c("domains")),
        "source_or_noisy_label": text.source_like(c("label")) | text.noisy(c("label")),
    }
    found = F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in codes.items()]))
    rows = profiles.select("cluster_id", "label", "size", "destination_root", found.alias("issue_codes")).where(F.size("issue_codes") > 0)
    return rows.orderBy(c("size").desc(), "label")


def flat_roots(sources: DataFrame, options: clusters.Options = clusters.Options()) -> DataFrame:
    """Normal roots of five or more records of which half lie in no folder; most such records first."""
    c = F.col
    rows = sources.where(_normal(c("root"), options)).groupBy("root").agg(F.count(F.lit(1)).alias("records"), F.count_if(c("folder") == "").alias("direct"), F.count_distinct(F.nullif("folder", F.lit(""))).alias("folders"))
    rows = rows.withColumn("direct_share", F.bround(c("direct") / c("records"), 4))
    return rows.where((c("records") >= 5) & (c("direct") / c("records") >= 0.5)).orderBy(c("direct").desc(), c("direct_share").desc(), "root")


def mixed(profiles: DataFrame) -> Column:
    return (F.size("categories") > 1) & (F.get("categories", F.lit(0))["share"] < 0.7)


def largest(profiles: DataFrame, where: Column, *columns: str, limit: int = 10) -> DataFrame:
    """The largest clusters of a kind, ties in the order of clusters (a report)."""
    return profiles.where(where).orderBy(F.col("size").desc(), "cluster_order").limit(limit).select("cluster_id", "label", "size", *columns)


def sections(profiles: DataFrame, options: clusters.Options = clusters.Options()) -> dict[str, DataFrame]:
    """The lists of a quality report, ten rows each: largest clusters of each kind, and those of the lowest purity."""
    c, o = F.col, options
    named = profiles.withColumns({"platform": platform_share(c("domains")), "top_domains": F.slice("domains", 1, 4), "first_categories": F.slice("categories", 1, 4), "first_tokens": F.slice("tokens", 1, 6)})
    low = named.where(_normal(c("destination_root"), o) & (c("rule_purity") < 0.7)).orderBy("rule_purity", c("size").desc(), "cluster_order").limit(10)
    return {
        "largest_discovery_clusters": largest(named, c("destination_root") == o.discovery, "first_tokens"), "largest_tidy_clusters": largest(named, c("destination_root") == o.tidy, "first_tokens"),
        "largest_mixed_clusters": largest(named, mixed(named), "first_categories"), "largest_generic_platform_clusters": largest(named, c("platform") >= 0.45, "platform", "top_domains", "first_categories"),
        "largest_fetch_blocked_clusters": largest(named, c("fetch_blocked_share") >= 0.5, "fetch_blocked_share", "top_domains"),
        "lowest_purity_normal_clusters": low.select("cluster_id", "label", "size", "rule_purity", "destination_root", "first_categories"),
    }


def review_hotspots(classified: DataFrame) -> DataFrame:
    """(kind, value, links): reasons (ten) and domains (twenty) of links that need review, most first, ties by first appearance (a report)."""
    c = F.col
    rows = classified.where("review_required").withColumn("all", F.lit(0))
    host = F.when(c("domain") != "", c("domain")).otherwise(F.when(urls.host(F.coalesce("url", F.lit(""))) != "", urls.host(F.coalesce("url", F.lit("")))).otherwise("unknown"))
    code = F.when(c("reason_code") == "", "unknown").otherwise(c("reason_code"))
    parts = [top(rows, "all", v, at=c("ord"), limit=n, name="t").select(F.lit(kind).alias("kind"), F.explode("t").alias("x")) for kind, v, n in (("reason_code", code, 10), ("domain", host, 20))]
    return parts[0].unionByName(parts[1]).select("kind", F.col("x.value").alias("value"), F.col("x.n").alias("links"))


def quality_report(classified: DataFrame, profiles: DataFrame, suggested: DataFrame, sources: DataFrame, folders: DataFrame, shown: DataFrame, options: clusters.Options = clusters.Options(), auto: float = lexicon.AUTO_CONFIDENCE) -> DataFrame:
    """One row with the metrics of a run, its guardrails (values that must be zero), warnings and verdict.

    ``classified`` are records (with a numeric id); the other tables are those of `clusters` and `display`.  Each part is an aggregate of one row.
    """
    c, o, lit = F.col, options, F.lit
    one = F.count(F.lit(1))
    off = c("category").isin(o.tidy, lexicon.UNSORTED)
    topless = F.size("scores") > 0
    records = classified.agg(
        one.alias("total"), F.count_if(topless & (F.size(F.get("scores", lit(0))["signals"]) == 0)).alias("folder_only"),
        F.count_if(~off & (c("rule_confidence") < auto)).alias("low_confidence_normal"), F.count_if(c("review_required")).alias("review_required_count"),
        F.count_if(c("review_required") & (c("category") != "") & ~off).alias("review_required_normal"), F.count_if(c("user_action_required")).alias("user_action_required_count"),
    )
    normal = _normal(c("destination_root"), o)
    share = platform_share(c("domains"))
    low = normal & (c("rule_purity") < 0.7)
    sized = lambda where: F.coalesce(F.sum(F.when(where, c("size"))), lit(0))
    by_cluster = profiles.agg(
        F.count_if(c("destination_root") == o.discovery).alias("discovery_clusters"), F.count_if(c("destination_root") == o.tidy).alias("tidy_clusters"), F.count_if(mixed(profiles)).alias("mixed_clusters"),
        F.count_if(share >= 0.45).alias("platform_clusters"), F.coalesce(F.max(F.when(share >= 0.45, c("size"))), lit(0)).alias("largest_platform_cluster"),
        F.count_if((c("destination_root") == o.discovery) & (c("fetch_blocked_share") >= 0.5)).alias("blocked_discovery_clusters"), sized(normal).alias("normal_records"),
        sized(c("destination_root") == o.discovery).alias("discovery_records"), sized(c("destination_root") == o.tidy).alias("tidy_records"), F.count_if(low).alias("low_purity_clusters"), sized(low).alias("low_purity_records"),
        F.bround(F.coalesce(F.sum(F.when(normal, c("rule_purity") * c("size"))) / F.nullif(sized(normal), lit(0)), lit(0.0)), 4).alias("weighted_purity"),
    )
    bound = suggested.select(F.explode("proposed_domains").alias("d")).agg(F.count_if(urls.generic_platform(F.lower("d"))).alias("platform_domain_suggestions"))
    issues = label_issues(profiles, o).agg(one.alias("label_issues"))
    rooted = sources.where(_normal(c("root"), o)).agg(F.count_if(c("folder") == "").alias("normal_direct"), one.alias("normal_shown"))
    flat = flat_roots(sources, o).agg(one.alias("flat_roots"))
    shape = trees.quality(folders, records="direct").select(*[F.coalesce(x, lit(0)).alias(f"tree_{x}") for x in ("folders", "leaves", "singletons", "max_depth", "max_leaf", "oversized")])
    first = folders.where("depth = 1")
    names = first.agg(one.alias("display_roots"), F.count_if(_normal(c("name"), o)).alias("display_normal_roots"), F.coalesce(F.max(F.when(c("name") == o.discovery, (c("records") < 3).cast("int"))), lit(0)).alias("small_discovery_alone"))
    below = folders.where((F.get("path", lit(0)) == o.tidy) & (c("depth") >= 2))
    tidy = below.agg(
        F.count_if(c("depth") == 3).alias("tidy_groups"), F.count_if((c("depth") == 3) & (c("records") <= 2)).alias("tidy_small_groups"),
        F.coalesce(F.sum(F.when(c("depth") == 2, c("direct"))), lit(0)).alias("tidy_direct"), F.coalesce(F.max((c("name") == o.discovery).cast("int")), lit(0)).alias("discovery_in_tidy"),
    )
    identity = F.coalesce(F.nullif("record", lit("")), "url").alias("identity")
    kept = trees.conservation(classified.select(identity), display.displayed(shown, classified), "identity").select(c("missing").alias("display_missing"), c("repeated").alias("display_repeated"))
    out = records
    for part in (by_cluster, bound, issues, rooted, flat, shape, names, tidy, kept):
        out = out.crossJoin(part)  # one row each
    ratio = lambda a, b, other: F.coalesce(F.bround(c(a) / F.nullif(c(b), lit(0)), 4), lit(other))
    out = out.withColumns({
        "normal_direct_share": ratio("normal_direct", "normal_shown", 0.0), "normal_share": ratio("normal_records", "total", 0.0), "unavailable_normal_share": ratio("review_required_normal", "review_required_count", 1.0),
        "review_required_default": c("review_required_count") - c("review_required_normal"),
    })
    failed = F.array_compact(F.array(*[F.when(c(g) != 0, lit(g)) for g in GUARDRAILS]))
    warned = {
        "low_purity_normal_clusters": c("low_purity_records") > 0, "source_or_platform_cluster_labels": c("label_issues") > 0, "oversized_leaf_folders": c("tree_oversized") > 0,
        "too_many_singleton_leaf_folders": (c("tree_leaves") > 0) & (c("tree_singletons") / F.greatest(c("tree_leaves"), lit(1)) >= 0.35),
    }
    out = out.withColumns({"failed_guardrails": failed, "warnings": F.array_compact(F.array(*[F.when(w, lit(k)) for k, w in warned.items()]))})
    return out.withColumns({"guardrails": F.when(F.size("failed_guardrails") == 0, "pass").otherwise("fail"), "verdict": F.when(F.size("failed_guardrails") > 0, "fail").when(F.size("warnings") > 0, "needs_review").otherwise("pass"), "schema_version": lit(QUALITY_VERSION)})


def outcome(classified: DataFrame, profiles: DataFrame) -> DataFrame:
    """(kind, value, records): records by destination root and by confirmation bucket, in the order of their names."""
    by_root = profiles.groupBy(F.col("destination_root").alias("value")).agg(F.sum("size").alias("records")).select(F.lit("destination").alias("kind"), "value", "records")
    by_bucket = classified.groupBy(F.col("confirmation_bucket").alias("value")).agg(F.count(F.lit(1)).alias("records")).select(F.lit("bucket").alias("kind"), "value", "records")
    return by_root.unionByName(by_bucket).orderBy("kind", "value")


def signal_audit(classified: DataFrame, features: DataFrame, by: str = "field", records: DataFrame | None = None) -> DataFrame:
    """`signals.audit` of classified records and their features: what they have, what classification and clustering drew on.

    ``records`` are those with signals, where classified ones come without them.
    """
    there = signals.fields(signals.nested(classified if records is None else records, "id"))
    features = features.withColumn("id", F.col("record")) if "record" in features.columns else features

    def used(rows: DataFrame, column: str, kind: str) -> DataFrame:
        f = rows.select("id", F.explode(column).alias("f"))
        return f.select("id", F.split_part("f", F.lit("."), F.lit(1)).alias("family"), F.split_part("f", F.lit("."), F.lit(2)).alias("field"), F.lit(kind).alias("kind"))

    return signals.audit(there, used(classified, "used_signal_fields", "classify").unionByName(used(features, "feature_fields", "cluster")), by)


def audit_hotspots(classified: DataFrame) -> DataFrame:
    """(kind, route, domain, records): domains of rule gaps (fifteen), and routes with domains that need review (twenty); ties by first appearance (a report)."""
    c = F.col
    host = F.when(c("domain") != "", c("domain")).otherwise(F.coalesce(F.nullif(urls.host(F.coalesce("url", F.lit(""))), F.lit("")), F.lit("unknown")))
    rows = classified.withColumns({"host": host, "way": F.coalesce("route", F.lit("unknown"))})
    gaps = rows.where("confirmation_bucket = 'rule_gap'").groupBy("host").agg(F.count(F.lit(1)).alias("records"), F.min("ord").alias("at")).orderBy(c("records").desc(), "at").limit(15)
    bad = rows.where("review_required").groupBy("way", "host").agg(F.count(F.lit(1)).alias("records"), F.min("ord").alias("at")).orderBy(c("records").desc(), "at").limit(20)
    return gaps.select(F.lit("rule_gap").alias("kind"), F.lit("").alias("route"), c("host").alias("domain"), "records").unionByName(bad.select(F.lit("review").alias("kind"), c("way").alias("route"), c("host").alias("domain"), "records"))


def _identity() -> Column:
    return F.when(F.col("canonical") != "", F.col("canonical")).otherwise(F.coalesce("url", "record"))


def bootstrap(profiles: DataFrame, members: DataFrame, features: DataFrame) -> DataFrame:
    """Clusters as an external taxonomy is asked about them: label, tokens, topics, domains, kinds, shares, identities, five records; largest first, then by id."""
    c = F.col
    rows = members.select("id", "cluster").join(features, "id")
    kinds = top(rows, "cluster", F.coalesce(F.nullif("resource_type", F.lit("")), F.lit(lexicon.UNKNOWN)), at=c("id"), limit=6, name="resource_types")
    identities = rows.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", _identity().alias("i")))), lambda x: x["i"]).alias("identities"))
    out = profiles.join(kinds, "cluster", "left").join(identities, "cluster").join(clusters.representatives(members, features), "cluster")
    out = out.select(
        "cluster_id", "label", "size", F.slice("tokens", 1, 8).alias("tokens"), F.slice(F.transform("hints_found", lambda h: h["value"]), 1, 8).alias("topics"), F.slice("domains", 1, 6).alias("domains"), "resource_types",
        F.bround(platform_share(c("domains")), 4).alias("generic_platform_share"), "fetch_blocked_share", c("review_share").alias("review_required_share"), "identities", "records",
    )
    return out.orderBy(c("size").desc(), "cluster_id")


def registered_domain() -> Column:
    low = F.lower(F.col("registrable_domain"))
    return F.when(low != "", low).otherwise(F.lower(F.coalesce("domain", F.lit(""))))


def summarize(rows: DataFrame, key: str) -> DataFrame:
    """What is told of bundles: identities, support, topics, hints, kinds, buckets, domains (eight each), nearest rules (five), five records, the platforms' share."""
    c = F.col
    domain = registered_domain()
    at = c("id")
    out = rows.groupBy(key).agg(
        F.array_sort(F.collect_set(_identity())).alias("identities"), F.count(F.lit(1)).alias("support"),
        F.bround(F.coalesce(F.count_if((domain != "") & urls.generic_platform(domain)) / F.nullif(F.count_if(domain != ""), F.lit(0)), F.lit(0.0)), 4).alias("generic_platform_share"),
    )
    hints = rows.select(key, "id", F.posexplode(F.slice("cluster_hints", 1, 4)).alias("n", "hint"))
    near = rows.select(key, "id", F.posexplode(F.slice("rule_candidates", 1, 3)).alias("n", "x"))
    spot = F.struct("id", "n")
    parts = [
        top(rows, key, F.get("open_topics", F.lit(0))["topic"], at=at, limit=8, name="topics"), top(hints, key, c("hint"), at=spot, limit=8, name="hints"),
        top(rows, key, F.coalesce(F.nullif("resource_type", F.lit("")), F.lit(lexicon.UNKNOWN)), at=at, limit=8, name="resource_types"), top(rows, key, c("confirmation_bucket"), at=at, limit=8, name="buckets"),
        top(rows, key, domain, at=at, limit=8, name="domains"), top(near, key, c("x.category"), at=spot, limit=5, name="nearest_rules"),
    ]
    for part in parts:
        out = out.join(part, key, "left")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    few = rows.withColumn("rank", rank).where(c("rank") <= 5).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record", "name", "url", "domain", "resource_type"))), lambda x: x.dropFields("rank")).alias("records"))
    return out.join(few, key, "left")


def followup(profiles: DataFrame, members: DataFrame, features: DataFrame, options: clusters.Options = clusters.Options()) -> DataFrame:
    """Bundles of what no rule settles, for a second round of an external taxonomy: tidy clusters, then bundles by meaning, then groups by topic, kind and site; two records each at least.

    Records count if their bucket is rule_gap or low_confidence and they need no review.  Most support first, then by type, then by id.
    """
    c, o = F.col, options
    able = features.where(c("confirmation_bucket").isin("rule_gap", "low_confidence") & ~c("review_required")).withColumn("identity", _identity())
    tidy = members.select("id", "cluster").join(profiles.where(c("destination_root") == o.tidy).select("cluster", "cluster_id", "label"), "cluster")
    rows = written(tidy.select("id", "cluster", "cluster_id", "label").join(able, "id"))
    whole = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("cluster")
    first = rows.join(whole, "cluster", "left_semi").withColumn("key", c("cluster").cast("string"))
    rest = able.join(first.select("identity").distinct(), "identity", "left_anti").withColumn("bucket_name", display.bucket_name(c("confirmation_bucket")))
    rest = written(rest)
    bundled = display.semantic_bundles(rest, tidy=o.tidy)
    second = rest.drop("bucket_name").join(bundled.where("bundle is not null"), "id").withColumn("key", F.concat_ws("\x1f", "bucket_name", "root_hint", "bundle", F.array_join("sources", ",")))
    left = rest.join(second.select("identity").distinct(), "identity", "left_anti")
    topic = text.token(F.coalesce(F.get("open_topics", F.lit(0))["topic"], F.lit("")))
    domain = registered_domain()
    left = left.withColumns({"topic_key": topic, "site": F.when(urls.generic_platform(domain), "").otherwise(domain), "kind_name": F.coalesce(F.nullif("resource_type", F.lit("")), F.lit(lexicon.UNKNOWN))}).where("topic_key <> ''")
    groups = left.groupBy("topic_key", "kind_name", "site").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    third = left.join(groups, ["topic_key", "kind_name", "site"], "left_semi").withColumn("key", F.concat_ws("\x1f", "topic_key", "kind_name", "site"))
    none = F.lit("")
    makers = (
        ("cluster", first, first.groupBy("key").agg(F.first("cluster_id").alias("source_cluster_id"), F.first("label").alias("named")).withColumns({"bucket_name": none, "root_hint": none, "aggregate_key": none})),
        ("tidy_semantic", second, second.groupBy("key").agg(F.first("bundle").alias("named"), F.first("bucket_name").alias("bucket_name"), F.first("root_hint").alias("root_hint")).withColumns({"source_cluster_id": none, "aggregate_key": none})),
        ("aggregate", third, third.groupBy("key").agg(F.first("topic_key").alias("named"), F.first(F.concat_ws("|", "topic_key", "kind_name", "site")).alias("aggregate_key")).withColumns({"source_cluster_id": none, "bucket_name": none, "root_hint": none})),
    )
    out = None
    for kind, members_of, shape in makers:
        told = summarize(members_of, "key").join(shape, "key")
        label = F.coalesce(F.get("topics", F.lit(0))["value"], c("named")) if kind == "aggregate" else c("named")
        told = told.select(F.lit(kind).alias("bundle_type"), "source_cluster_id", label.alias("label"), "bucket_name", "root_hint", "aggregate_key", *[x for x in told.columns if x not in ("key", "named", "source_cluster_id", "bucket_name", "root_hint", "aggregate_key")])
        out = told if out is None else out.unionByName(told)
    prefix = F.when(c("bundle_type") == "tidy_semantic", "ts_").otherwise("tf_")
    out = out.withColumn("bundle_id", F.concat(prefix, F.substring(F.sha1(F.array_join("identities", "\n").cast("binary")), 1, 12)))
    return out.orderBy(c("support").desc(), "bundle_type", "bundle_id")


def counter_rows(rows: DataFrame, value: Column, at: Column, limit: int) -> DataFrame:
    """(value, n): the most frequent values, ties by first appearance; blank ones are dropped after the limit (a report)."""
    counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"))
    return counts.orderBy(F.col("n").desc(), "at").limit(limit).where("value <> ''").select("value", "n")


def _shape() -> str:
    return json.dumps(
        {
            "schema_version": "user_taxonomy_response/v1", "root_groups": [{"name": "group", "roots": ["root"]}],
            "categories": [{"path": "root/topic", "description": "what belongs here", "aliases": ["stable token"], "title_patterns": ["literal words", {"regex": "\\bregex\\b"}], "topic_domains": ["example.org"]}],
            "cluster_assignments": [{"cluster_id": "id from below", "category": "root/topic", "confidence": "high"}], "uncategorized_cluster_ids": [], "notes": [],
        }, ensure_ascii=False, indent=2,
    )


def prompt(rows: DataFrame, title: str, limit: int, names: dict[str, str]) -> str:
    """A Markdown request for a taxonomy: rules, the form of the answer, and the first ``limit`` rows; ``names`` are columns and what they are called.

    Only these rows reach the driver.
    """
    lines = [
        f"# {title}", "", "Propose a taxonomy for the groups below, and a category for each group.", "",
        "- Platforms that host many subjects (code hosts, question sites, video sites) are no topic domains.", "- Category paths have one to three parts, joined by `/`.",
        '- Strings in `title_patterns` are taken literally; write `{"regex": "..."}` for a regular expression.', "- `confidence` is `high`, `medium` or `low`.", "- Answer with one fenced `json` block and nothing else:", "",
        "```json", _shape(), "```", "",
    ]
    for row in rows.limit(limit).collect():
        given = row.asDict(recursive=True)
        lines.append(f"## {given.get('cluster_id') or given.get('bundle_id')} · {given.get('label') or 'unnamed'} · {given.get('size') or given.get('support')}")
        lines += [f"- {shown}: {json.dumps(given[column], ensure_ascii=False, default=str)}" for column, shown in names.items()]
        lines += [f"  - {r['name']} | {r['domain']} | {r['url']}" for r in given.get("records") or []]
        lines.append("")
    return "\n".join(lines)


def bootstrap_prompt(rows: DataFrame, limit: int = 120) -> str:
    return prompt(rows, "Taxonomy: first round", limit, {"tokens": "tokens", "topics": "topics", "domains": "domains", "resource_types": "kinds", "generic_platform_share": "share of platforms", "fetch_blocked_share": "share not fetched", "review_required_share": "share to review"})


def followup_prompt(rows: DataFrame, limit: int = 40) -> str:
    return prompt(rows, "Taxonomy: what is left", limit, {"bundle_type": "type", "topics": "topics", "hints": "hints", "resource_types": "kinds", "buckets": "buckets", "domains": "domains", "nearest_rules": "nearest categories", "generic_platform_share": "share of platforms"})
