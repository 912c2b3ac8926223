"""Queries on the signal column, quality guardrails and display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import lexicon, text
from ..operators import clusters, display, features, fetch, health, reports, rules, signals
from . import classify
from .classify import DECIDE_SQL, pages_sql, saved_pages
from .common import normal_sql, table
from .links import ATTEMPTS_SQL, HEALTH_SQL, _attempts


def signal_pack_rows(spark, sf_dir) -> DataFrame:
    """The nested signal column of pages: a field of each family."""
    p = signals.require_version(signals.nested(saved_pages(spark, sf_dir)), signals.VERSION, "signals")
    s = "signal_pack"
    return p.select(
        "id", F.col(f"{s}.identity.canonical_identity").alias("identity"), F.col(f"{s}.identity.registrable_domain").alias("registrable"), F.col(f"{s}.content.preferred_title").alias("preferred_title"),
        F.col(f"{s}.content.preferred_description").alias("description"), F.col(f"{s}.content.language").alias("language"), F.array_join(f"{s}.structure.source_facets", "|").alias("source_facets"),
        F.array_join(f"{s}.health_access.quality_facets", ",").alias("quality"), F.col(f"{s}.health_access.review_required").alias("review"), F.size(f"{s}.content.title_candidates").alias("titles"),
    )


def signal_flatten_counts(spark, sf_dir) -> DataFrame:
    """For each signal field: how many pages have it."""
    there = signals.fields(signals.nested(saved_pages(spark, sf_dir)))
    return there.groupBy("family", "field").agg(F.count(F.lit(1)).alias("present"))


def signal_audit(spark, sf_dir) -> DataFrame:
    """Fields of pages: collected, used by features, moved by them; nothing classifies here."""
    rows = saved_pages(spark, sf_dir)
    there = signals.fields(signals.nested(rows))
    cells = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("family", "field"), f.split("."))]) for f in lexicon.FEATURE_FIELDS])
    used = rows.select("id", F.explode(cells).alias("c")).select("id", "c.family", "c.field", F.lit("cluster").alias("kind"))
    return signals.audit(there, used)


def full_signal_audit(spark, sf_dir) -> DataFrame:
    """Rows only: the same of documents that are classified and have features."""
    classified, records = classify.classified(spark, sf_dir), classify.records(spark, sf_dir)
    whole = records.join(classified.drop(*set(records.columns) - {"id"}), "id")  # features read sizes and marks here, so no text is shuffled
    return reports.signal_audit(classified, features.feature_sets(whole), records=records)


def site_types(spark, sf_dir) -> DataFrame:
    """Site name, brand terms and site types of pages with their site's first page as the homepage."""
    rows = saved_pages(spark, sf_dir)
    empty = F.lit("")
    page = F.struct(empty.alias("og_site_name"), empty.alias("og_title"), F.col("name").alias("title"))
    homes = rows.groupBy("domain").agg(F.min_by(F.struct(empty.alias("og_site_name"), F.col("name").alias("title"), F.col("page_type_hints").alias("hints")), "ord").alias("home"))
    both = rows.join(homes, "domain")
    name = fetch.site_name(page, F.col("home"), F.col("registrable_domain"))
    brands = fetch.brand_terms(name, F.col("registrable_domain"), F.col("name"))
    kinds = fetch.site_types(F.col("page_type_hints"), F.col("home.hints"), F.concat(F.lit("https://"), F.col("domain"), F.lit("/")), empty)
    return both.select("id", name.alias("site_name"), F.array_join(F.array_intersect(F.split("registrable_domain", r"\."), brands), ",").alias("domain_terms"), F.array_join(kinds, ",").alias("site_types"))


def fetch_needs(spark, sf_dir) -> DataFrame:
    """What is to be fetched further: homepages of pages that say little, second tries of pages to which access is limited."""
    rows = saved_pages(spark, sf_dir)
    none = F.lit("")
    page = F.struct(*[none.alias(x) for x in ("og_title", "twitter_title", "jsonld_title", "og_description", "twitter_description", "jsonld_description", "description", "jsonld_article_body", "content_preview")], F.col("name").alias("title"), "h1", F.col("main_text").alias("main_text_preview"))
    code = F.when(F.col("ord") % 3 == 0, 403).when(F.col("ord") % 3 == 1, 404).otherwise(200)
    return rows.select(
        "id", fetch.wants_homepage(page, F.col("path_segments")).alias("homepage"), fetch.low_value(page).alias("low_value"), fetch.wants_warmup(code, F.col("path_segments")).alias("warmup"),
        fetch.wants_homepage(page, F.col("path_segments"), F.when(F.col("ord") % 4 == 0, False)).alias("homepage_overridden"),
    )


def quality_guardrails(spark, sf_dir) -> DataFrame:
    """One row: values that must be zero, and the verdict."""
    d = classify.decision_cascade(spark, sf_dir)
    off = F.col("category") == lexicon.DEFAULT_CATEGORY
    one = d.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~off & (F.col("rule_confidence") < lexicon.AUTO_CONFIDENCE)).alias("low_confidence_normal"),
        F.count_if((F.col("bucket") == "fetch_blocked") & (F.col("category") == lexicon.DISCOVERY_ROOT)).alias("blocked_discovery"), F.count_if(off).alias("tidy"),
    )
    return one.withColumn("verdict", F.when((F.col("low_confidence_normal") == 0) & (F.col("blocked_discovery") == 0), F.when(F.col("tidy") > 0.5 * F.col("records"), "needs_review").otherwise("pass")).otherwise("fail"))


def dominant_label(spark, sf_dir) -> DataFrame:
    """Of each source: the category leaf that most of its confidently classified records share, at least two."""
    rows = classify.scored(spark, sf_dir).withColumn("confidence", rules.raw_confidence(F.col("scores"))).where("confidence >= 0.72")
    counts = rows.groupBy("source", text.category_leaf(F.get("scores", F.lit(0))["category"]).alias("label")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "label"))
    return counts.withColumn("rank", rank).where("rank = 1").select("source", "label", "n")


def two_pass_cache(spark, sf_dir) -> DataFrame:
    """The better result of two fetch passes for each link; the second decides ties."""
    tried = health.link_health(_attempts(spark, sf_dir)).select("user_id", "status", "review_required", F.col("event_id").alias("ord"))
    priority = health.cache_priority(F.col("status"), F.col("review_required"))
    last = lambda rows: rows.groupBy("user_id").agg(F.max(F.struct(priority.alias("p"), "ord", "status", "review_required")).alias("r")).select("user_id", "r.status", "r.review_required", "r.ord")
    return fetch.two_passes(last(tried.where("ord % 2 = 0")), last(tried.where("ord % 2 = 1")), "user_id", priority).select("user_id", "status", "ord")


def domain_hotspots(spark, sf_dir) -> DataFrame:
    """Users as domains, events as fetches of two passes: reviews, changes, reasons and the first links."""
    rows = health.link_health(_attempts(spark, sf_dir)).select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"), F.col("status").alias("fetch_status"), "review_required", "reason_code", F.when(F.col("event_id") % 4 == 1, "proxy").alias("route"), F.lit("n").alias("name"), F.col("event_id").cast("string").alias("url"), F.col("event_id").alias("ord"))
    out = fetch.hotspots(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"))
    shown = lambda x: F.array_join(F.transform(x, lambda v: F.concat(v["value"], F.lit("="), v["n"].cast("string"))), ",")
    return out.select("domain", "review", "total", "success", "review_delta", "success_delta", F.coalesce(shown(F.col("reasons")), F.lit("")).alias("reasons"), F.coalesce(shown(F.col("routes")), F.lit("")).alias("routes"), F.coalesce(F.array_join(F.transform("representatives", lambda r: r["url"]), ","), F.lit("")).alias("urls"))


def auto_root_groups(spark, sf_dir) -> DataFrame:
    """Groups of nations as roots: many of them go under one group, a small discovery root under the tidy one."""
    counts = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("root")).agg(F.count(F.lit(1)).alias("records"))
    found = {r["root"]: r["records"] for r in counts.orderBy("root").collect()} | {lexicon.DEFAULT_CATEGORY: 7, lexicon.DISCOVERY_ROOT: 2}  # a row for each root
    groups = [(name, root, found[root]) for name, roots in display.auto_groups(found) for root in roots]
    return spark.createDataFrame(groups, "shown_under string, root string, records long")


def confirmation_report(spark, sf_dir) -> DataFrame:
    """The rows of the report on records to confirm, without their drivers."""
    rows = rules.confirmation_report(classify.classified(spark, sf_dir))
    return rows.select("id", "name", "score", "fetch_status", F.col("confirmation_bucket").alias("bucket"), F.array_join("primary_topics", ",").alias("primary"), "review_required", F.coalesce("review_category", F.lit("")).alias("review_category"))


def feature_provenance(spark, sf_dir) -> DataFrame:
    """Rows only: signal families and fields that clusters of pages draw on."""
    f = features.feature_sets(rules.classify(saved_pages(spark, sf_dir), [])).withColumn("cluster", F.col("domain"))
    return clusters.provenance(f).select("cluster", F.explode("fields").alias("x")).select("cluster", F.col("x.value").alias("field"), F.col("x.n").alias("records"))


QUERIES = {f.__name__: f for f in (
    signal_pack_rows, signal_flatten_counts, signal_audit, full_signal_audit, site_types, fetch_needs, quality_guardrails, dominant_label, two_pass_cache, domain_hotspots, auto_root_groups, confirmation_report, feature_provenance,
)}

# ---- SQL -----------------------------------------------------------------------------------------

NORMAL = normal_sql("url", False)
#: When a page has a field, in SQL.
THERE = {
    "identity.saved_title": "title <> ''", "identity.normalized_url": "true", "identity.canonical_identity": "true", "identity.domain": "host <> ''", "identity.registrable_domain": "registrable <> ''", "identity.subdomain": "host <> registrable",
    "identity.path_segments": "len(segments) > 0", "identity.query_keys": "query <> ''", "content.preferred_title": "title <> ''", "content.preferred_description": "main <> ''", "content.semantic_text": "title <> '' OR main <> ''", "content.main_text": "main <> ''",
    "content.title_candidates": "title <> '' OR h1 <> ''", "content.description_candidates": "main <> ''", "content.language": "lang <> ''", "structure.page_type_hints": "len(hints) > 0", "structure.resource_facets": "len(hints) > 0",
    "structure.source_facets": "true", "structure.headings_h1": "h1 <> ''", "structure.nav_text": "nav <> ''", "health_access.fetch_status": "true", "health_access.link_health": "true", "health_access.quality_facets": "status = 'success'",
    "health_access.fetch_context": "true", "health_access.trusted_override": "true", "health_access.review_required": "true", "health_access.user_action_required": "true",
}
NAV = r"(SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE left(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?s)<[^>]*>', ' ', 'g'), '[\s\v\x{85}\p{Z}]+', ' ', 'g'), ' '), 200) END AS nav FROM pages)"
FIELDS_SQL = f"""WITH h AS MATERIALIZED (SELECT *, regexp_extract(trim(url), '\\?([^#]*)', 1) AS query FROM ({classify.hints_sql()}) JOIN {NAV} USING (page_id)),
  f AS (SELECT id, unnest([{', '.join(f"CASE WHEN {w} THEN '{k}' END" for k, w in THERE.items())}]) AS f FROM h) SELECT id, split_part(f, '.', 1) AS family, split_part(f, '.', 2) AS field FROM f WHERE f IS NOT NULL"""
USED = ", ".join(f"'{f}'" for f in lexicon.FEATURE_FIELDS)
GENERIC = ", ".join(f"'{t}'" for t in lexicon.GENERIC_TITLES)
ONE_SIDE = "SELECT domain, count(*) AS total, count_if(review) AS review, count_if(status = 'success') AS success FROM t WHERE ord % 2 = {} GROUP BY domain"
SQL = {
    "signal_pack_rows": f"""SELECT id, {NORMAL} AS identity, registrable, title AS preferred_title, trim(main) AS description, lang AS language, array_to_string(list_distinct_in_order, '|') AS source_facets, CASE WHEN status = 'success' THEN '抓取成功' ELSE '' END AS quality, status <> 'success' AS review,
      CAST(CASE WHEN title = '' AND h1 = '' THEN 0 WHEN title = '' OR h1 = '' OR title = h1 THEN 1 ELSE 2 END AS INT) AS titles FROM (SELECT *, CASE WHEN registrable = host THEN [host] ELSE [registrable, host] END AS list_distinct_in_order FROM ({pages_sql()}))""",
    "signal_flatten_counts": f"SELECT family, field, count(*) AS present FROM ({FIELDS_SQL}) GROUP BY 1, 2",
    "signal_audit": f"""WITH c AS (SELECT family, field, count(*) AS collected FROM ({FIELDS_SQL}) GROUP BY 1, 2), u AS (SELECT split_part(f, '.', 1) AS family, split_part(f, '.', 2) AS field, (SELECT count(*) FROM pages) AS n FROM (SELECT unnest([{USED}]) AS f))
      SELECT family, field, coalesce(collected, 0) AS collected, CAST(0 AS BIGINT) AS classified, coalesce(n, 0) AS clustered, coalesce(n, 0) AS impact FROM c FULL OUTER JOIN u USING (family, field)""",
    "site_types": f"""WITH h AS MATERIALIZED ({classify.hints_sql()}), m AS (SELECT host, arg_min(title, page_id) AS home_title, arg_min(hints, page_id) AS home_hints FROM h GROUP BY host)
      SELECT id, CASE WHEN home_title <> '' THEN home_title ELSE registrable END AS site_name, array_to_string([x FOR x IN string_split(registrable, '.') IF length(x) > 1], ',') AS domain_terms,
        CASE WHEN len(hints) + len(home_hints) = 0 THEN 'general' ELSE array_to_string(list_concat(hints, [x FOR x IN home_hints IF NOT list_contains(hints, x)]), ',') END AS site_types FROM h JOIN m USING (host)""",
    "fetch_needs": f"""SELECT id, little OR len(segments) >= 2 AS homepage, generic AND length(main) < 120 AS low_value, page_id % 3 = 0 AND len(segments) > 0 AS warmup, CASE WHEN page_id % 4 = 0 THEN false ELSE little OR len(segments) >= 2 END AS homepage_overridden
      FROM (SELECT *, length(main) < 120 OR generic AS little FROM (SELECT *, said = '' OR lower(said) IN ({GENERIC}) OR length(said) <= 12 AS generic FROM (SELECT *, CASE WHEN title <> '' THEN title ELSE h1 END AS said FROM ({pages_sql()}))))""",
    "quality_guardrails": f"""WITH d AS ({DECIDE_SQL}), o AS (SELECT count(*) AS records, count_if(category <> '{lexicon.DEFAULT_CATEGORY}' AND rule_confidence < 0.55::DOUBLE) AS low_confidence_normal,
      count_if(bucket = 'fetch_blocked' AND category = '{lexicon.DISCOVERY_ROOT}') AS blocked_discovery, count_if(category = '{lexicon.DEFAULT_CATEGORY}') AS tidy FROM d)
      SELECT *, CASE WHEN low_confidence_normal = 0 AND blocked_discovery = 0 THEN CASE WHEN tidy > 0.5 * records THEN 'needs_review' ELSE 'pass' END ELSE 'fail' END AS verdict FROM o""",
    "dominant_label": f"""WITH b AS (SELECT id, split_part(category, '/', -1) AS label FROM ({classify.BEST_SQL}) WHERE confidence >= 0.72::DOUBLE), c AS (SELECT source, label, count(*) AS n FROM b JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '') AS source FROM documents) USING (id) GROUP BY 1, 2 HAVING count(*) >= 2)
      SELECT source, label, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, label) = 1""",
    "two_pass_cache": f"""WITH a AS (SELECT user_id, status, event_id AS ord, event_id % 2 AS pass, CASE status WHEN 'success' THEN 4 WHEN 'broken' THEN 2 ELSE 1 END AS p FROM ({ATTEMPTS_SQL})),
      f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, pass ORDER BY p DESC, ord DESC) = 1) SELECT user_id, status, ord FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC, pass DESC) = 1""",
    "domain_hotspots": f"""WITH t AS MATERIALIZED (SELECT 'd' || user_id AS domain, status, review_required AS review, reason_code, CASE WHEN event_id % 4 = 1 THEN 'proxy' ELSE 'unknown' END AS route, event_id AS ord FROM ({HEALTH_SQL}) JOIN (SELECT event_id, user_id FROM events) USING (event_id)),
      b AS (SELECT domain, coalesce(y.review, 0) AS review, coalesce(y.total, 0) AS total, coalesce(y.success, 0) AS success, coalesce(y.review, 0) - coalesce(x.review, 0) AS review_delta, coalesce(y.success, 0) - coalesce(x.success, 0) AS success_delta FROM ({ONE_SIDE.format(0)}) x FULL OUTER JOIN ({ONE_SIDE.format(1)}) y USING (domain)),
      r AS (SELECT domain, string_agg(reason_code || '=' || n, ',' ORDER BY n DESC, spot) AS reasons FROM (SELECT domain, reason_code, count(*) AS n, min(ord) AS spot FROM t WHERE ord % 2 = 1 AND review GROUP BY 1, 2) GROUP BY 1),
      o AS (SELECT domain, string_agg(route || '=' || n, ',' ORDER BY n DESC, spot) AS routes FROM (SELECT domain, route, count(*) AS n, min(ord) AS spot FROM t WHERE ord % 2 = 1 GROUP BY 1, 2) GROUP BY 1),
      u AS (SELECT domain, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS k FROM t WHERE ord % 2 = 1 AND review) WHERE k <= 5 GROUP BY 1)
      SELECT domain, review, total, success, review_delta, success_delta, coalesce(reasons, '') AS reasons, coalesce(routes, '') AS routes, coalesce(urls, '') AS urls FROM b LEFT JOIN r USING (domain) LEFT JOIN o USING (domain) LEFT JOIN u USING (domain) WHERE review > 0 OR review_delta <> 0 OR success_delta <> 0""",
    "auto_root_groups": f"""WITH c AS (SELECT n_name AS root, count(*) AS records FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1) SELECT CASE WHEN (SELECT count(*) FROM c) > 10 THEN '{lexicon.MAIN_GROUP}' ELSE root END AS shown_under, root, records FROM c
      UNION ALL SELECT '{lexicon.DEFAULT_CATEGORY}', '{lexicon.DEFAULT_CATEGORY}', 7 UNION ALL SELECT '{lexicon.DEFAULT_CATEGORY}', '{lexicon.DISCOVERY_ROOT}', 2""",
    "confirmation_report": f"""SELECT d.id, name, top AS score, CASE WHEN d.review THEN 'broken' ELSE 'success' END AS fetch_status, bucket, "primary", d.review AS review_required, CASE WHEN NOT d.review THEN '可访问' WHEN d.doc_id % 2 = 0 THEN '访问受限/疑似反爬' ELSE '链接不存在' END AS review_category
      FROM ({DECIDE_SQL}) d JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(coalesce(text, ''), chr(10), 1) AS name FROM documents) USING (id) WHERE needs_confirmation AND (category <> '{lexicon.DEFAULT_CATEGORY}' OR topical)""",
}
