"""Queries on links and fetch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon, text, urls
from ..operators import display, fetch, health, links
from .common import PARTS_SQL, SPELLED_SQL, host_sql, normal_sql, spelled, sql_case, sql_in, table

H = host_sql()


def url_normalize(spark, sf_dir) -> DataFrame:
    rows = spelled(table(spark, sf_dir, "pages"))
    return rows.select("ord", urls.normalize(F.col("url")).alias("fetch_key"), urls.normalize(F.col("url"), True).alias("link_key"))


def _keyed(spark, sf_dir) -> DataFrame:
    return spelled(table(spark, sf_dir, "pages")).withColumn("key", urls.normalize(F.col("url"), True))


def url_dedupe_first_wins(spark, sf_dir) -> DataFrame:
    return links.first_wins(_keyed(spark, sf_dir)).select("key", "ord", "url", "copies")


def url_duplicates_report(spark, sf_dir) -> DataFrame:
    return links.duplicates(_keyed(spark, sf_dir)).select("ord", "key")


def url_signals(spark, sf_dir) -> DataFrame:
    u, h = F.col("url"), urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", h.alias("host"), urls.registrable(h).alias("registrable"), urls.subdomain(h).alias("subdomain"),
        F.array_join(urls.path_segments(u), "/").alias("path"), F.array_join(urls.query_keys(u), ",").alias("query_keys"), urls.homepage(u).alias("homepage"),
    )


def registrable_domain_variants(spark, sf_dir) -> DataFrame:
    h = F.col("host")
    hosts = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"))
    made = spark.createDataFrame([("docs.x.com.cn",), ("a.b.org.cn",), ("www.bbc.co.uk",), ("10.0.0.1",), ("localhost",)], "host string")
    return hosts.union(made).distinct().select("host", urls.registrable(h).alias("by_suffix"), urls.by_country(h).alias("by_country"), urls.two_labels(h).alias("two_labels"), urls.generic_platform(h).alias("generic"))


def domain_stats_top20(spark, sf_dir) -> DataFrame:
    unique = links.first_wins(_keyed(spark, sf_dir)).withColumn("domain", urls.registrable(urls.host(F.col("url"))))
    return links.top_domains(unique, "domain")


def http_reason_cascade(spark, sf_dir) -> DataFrame:
    return health.link_health(_attempts(spark, sf_dir)).select("event_id", "status", "reason_code", "reason_label", "access_pattern", "review_required", "user_action_required", "user_action_label")


def _attempts(spark, sf_dir) -> DataFrame:
    """Fetch attempts out of events: the type gives the status, the id a status code and an error text."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 7
    status = F.when(kind == 0, "timeout").when(kind == 1, "broken").when(kind == 2, "skipped").when(kind == 3, "error").otherwise("success")
    error = F.element_at(F.array(F.lit("Certificate verify failed: x"), F.lit("Cannot connect to host y"), F.lit("odd")), ((F.col("event_id") % 3) + 1).cast("int"))
    return e.select("event_id", "user_id", "ts", status.alias("status"), (200 + F.col("event_id") % 400).cast("int").alias("status_code"), F.when(status == "error", error).otherwise("").alias("error"))


ATTEMPTS_SQL = """SELECT event_id, user_id, ts, CAST(200 + event_id % 400 AS INT) AS status_code,
  CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'broken' WHEN 2 THEN 'skipped' WHEN 3 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_id % 7 <> 3 THEN '' WHEN event_id % 3 = 0 THEN 'Certificate verify failed: x' WHEN event_id % 3 = 1 THEN 'Cannot connect to host y' ELSE 'odd' END AS error FROM events"""
REASON_SQL = f"""SELECT *, CASE WHEN status = 'success' THEN 'ok' WHEN status = 'timeout' THEN 'timeout'
  WHEN status = 'broken' THEN CASE WHEN status_code IN (401, 403) THEN 'access_denied' WHEN status_code = 429 THEN 'rate_limited' WHEN status_code IN (404, 410) THEN 'not_found'
    WHEN status_code BETWEEN 500 AND 599 THEN 'server_error' ELSE 'http_error' END
  WHEN status = 'skipped' THEN 'invalid_url' WHEN contains(lower(error), 'certificate verify failed') THEN 'certificate'
  WHEN contains(lower(error), 'cannot connect to host') THEN 'dns_connection' ELSE 'other_error' END AS reason_code FROM ({ATTEMPTS_SQL})"""
ACTIONS = sql_in(lexicon.ACTION_LABELS)
HEALTH_SQL = f"""SELECT event_id, status, reason_code, {sql_case(lexicon.REASON_LABELS, 'reason_code')} AS reason_label,
  CASE WHEN status = 'success' THEN 'public' WHEN reason_code IN ('access_denied', 'rate_limited') THEN 'access_limited' WHEN reason_code = 'not_found' THEN 'missing'
    WHEN reason_code = 'server_error' THEN 'server_error' WHEN status IN ('timeout', 'error') THEN 'transport_error' ELSE 'unknown' END AS access_pattern,
  status <> 'success' AS review_required, reason_code IN ({ACTIONS}) AS user_action_required, coalesce({sql_case(lexicon.ACTION_LABELS, 'reason_code')}, '') AS user_action_label FROM ({REASON_SQL})"""

TRUST = [health.TrustRule(("th.example.com", "b.test"), reasons=("timeout",)), health.TrustRule(("example.com",), statuses=(403, 429), reasons=("access_denied",))]


def trusted_policy_first_match(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    status = F.when(F.col("page_id") % 3 == 0, "timeout").when(F.col("page_id") % 3 == 1, "broken").otherwise("success")
    rows = pages.withColumns({"status": status, "status_code": F.when(F.col("page_id") % 2 == 0, 403).otherwise(404), "error": F.lit("")})
    return health.apply_trust(health.link_health(rows), TRUST).select("page_id", "host", "raw_reason_code", "reason_code", "raw_review_required", "review_required", "trusted_override")


TRUST_SQL = f"""WITH p AS (SELECT page_id, {H} AS host, CASE page_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'broken' ELSE 'success' END AS status,
    CASE WHEN page_id % 2 = 0 THEN 403 ELSE 404 END AS status_code FROM pages),
  r AS (SELECT *, CASE status WHEN 'success' THEN 'ok' WHEN 'timeout' THEN 'timeout' ELSE CASE status_code WHEN 403 THEN 'access_denied' ELSE 'not_found' END END AS raw_reason_code,
    CASE WHEN host IN ('th.example.com', 'b.test') OR suffix(host, '.th.example.com') OR suffix(host, '.b.test') THEN 0 WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 1 END AS rule FROM p),
  t AS (SELECT *, status <> 'success' AS raw_review_required, coalesce((rule = 0 AND raw_reason_code = 'timeout') OR (rule = 1 AND (status_code IN (403, 429) OR raw_reason_code = 'access_denied')), false) AS trusted_override FROM r)
  SELECT page_id, host, raw_reason_code, CASE WHEN trusted_override THEN 'trusted_access' ELSE raw_reason_code END AS reason_code, raw_review_required,
    raw_review_required AND NOT trusted_override AS review_required, trusted_override FROM t"""
OVERRIDES = (("com", "slow"), ("example.com", "direct"), ("example.org", "proxy"), ("ththre.example.com", "skip"))


def domain_override_longest_suffix(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return health.longest_override(pages, spark.createDataFrame(OVERRIDES, "suffix string, setting string")).select("page_id", "host", "setting")


def cache_merge_pending(spark, sf_dir) -> DataFrame:
    """Users with the best of all their attempts."""
    tried = health.link_health(_attempts(spark, sf_dir)).withColumn("ord", F.col("event_id"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return health.merge_cache(users, tried, "user_id")


CACHE_SQL = f"""WITH c AS (SELECT user_id, status, event_id, status <> 'success' AS review_required,
    CASE WHEN status = 'success' THEN 4 WHEN status = 'broken' THEN 2 ELSE 1 END AS priority FROM ({ATTEMPTS_SQL})),
  b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, event_id DESC) = 1)
  SELECT c_custkey AS user_id, status AS cached_status, CAST(priority AS INT) AS cached_priority, b.user_id IS NULL OR review_required AS pending FROM customer LEFT JOIN b ON c_custkey = b.user_id"""


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    tried = health.link_health(_attempts(spark, sf_dir)).select(F.col("user_id").alias("domain"), "review_required", "event_id")
    return tried.where("event_id % 2 = 0"), tried.where("event_id % 2 = 1")


def two_pass_hotspots(spark, sf_dir) -> DataFrame:
    return links.hotspots(*_halves(spark, sf_dir))


HOTSPOT_SQL = f"""WITH t AS (SELECT user_id AS domain, event_id % 2 AS pass, status <> 'success' AS review FROM ({ATTEMPTS_SQL}))
  SELECT domain, count_if(pass = 0) AS primary_total, count_if(pass = 0 AND review) AS primary_review, count_if(pass = 1) AS final_total,
    count_if(pass = 1 AND review) AS final_review, count_if(pass = 1 AND review) - count_if(pass = 0 AND review) AS review_delta FROM t GROUP BY domain"""


def fetch_stats(spark, sf_dir) -> DataFrame:
    """One row: totals by outcome, the success rate, links by route and trusted ones by domain."""
    rows = health.link_health(_attempts(spark, sf_dir)).withColumns({"fetch_status": F.col("status"), "route": F.when(F.col("event_id") % 3 == 0, "proxy").when(F.col("event_id") % 3 == 1, "direct"), "domain": F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string"), F.lit(".example.com"))})
    out = fetch.stats(health.apply_trust(rows, [health.TrustRule(("d1.example.com", "d2.example.com"), reasons=("timeout",))], "domain"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({x: shown(F.col(x)) for x in ("routes", "review_by_route", "trusted_domains")})


def reason_counts(spark, sf_dir) -> DataFrame:
    return health.link_health(_attempts(spark, sf_dir)).groupBy("status", "reason_code", "access_pattern").agg(F.count(F.lit(1)).alias("links"))


def pass_deltas(spark, sf_dir) -> DataFrame:
    """How the totals of two passes differ."""
    rows = health.link_health(_attempts(spark, sf_dir)).withColumns({"fetch_status": F.col("status"), "route": F.lit("direct"), "trusted_override": F.lit(False), "trusted_domain": F.lit(""), "domain": F.lit("")})
    return fetch.deltas(fetch.stats(rows.where("event_id % 2 = 0")), fetch.stats(rows.where("event_id % 2 = 1")))


def skipped_links(spark, sf_dir) -> DataFrame:
    """Links that are not HTTP are skipped without a fetch; the others have no result here."""
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("ftp://x/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"))
    http = F.col("url").rlike("^https?://")
    rows = p.withColumns({"status": F.when(http, "error").otherwise("skipped"), "status_code": F.lit(None).cast("int"), "error": F.when(http, fetch.PENDING).otherwise("Invalid URL")})
    return health.link_health(rows).select("page_id", "status", "error", "reason_code", "user_action_label")


def parse_statistics(spark, sf_dir) -> DataFrame:
    """One row on links with folders: kept, duplicates, distinct domains, distinct folders as the walk up from a link meets them."""
    kept = links.first_wins(_keyed(spark, sf_dir).withColumns({"folder_path": F.slice(urls.path_segments(F.col("url")), 1, 2)}))
    return links.parse_stats(kept.withColumn("domain", urls.host(F.col("url"))))


def dense_ids(spark, sf_dir) -> DataFrame:
    """Kept links numbered from 0 in input order."""
    return links.numbered(links.first_wins(_keyed(spark, sf_dir)), "link_").select("id", "ord")


def top_folders(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.slice(urls.path_segments(F.col("url")), 1, 1).alias("folder_path"))
    return links.top_folders(rows, 3).select("folder", "links", "first_ord")


def homepage_self_join(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    first = pages.groupBy(urls.homepage(F.col("url")).alias("url")).agg(F.min_by("title", "page_id").alias("title"))
    return links.homepage_fallback(pages.select("page_id", "url"), first).select("page_id", "homepage_url", "home_title")


def time_buckets(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(text.time_bucket(F.unix_timestamp("ts").cast("string")).alias("b"))
    return rows.groupBy("b.year", "b.year_month", "b.year_week").agg(F.count(F.lit(1)).alias("links"))


def _reported(spark, sf_dir) -> DataFrame:
    rows = health.link_health(_attempts(spark, sf_dir))
    return rows.select(F.col("event_id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("u").alias("url"), F.lit("d").alias("domain"), F.col("status").alias("fetch_status"), "status_code", "error", "reason_code", "reason_label", "access_pattern", "review_required", "user_action_required", "user_action_label", (F.col("event_id") % 5 == 0).alias("trusted_override"), F.col("event_id").alias("ord"))


def broken_link_reports(spark, sf_dir) -> DataFrame:
    """Links whose page answered with an error and that are not trusted."""
    return fetch.broken_links(_reported(spark, sf_dir)).select("id", "status_code", "error", "reason_code", "review_category")


def review_queue(spark, sf_dir) -> DataFrame:
    return fetch.review_queue(_reported(spark, sf_dir)).select("id", "fetch_status", "status_code", "error", "review_category", "reason_code", "access_pattern")


def review_mirror(spark, sf_dir) -> DataFrame:
    """The mirror of links the user must act on, by what is wrong with them."""
    return display.review_folders(_reported(spark, sf_dir).withColumn("id", F.col("ord")))


QUERIES = {f.__name__: f for f in (
    url_normalize, url_dedupe_first_wins, url_duplicates_report, url_signals, registrable_domain_variants, domain_stats_top20, http_reason_cascade,
    trusted_policy_first_match, domain_override_longest_suffix, cache_merge_pending, two_pass_hotspots, fetch_stats, reason_counts, pass_deltas, skipped_links, parse_statistics, dense_ids,
    top_folders, homepage_self_join, time_buckets, broken_link_reports, review_queue, review_mirror,
)}

KEYED_SQL = f"SELECT ord, url, {normal_sql('url', True)} AS key FROM ({SPELLED_SQL})"
SEGMENTS = f"[x FOR x IN string_split(regexp_extract(trim(url), '{PARTS_SQL}', 3), '/') IF x <> '']"
LABELS = "string_split(host, '.')"


def last_sql(labels: str, n: int) -> str:
    return f"array_to_string(list_slice({labels}, greatest(len({labels}) - {n - 1}, 1), len({labels})), '.')"


REG_SQL = rf"CASE WHEN regexp_full_match(host, '\d+(\.\d+){{3}}') THEN host WHEN {last_sql(LABELS, 2)} IN ({sql_in(lexicon.TWO_PART_SUFFIXES)}) THEN {last_sql(LABELS, 3)} ELSE {last_sql(LABELS, 2)} END"
GENERIC_SQL = " OR ".join(f"host = '{d}' OR suffix(host, '.{d}')" for d in lexicon.GENERIC_PLATFORM_DOMAINS)
SQL = {
    "url_normalize": f"SELECT ord, {normal_sql('url', False)} AS fetch_key, {normal_sql('url', True)} AS link_key FROM ({SPELLED_SQL})",
    "url_dedupe_first_wins": f"SELECT key, min(ord) AS ord, arg_min(url, ord) AS url, count(*) AS copies FROM ({KEYED_SQL}) GROUP BY key",
    "url_duplicates_report": f"SELECT ord, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS n FROM ({KEYED_SQL})) WHERE n > 1 ORDER BY ord LIMIT 100",
    "url_signals": rf"""SELECT page_id, host, registrable, CASE WHEN host = registrable THEN '' ELSE regexp_replace(left(host, length(host) - length(registrable)), '\.$', '') END AS subdomain, path, query_keys, homepage
      FROM (SELECT *, {REG_SQL} AS registrable FROM (SELECT page_id, {H} AS host, array_to_string({SEGMENTS}, '/') AS path,
        array_to_string([split_part(x, '=', 1) FOR x IN string_split(regexp_replace(regexp_extract(trim(url), '{PARTS_SQL}', 4), '^\?', ''), '&') IF x <> ''], ',') AS query_keys,
        regexp_extract(trim(url), '{PARTS_SQL}', 1) || '://' || regexp_extract(trim(url), '{PARTS_SQL}', 2) || '/' AS homepage FROM pages))""",
    "registrable_domain_variants": f"""SELECT host, {REG_SQL} AS by_suffix, CASE WHEN {LABELS}[-1] IN ('cn', 'uk', 'jp', 'au') THEN {last_sql(LABELS, 3)} ELSE {last_sql(LABELS, 2)} END AS by_country,
      {last_sql(LABELS, 2)} AS two_labels, {GENERIC_SQL} AS generic
      FROM (SELECT {H} AS host FROM pages UNION SELECT unnest(['docs.x.com.cn', 'a.b.org.cn', 'www.bbc.co.uk', '10.0.0.1', 'localhost']))""",
    "domain_stats_top20": f"""WITH u AS (SELECT key, min(ord) AS ord, arg_min(url, ord) AS url FROM ({KEYED_SQL}) GROUP BY key), h AS (SELECT ord, {H} AS host FROM u)
      SELECT {REG_SQL} AS domain, count(*) AS links, min(ord) AS first_ord FROM h GROUP BY 1 ORDER BY links DESC, first_ord LIMIT 20""",
    "http_reason_cascade": HEALTH_SQL,
    "trusted_policy_first_match": TRUST_SQL,
    "domain_override_longest_suffix": f"""SELECT page_id, host, CASE WHEN host = 'ththre.example.com' OR suffix(host, '.ththre.example.com') THEN 'skip' WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 'direct'
      WHEN host = 'example.org' OR suffix(host, '.example.org') THEN 'proxy' WHEN host = 'com' OR suffix(host, '.com') THEN 'slow' END AS setting FROM (SELECT page_id, {H} AS host FROM pages)""",
    "cache_merge_pending": CACHE_SQL,
    "two_pass_hotspots": HOTSPOT_SQL,
    "fetch_stats": f"""WITH r AS (SELECT *, CASE WHEN user_id % 5 IN (1, 2) AND reason_code = 'timeout' THEN true ELSE false END AS trusted, CASE event_id % 3 WHEN 0 THEN 'proxy' WHEN 1 THEN 'direct' ELSE 'unknown' END AS route, 'd' || (user_id % 5) || '.example.com' AS domain FROM ({REASON_SQL})),
      c AS (SELECT 'routes' AS k, route AS v, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'review', route, count(*) FROM r WHERE status <> 'success' AND NOT trusted GROUP BY 2 UNION ALL SELECT 'trusted', domain, count(*) FROM r WHERE trusted GROUP BY 2)
      SELECT count(*) AS total, count_if(status = 'success') AS success, count_if(status = 'broken') AS broken, count_if(status NOT IN ('success', 'broken')) AS failed, count_if(status = 'success' OR trusted) AS review_free, count_if(trusted) AS trusted,
        printf('%.1f%%', count_if(status = 'success') * 100.0 / count(*)) AS success_rate, (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM c WHERE k = 'routes') AS routes, (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM c WHERE k = 'review') AS review_by_route,
        (SELECT coalesce(string_agg(v || '=' || n, ',' ORDER BY v), '') FROM c WHERE k = 'trusted') AS trusted_domains FROM r""",
    "reason_counts": f"SELECT status, reason_code, access_pattern, count(*) AS links FROM ({HEALTH_SQL}) GROUP BY 1, 2, 3",
    "pass_deltas": f"""SELECT count_if(status = 'success' AND p = 1) - count_if(status = 'success' AND p = 0) AS success_delta, count_if(status = 'broken' AND p = 1) - count_if(status = 'broken' AND p = 0) AS broken_delta,
      count_if(status NOT IN ('success', 'broken') AND p = 1) - count_if(status NOT IN ('success', 'broken') AND p = 0) AS failed_delta, count_if(status = 'success' AND p = 1) - count_if(status = 'success' AND p = 0) AS review_free_delta FROM (SELECT *, event_id % 2 AS p FROM ({ATTEMPTS_SQL}))""",
    "skipped_links": f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'skipped' ELSE 'error' END AS status, CASE WHEN page_id % 4 = 0 THEN 'Invalid URL' ELSE 'Fetch pending at last checkpoint' END AS error, CASE WHEN page_id % 4 = 0 THEN 'invalid_url' ELSE 'other_error' END AS reason_code,
      CASE WHEN page_id % 4 = 0 THEN '地址格式异常' ELSE '' END AS user_action_label FROM pages""",
    "parse_statistics": f"""WITH u AS (SELECT key, arg_min(url, ord) AS url, count(*) AS copies FROM ({KEYED_SQL}) GROUP BY key), s AS (SELECT *, list_slice({SEGMENTS}, 1, 2) AS seg, {H} AS host FROM u)
      SELECT count(*) AS total, CAST(sum(copies) - count(*) AS BIGINT) AS duplicates, count(DISTINCT nullif(host, '')) AS unique_domains, (SELECT count(DISTINCT f) FROM (SELECT unnest(CASE len(seg) WHEN 0 THEN [] WHEN 1 THEN [seg[1]] ELSE [seg[1] || '/' || seg[2], seg[2]] END) AS f FROM s)) AS total_folders FROM s""",
    "dense_ids": f"SELECT 'link_' || (row_number() OVER (ORDER BY ord) - 1) AS id, ord FROM (SELECT key, min(ord) AS ord FROM ({KEYED_SQL}) GROUP BY key)",
    "top_folders": f"SELECT folder, count(*) AS links, min(page_id) AS first_ord FROM (SELECT page_id, {SEGMENTS}[1] AS folder FROM pages) WHERE folder IS NOT NULL GROUP BY 1 ORDER BY links DESC, first_ord LIMIT 3",
    "homepage_self_join": rf"""WITH p AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
      regexp_extract(trim(url), '{PARTS_SQL}', 1) || '://' || regexp_extract(trim(url), '{PARTS_SQL}', 2) || '/' AS homepage_url FROM pages)
      SELECT page_id, homepage_url, home_title FROM p JOIN (SELECT homepage_url, arg_min(title, page_id) AS home_title FROM p GROUP BY 1) USING (homepage_url)""",
    "time_buckets": "SELECT strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS year_month, strftime(ts, '%G-W%V') AS year_week, count(*) AS links FROM events GROUP BY 1, 2, 3",
    "broken_link_reports": f"""SELECT CAST(event_id AS VARCHAR) AS id, status_code, error, reason_code, reason_label AS review_category FROM ({HEALTH_SQL}) JOIN (SELECT event_id, status_code, error FROM ({ATTEMPTS_SQL})) USING (event_id) WHERE status = 'broken' AND event_id % 5 <> 0""",
    "review_queue": f"""SELECT CAST(event_id AS VARCHAR) AS id, status AS fetch_status, status_code, error, reason_label AS review_category, reason_code, access_pattern FROM ({HEALTH_SQL}) JOIN (SELECT event_id, status_code, error FROM ({ATTEMPTS_SQL})) USING (event_id) WHERE review_required""",
    "review_mirror": f"""SELECT '{lexicon.REVIEW_ROOT}' AS root, user_action_label AS folder, count(*) AS records, min(event_id) AS first_id FROM ({HEALTH_SQL}) WHERE user_action_required GROUP BY 1, 2""",
}
