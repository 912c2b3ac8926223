"""Queries that score, classify and describe records.

Documents stand in for fetched pages, labels for failed fetches.  The SQL spells out patterns and words of its own accord; only the
taxonomy and the listed word rules are shared data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon, text, urls
from ..operators import health, rules, signals
from ..operators.rules import Rule
from ..operators.skew import written
from .common import PARTS_SQL, host_sql, once, sql_in, table

#: A taxonomy in words of the texts.
TAXONOMY = [
    Rule("english/common", ("src1.example.com",), ("the", "and", "with"), ("^the ", "^and ")),
    Rule("english/rare", (), ("worthless", "pathetic", "clown"), ("clown",)),
    Rule("german/common", ("src2.example.com", "src3.example.com"), ("der", "und", "das"), ("^der ",)),
    Rule("french/common", (), ("les", "des", "que"), ("^les? ",)),
    Rule("spanish/common", ("src9.example.com",), ("que", "los", "con"), ("^los? ",)),
    Rule("license", (), ("licensed under", "copyright"), ("licensed",)),
]
OPTIONS = rules.Options()


def records(spark, sf_dir) -> DataFrame:
    """Documents as records with signals: the first line is the saved name, the text the page's main text, the source the site; every tenth is its site's homepage."""
    d = table(spark, sf_dir, "documents")
    host = F.concat(F.coalesce("source", F.lit("")), F.lit(".example.com"))
    home, key = F.col("doc_id") % 10 == 0, F.col("doc_id").cast("string")
    body = F.coalesce("text", F.lit(""))
    rows = d.select(
        F.col("doc_id"), key.alias("id"), F.col("doc_id").alias("ord"), F.split_part(body, F.lit("\n"), F.lit(1)).alias("name"), F.when(home, F.concat(F.lit("https://"), host, F.lit("/"))).otherwise(F.concat(F.lit("https://"), host, F.lit("/texts/"), key)).alias("url"),
        host.alias("domain"), F.when(home, F.array().cast("array<string>")).otherwise(F.array(F.lit("texts"), key)).alias("path_segments"), body.alias("main_text_preview"), F.col("lang").alias("page_lang"), "source",
    )
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels grow with documents, so the join is the same at every size
    rows = rows.join(toxic.hint("merge"), "doc_id", "left").withColumn("failed", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    code = F.when(F.col("failed"), F.when(F.col("doc_id") % 2 == 0, 403).otherwise(404)).otherwise(200)
    rows = rows.withColumns({"status": F.when(F.col("failed"), "broken").otherwise("success"), "status_code": code, "error": F.lit("")})
    return signals.signals(health.link_health(rows).withColumn("fetch_status", F.col("status")).drop("status", "toxic", "failed"))


def scored(spark, sf_dir) -> DataFrame:
    """Records with their scores; written, since a filter on scores would otherwise be pushed below them and compute them again."""
    return once(spark, sf_dir, "scored", lambda: written(rules.labels(rules.resource_type(rules.scored(records(spark, sf_dir), TAXONOMY)))))


#: Columns of records that queries on their classification read.
CARRIED = ("ord", "name", "url", "fetch_status", "review_required", "reason_label")


def classified(spark, sf_dir) -> DataFrame:
    """What is decided of documents, without their texts; `records` has these."""
    return once(spark, sf_dir, "classified", lambda: written(rules.classify(records(spark, sf_dir), TAXONOMY, OPTIONS, columns=CARRIED)))


def keyword_rule_scores(spark, sf_dir) -> DataFrame:
    return rules.score_rows(scored(spark, sf_dir)).drop("rank")


def rule_topk_confidence(spark, sf_dir) -> DataFrame:
    """The two best rules of each record, their margin and the confidence in the best."""
    one, two = F.get("scores", F.lit(0)), F.get("scores", F.lit(1))
    rows = scored(spark, sf_dir).where(F.size("scores") > 0)
    return rows.select(
        "id", one["category"].alias("category"), one["total"].alias("top"), F.coalesce(two["total"], F.lit(0.0)).alias("second"), two["category"].alias("second_category"), rules.strong(one).alias("strong"),
        rules.raw_confidence(F.col("scores")).alias("confidence"),
    )


def rule_root_support(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir).select("id", F.posexplode(rules.rule_roots(F.col("scores"))).alias("n", "r"))
    return rows.select("id", (F.col("n") + 1).alias("rank"), "r.root", "r.total", "r.support")


def primary_secondary_topics(spark, sf_dir) -> DataFrame:
    """The first two confident topics and the next three, before and after the confidence floor."""
    return classified(spark, sf_dir).select("id", F.array_join("primary_topics", ",").alias("primary"), F.array_join("secondary_topics", ",").alias("secondary"), F.array_join("topic_labels", ",").alias("labels"))


_DECISION = ("id", "category", "rule_confidence", "cross_root_ambiguous", "homepage_aggregate_only", "review_topic_preserved", "needs_confirmation")


def decision_cascade(spark, sf_dir) -> DataFrame:
    return classified(spark, sf_dir).select(*_DECISION, F.array_join("needs_confirmation_reasons", ",").alias("reasons"), F.col("confirmation_bucket").alias("bucket"), F.array_join("primary_topics", ",").alias("primary"))


def given_assignments(spark, sf_dir) -> DataFrame:
    """Every tenth document, by the link of its record (odd spelling for every twentieth), in three confidences."""
    d = table(spark, sf_dir, "documents").where("doc_id % 10 = 3")
    link = F.concat(F.lit("https://"), F.coalesce("source", F.lit("")), F.lit(".example.com/texts/"), F.col("doc_id").cast("string"))
    spelled = F.when(F.col("doc_id") % 20 == 3, F.concat(F.upper(link), F.lit("#x"))).otherwise(link)
    confidence = F.when(F.col("doc_id") % 3 == 0, 0.95).when(F.col("doc_id") % 3 == 1, 0.75).otherwise(0.4)
    spelled = F.when(F.col("doc_id") % 20 == 3, F.replace(link, F.lit("/texts/"), F.lit("/Texts-/"))).otherwise(link)
    return d.select(spelled.alias("identity"), F.lit("assigned/topic").alias("category"), confidence.alias("confidence"), F.lit("bc_1").alias("source_cluster_id"))


def assignment_override(spark, sf_dir) -> DataFrame:
    rows = rules.classify(records(spark, sf_dir), TAXONOMY, OPTIONS, given_assignments(spark, sf_dir), columns=())
    return rows.select("id", "category", "rule_confidence", "assigned", "score", F.get("rule_roots", F.lit(0))["root"].alias("first_root"))


def classification_stats(spark, sf_dir) -> DataFrame:
    return rules.counters(classified(spark, sf_dir), OPTIONS).where("kind in ('category', 'reason', 'bucket')")


def used_signals(spark, sf_dir) -> DataFrame:
    """Rows only: how many records drew on each signal field and family; tested on literal records."""
    return rules.counters(classified(spark, sf_dir), OPTIONS).where("kind in ('field', 'family', 'resource_type')")


def tidy_breakdown(spark, sf_dir) -> DataFrame:
    return rules.counters(classified(spark, sf_dir), OPTIONS).where("kind = 'tidy'").select(F.col("value").alias("status"), "records")


def confirm_list(spark, sf_dir) -> DataFrame:
    """Records to confirm with their three best rules."""
    rows = rules.to_confirm(classified(spark, sf_dir), OPTIONS)
    return rows.select("id", "category", F.array_join("needs_confirmation_reasons", ",").alias("reasons"), F.array_join(F.transform(F.slice("scores", 1, 3), lambda s: s["category"]), ",").alias("candidates"))


def decision_drivers(spark, sf_dir) -> DataFrame:
    """Rows only: what moved each decision; tested on literal records."""
    return classified(spark, sf_dir).select("id", F.posexplode("top_decision_drivers").alias("n", "d")).select("id", "n", "d.driver", "d.summary", F.array_join("d.signal_fields", ",").alias("fields"))


def plain(column, limit: int | None = None):
    """Text of markup, one space for white space."""
    out = text.clean(F.regexp_replace(column, r"(?s)<[^>]*>", " "))
    return F.substring(out, 1, limit) if limit else out


def saved_pages(spark, sf_dir) -> DataFrame:
    """Pages as records with signals, read with regular expressions in the JVM; every fifth fetch failed, its page is known by nothing but its link."""
    html, c = F.col("html"), F.col
    host = urls.host(c("url"))
    p = table(spark, sf_dir, "pages").withColumns({"host": host, "failed": c("page_id") % 5 == 0})
    said = lambda x: F.when(~c("failed"), x)
    rows = p.select(
        F.concat(F.lit("p"), c("page_id").cast("string")).alias("id"), c("page_id").alias("ord"), "url", c("host").alias("domain"), urls.normalize(c("url")).alias("fetch_key"),
        plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("name"), F.when(c("failed"), "timeout").otherwise("success").alias("fetch_status"),
        F.when(c("failed"), "timeout").otherwise("ok").alias("reason_code"), c("failed").alias("review_required"), F.lit("direct").alias("route"),
        said(plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))).alias("h1"), said(plain(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1), 1500)).alias("main_text_preview"),
        said(F.regexp_extract(html, r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1)).alias("page_lang"), said(F.array(plain(F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1), 200))).alias("page_nav"),
        urls.registrable(c("host")).alias("registrable_domain"), urls.subdomain(c("host")).alias("subdomain"), urls.path_segments(c("url")).alias("path_segments"), urls.query_keys(c("url")).alias("query_keys"),
    )
    hay = F.lower(F.concat_ws(" ", "name", "h1", "main_text_preview"))
    in_path = F.lower(F.array_join("path_segments", "/"))
    hints = F.array_distinct(F.array_sort(F.concat(signals.page_types(hay), signals.page_types(in_path))))
    order = list(lexicon.PAGE_TYPES)
    ordered = text.let(hints, lambda found: F.filter(F.array(*map(F.lit, order)), lambda k: F.array_contains(found, k)))
    return signals.signals(rows.withColumns({"title": c("name"), "page_hints": F.when(c("fetch_status") == "success", ordered)}))


def resource_type_argmax(spark, sf_dir) -> DataFrame:
    rows = rules.resource_type(rules.scored(saved_pages(spark, sf_dir), []))
    return rows.select("id", "resource_type", F.col("resource_points").alias("points"))


def intents_quality(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rows.select("id", F.array_join("intent_labels", ",").alias("intents"), F.array_join("quality_signals", ",").alias("signals"))


def _open_topics(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir)
    confident = F.transform(F.filter("scores", lambda s: s["total"] >= OPTIONS.min_score), lambda s: s["category"])
    return rules.open_topics(rows.withColumn("topic_labels", F.slice(confident, 1, 5)), TAXONOMY, OPTIONS)


def open_topics_top8(spark, sf_dir) -> DataFrame:
    rows = _open_topics(spark, sf_dir).select("id", F.posexplode("open_topics").alias("n", "t"))
    return rows.select("id", (F.col("n") + 1).alias("rank"), "t.topic", "t.score", F.array_join("t.sources", ",").alias("sources"))


def uncovered_topics_top20(spark, sf_dir) -> DataFrame:
    """Topics among records' three best open ones by their points over all records; a report of 20."""
    rows = records(spark, sf_dir).select("id", "ord").join(_open_topics(spark, sf_dir), "id")
    return rules.uncovered_topics(rows)


def cluster_hints(spark, sf_dir) -> DataFrame:
    """Rows only: the hints of each record; tested on literal records and against a plain version."""
    return classified(spark, sf_dir).select("id", F.posexplode("cluster_hints").alias("n", "hint"))


def page_extract_basic(spark, sf_dir) -> DataFrame:
    html = F.col("html")
    body = F.regexp_replace(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1), r"(?s)<[^>]*>", " ")
    nav = F.regexp_replace(F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1), r"(?s)<[^>]*>", " ")
    flat = lambda c: F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", flat(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract(html, r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1).alias("lang"), flat(nav).alias("nav"), F.substring(flat(body), 1, 1500).alias("main_text"))


def page_type_hints(spark, sf_dir) -> DataFrame:
    """Page types by substrings of what the page says or of its path, and the kinds they stand for."""
    return saved_pages(spark, sf_dir).select("id", F.array_join("page_type_hints", ",").alias("hints"), F.array_join("resource_facets", ",").alias("facets"))


def stable_cluster_ids(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_type")).alias("x"))
    return d.select("p_brand", text.stable_id("bc_", F.col("x")).alias("cluster_id"))


QUERIES = {f.__name__: f for f in (
    keyword_rule_scores, rule_topk_confidence, rule_root_support, primary_secondary_topics, decision_cascade, assignment_override, classification_stats, used_signals, tidy_breakdown, confirm_list, decision_drivers,
    resource_type_argmax, intents_quality, open_topics_top8, uncovered_topics_top20, cluster_hints, page_extract_basic, page_type_hints, stable_cluster_ids,
)}

# ---- SQL -----------------------------------------------------------------------------------------

SPACE = r"[\s\v\x{85}\p{Z}]+"


def clean_sql(of: str) -> str:
    return f"trim(regexp_replace({of}, '{SPACE}', ' ', 'g'), ' ')"


def has_sql(of: str, word: str) -> str:
    """A word of letters and digits between others, or a phrase anywhere."""
    quoted = word.lower().replace("'", "''")
    if re.fullmatch("[a-z0-9]+", word.lower()):
        return f"regexp_matches({of}, '(^|[^a-z0-9]){quoted}($|[^a-z0-9])')"
    if re.fullmatch("[a-z0-9-]+", word.lower()):
        return f"regexp_matches({of}, '(^|[^a-z0-9]){quoted}($|[^a-z0-9])')"
    return f"contains({of}, '{quoted}')"


def count_sql(of: str, words) -> str:
    return " + ".join(f"CASE WHEN {has_sql(of, w)} THEN 1 ELSE 0 END" for w in words) or "0"


def any_sql(of: str, words) -> str:
    return " OR ".join(has_sql(of, w) for w in words) or "false"


def suffix_sql(of: str, domains) -> str:
    return " OR ".join(f"{of} = '{d}' OR suffix({of}, '.{d}')" for d in domains) or "false"


HANZI = r"\x{4e00}-\x{9fff}"
TOKEN_RE = rf"[A-Za-z][A-Za-z0-9+#.-]{{2,}}|[{HANZI}]{{2,}}"


def normal_sql(of: str) -> str:
    return rf"regexp_replace(lower(trim({of})), '[^a-z0-9{HANZI}]+', '', 'g')"


def _norm(words) -> str:
    return sql_in(sorted({re.sub(r"[^a-z0-9一-鿿]+", "", w.lower()) for w in words} - {""}))


def generated_sql(k: str) -> str:
    return f"(regexp_full_match({k}, '[0-9a-f]{{12,}}') OR (length({k}) >= 8 AND length(regexp_replace({k}, '[^0-9]', '', 'g')) >= 0.45 * length({k})))"


def useful_sql(k: str) -> str:
    listed = _norm(lexicon.NOISY_TOKENS + lexicon.GENERIC_PLATFORM_TOKENS + lexicon.SOURCE_LIKE_TOKENS + lexicon.WEAK_TOKENS)
    return rf"{k} <> '' AND {k} NOT IN ({listed}) AND NOT regexp_full_match({k}, '(part|session|chapter)\d+') AND NOT {generated_sql(k)}"


TOXIC = "(SELECT doc_id, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id)"
CORE = r"regexp_replace(title, '[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+', '', 'g')"
#: Documents as records: the same words that the engine's text views are made of.
TEXTS = rf"""SELECT *, CASE WHEN home THEN said ELSE title || ' ' || body END || '     ' || coalesce(lang, '') AS keyword_raw, CASE WHEN title = '' THEN '' ELSE title || ' ' END || body || ' ' || body || ' ' || body || '  ' || body AS content_raw FROM (
  SELECT *, CASE WHEN title <> '' AND ({CORE} = '' OR {generated_sql(normal_sql('title'))} OR (length({CORE}) >= 6 AND length(regexp_replace({CORE}, '[^\p{{Nd}}]', '', 'g')) >= 0.6 * length({CORE}))) THEN '' ELSE title END AS said FROM (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, lang, coalesce(source, '') AS source, coalesce(source, '') || '.example.com' AS domain, doc_id % 10 = 0 AS home, split_part(coalesce(text, ''), chr(10), 1) AS name,
      {clean_sql("split_part(coalesce(text, ''), chr(10), 1)")} AS title, {clean_sql("coalesce(text, '')")} AS body, coalesce(toxic, false) AS review,
      CASE WHEN doc_id % 2 = 0 THEN 'access_limited' ELSE 'missing' END AS pattern FROM documents LEFT JOIN {TOXIC} USING (doc_id)))"""
_LOW = f"SELECT *, lower(keyword_raw) AS kt, lower(content_raw) AS ct FROM ({TEXTS})"
SCORED = " UNION ALL ".join(
    f"""SELECT id, {n} AS ord, '{r.category}' AS category, CAST(CASE WHEN {suffix_sql('domain', r.domains)} THEN 100 ELSE 0 END AS INT) AS domain, CAST(least(100, 20 * ({count_sql('kt', r.keywords)})) AS INT) AS keyword,
    CAST(CASE WHEN title <> '' AND ({' OR '.join(f"regexp_matches(title, '(?i){p}')" for p in r.title_patterns)}) THEN 80 ELSE 0 END AS INT) AS title, CAST(least(80, 10 * ({count_sql('ct', r.keywords)})) AS INT) AS content FROM r"""
    for n, r in enumerate(TAXONOMY)
)
SCORES_SQL = f"""WITH r AS MATERIALIZED ({_LOW}), s AS ({SCORED}) SELECT *, row_number() OVER (PARTITION BY id ORDER BY total DESC, ord) AS n FROM (
  SELECT *, domain * 0.3::DOUBLE + keyword * 0.4::DOUBLE + title * 0.2::DOUBLE + content * 0.15::DOUBLE AS total FROM s) WHERE total > 0"""
BEST_SQL = f"""SELECT *, CAST(round_even(least(0.55::DOUBLE * least(top / 25.0::DOUBLE, 1.0) + 0.25::DOUBLE * least((top - second) / 20.0::DOUBLE, 1.0) + CASE WHEN strong THEN 0.2::DOUBLE ELSE 0 END, 1.0), 3) AS DOUBLE) AS confidence FROM (
  SELECT id, max(CASE WHEN n = 1 THEN category END) AS category, max(total) AS top, coalesce(max(CASE WHEN n = 2 THEN total END), 0.0::DOUBLE) AS second, max(CASE WHEN n = 2 THEN category END) AS second_category, count(*) AS k,
    bool_or(n = 1 AND (domain > 0 OR title > 0 OR keyword >= 40)) AS strong, bool_or(n = 1 AND (domain > 0 OR title > 0)) AS placed,
    string_agg(CASE WHEN total >= 15 AND n <= 2 THEN category END, ',' ORDER BY n) AS primaries, string_agg(CASE WHEN total >= 15 AND n BETWEEN 3 AND 5 THEN category END, ',' ORDER BY n) AS secondaries,
    string_agg(CASE WHEN total >= 15 AND n <= 5 THEN category END, ',' ORDER BY category) AS labels, string_agg(CASE WHEN n <= 3 THEN category END, ',' ORDER BY n) AS tops
  FROM ({SCORES_SQL}) GROUP BY id)"""
TOPICS_SQL = rf"""WITH r AS MATERIALIZED ({TEXTS}), b AS ({BEST_SQL}),
  x AS (SELECT id, unnest(t) AS t, generate_subscripts(t, 1) AS i, 1 AS m, 2 AS w, 'title' AS source FROM (SELECT id, regexp_extract_all(title, '{TOKEN_RE}') AS t FROM r)
    UNION ALL SELECT id, unnest(t), generate_subscripts(t, 1), 2, 2, 'name' FROM (SELECT id, regexp_extract_all(name, '{TOKEN_RE}') AS t FROM r)
    UNION ALL SELECT id, 'texts', 1, 4, 1, 'url_path' FROM r WHERE NOT home
    UNION ALL SELECT id, unnest(t), generate_subscripts(t, 1), 5, 1, 'domain' FROM (SELECT id, [p FOR p IN string_split(domain, '.') IF length(p) > 2] AS t FROM r)),
  y AS (SELECT id, trim(t, '-_.') AS t, lower(trim(t, '-_.')) AS low, m * 1000000 + i AS spot, w, source FROM x),
  z AS (SELECT *, {normal_sql('low')} AS k FROM y WHERE low <> '' AND low NOT IN ({sql_in(lexicon.TOPIC_STOPWORDS)}) AND length(low) >= 4 AND low NOT IN ('english', 'common', 'rare', 'german', 'french', 'spanish', 'license')),
  l AS (SELECT *, CASE WHEN t = upper(t) OR regexp_matches(t, '[0-9]') THEN t WHEN low IN ({sql_in(lexicon.ACRONYMS)}) THEN upper(t) ELSE upper(t[1]) || lower(substr(t, 2)) END AS label FROM z WHERE {useful_sql('k')}),
  g AS (SELECT id, lower(label) AS key, CAST(sum(w) AS INT) AS score, arg_min(label, spot) AS topic, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM l LEFT JOIN b USING (id)
    WHERE NOT list_contains(string_split(coalesce(labels, ''), ','), lower(label)) GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS rank FROM g)
  SELECT id, CAST(rank AS INT) AS rank, topic, score, sources FROM k WHERE rank <= 8"""
DECIDE_SQL = f"""WITH b AS ({BEST_SQL}), t AS (SELECT DISTINCT id, true AS topical FROM ({TOPICS_SQL})),
  j AS (SELECT v.id, v.doc_id, home, review, pattern, category, second_category, coalesce(top, 0.0::DOUBLE) AS top, coalesce(second, 0.0::DOUBLE) AS second, coalesce(k, 0) AS k, coalesce(strong, false) AS strong, coalesce(placed, false) AS placed,
    coalesce(confidence, 0.0::DOUBLE) AS raw, coalesce(topical, false) AS topical, coalesce(primaries, '') AS primaries, coalesce(secondaries, '') AS secondaries, coalesce(labels, '') AS labels, coalesce(tops, '') AS tops FROM ({TEXTS}) v LEFT JOIN b USING (id) LEFT JOIN t USING (id)),
  c AS (SELECT *, review AND k > 0 AND ((raw >= 0.55::DOUBLE AND top >= 25 AND strong) OR (pattern = 'access_limited' AND top >= 17.5::DOUBLE)) AS kept,
    k > 1 AND split_part(category, '/', 1) <> split_part(second_category, '/', 1) AND round(top - second, 6) <= 2.0 AND second >= 15 AS ambiguous, k > 0 AND home AND NOT placed AS aggregate FROM j),
  f AS (SELECT *, CASE WHEN NOT review THEN raw WHEN kept THEN greatest(raw, 0.55::DOUBLE) ELSE least(raw, 0.45::DOUBLE) END AS capped FROM c),
  g AS (SELECT *, round(CASE WHEN ambiguous OR aggregate THEN least(capped, 0.54::DOUBLE) ELSE capped END, 6) AS rule_confidence FROM f),
  h AS (SELECT *, rule_confidence < 0.55::DOUBLE AS fallen, CASE WHEN rule_confidence < 0.55::DOUBLE OR primaries = '' THEN '{lexicon.DEFAULT_CATEGORY}' ELSE split_part(primaries, ',', 1) END AS final FROM g)
  SELECT id, doc_id, final AS category, rule_confidence, coalesce(ambiguous, false) AS cross_root_ambiguous, aggregate AS homepage_aggregate_only, kept AS review_topic_preserved, top, fallen, topical, review, tops,
    final = '{lexicon.DEFAULT_CATEGORY}' OR top < 15 OR fallen OR review AS needs_confirmation,
    concat_ws(',', CASE WHEN review THEN 'fetch_review_required' END, CASE WHEN final = '{lexicon.DEFAULT_CATEGORY}' THEN 'default_category_fallback' END, CASE WHEN top < 15 THEN 'score_below_min' END, CASE WHEN fallen THEN 'low_rule_confidence' END,
      CASE WHEN ambiguous THEN 'cross_root_score_ambiguity' END, CASE WHEN aggregate THEN 'homepage_aggregate_only' END, CASE WHEN topical THEN 'open_topic_candidates_present' END,
      CASE WHEN review AND final = '{lexicon.DEFAULT_CATEGORY}' THEN 'fetch_limited_signal' END, CASE WHEN NOT review AND final = '{lexicon.DEFAULT_CATEGORY}' AND topical THEN 'rule_coverage_gap_on_successful_fetch' END) AS reasons,
    CASE WHEN review THEN 'fetch_blocked' WHEN final = '{lexicon.DEFAULT_CATEGORY}' AND topical THEN 'rule_gap' ELSE 'low_confidence' END AS bucket,
    CASE WHEN fallen THEN CASE WHEN topical THEN '' ELSE '{lexicon.DEFAULT_CATEGORY}' END WHEN primaries = '' THEN CASE WHEN topical THEN '' ELSE '{lexicon.DEFAULT_CATEGORY}' END ELSE primaries END AS primary,
    CASE WHEN fallen THEN '' ELSE secondaries END AS secondary, CASE WHEN fallen THEN '' ELSE labels END AS labels FROM h"""
ASSIGNED = "doc_id % 10 = 3 AND doc_id % 3 < 2"

PAGE_TEXT = r"trim(regexp_replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '[\s\v\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ')"
PAGES = rf"""SELECT page_id, 'p' || page_id AS id, url, host, status, title, h1, main, lang, [x FOR x IN string_split(regexp_extract(trim(url), '{PARTS_SQL}', 3), '/') IF x <> ''] AS segments, {{registrable}} AS registrable FROM (
  SELECT page_id, url, {host_sql()} AS host, CASE WHEN page_id % 5 = 0 THEN 'timeout' ELSE 'success' END AS status, {PAGE_TEXT.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
    CASE WHEN page_id % 5 = 0 THEN '' ELSE {PAGE_TEXT.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} END AS h1,
    CASE WHEN page_id % 5 = 0 THEN '' ELSE left({PAGE_TEXT.format("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)")}, 1500) END AS main,
    CASE WHEN page_id % 5 = 0 THEN '' ELSE regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) END AS lang FROM pages)"""


def pages_sql() -> str:
    from .links import REG_SQL

    return PAGES.replace("{registrable}", REG_SQL)


def _contains(of: str, words) -> str:
    return " OR ".join(f"contains({of}, '{w}')" for w in words)


def hints_sql() -> str:
    """Pages with their hints as a list."""
    cases = ", ".join(f"CASE WHEN status = 'success' AND ({_contains('hay', words)} OR {_contains('path', words)}) THEN '{kind}' END" for kind, words in lexicon.PAGE_TYPES.items())
    return f"SELECT *, [x FOR x IN [{cases}] IF x IS NOT NULL] AS hints FROM (SELECT *, lower(concat_ws(' ', title, h1, main)) AS hay, lower(array_to_string(segments, '/')) AS path FROM ({pages_sql()}))"


def facets_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lexicon.PAGE_TYPE_FACETS.items())
    return f"[CASE x {cases} END FOR x IN hints]"


def _resource_sql() -> str:
    rows = [f"SELECT id, unnest({facets_sql()}) AS kind, generate_subscripts(hints, 1) AS spot, 5 AS points FROM p"]
    path = "lower('/' || array_to_string(segments, '/') || CASE WHEN suffix(tail, '/') THEN '/' ELSE '' END)"
    reserved = sql_in(lexicon.REPOSITORY_RESERVED)
    for n, (kind, (domains, paths, words, titles)) in enumerate(lexicon.RESOURCE_RULES.items()):
        points = [f"CASE WHEN {has_sql('everything', w)} THEN 2 ELSE 0 END" for w in words] + [f"CASE WHEN regexp_matches(title, '(?i){t}') OR regexp_matches(h1, '(?i){t}') THEN 2 ELSE 0 END" for t in titles]
        if kind == "仓库":
            repo = f"""array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN ({sql_in(lexicon.REPOSITORY_HOSTS)}) AND len(segments) >= 2 AND lower(segments[1]) NOT IN ({reserved}) AND lower(segments[2]) NOT IN ({reserved})
              AND NOT starts_with(segments[1], '-') AND NOT starts_with(segments[2], '-')"""
            whole = f"CASE WHEN {repo} THEN 6 + {' + '.join(points)} ELSE 0 END"
        else:
            more = [f"CASE WHEN {suffix_sql('host', [d])} THEN 4 ELSE 0 END" for d in domains] + [f"CASE WHEN regexp_matches(tail, '{p}') THEN 3 ELSE 0 END" for p in paths]
            whole = " + ".join(points + more)
        rows.append(f"SELECT id, '{kind}', {100 + n}, {whole} FROM p")
    rows.append("SELECT id, '论文', 200, CASE WHEN suffix(tail, '.pdf') THEN 3 ELSE 0 END FROM p")
    everything = "lower(concat_ws(' ', title, h1, main, array_to_string(hints, ' '), registrable, host, url, '/' || array_to_string(segments, '/'), lang, status))"
    return f"""WITH p AS MATERIALIZED (SELECT *, {everything} AS everything, lower(regexp_extract(trim(url), '{PARTS_SQL}', 3)) AS tail FROM ({hints_sql()})),
      e AS (SELECT id, kind, min(spot) AS spot, sum(points) AS points FROM ({' UNION ALL '.join(rows)}) WHERE points > 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, spot) AS n FROM e)
      SELECT p.id, coalesce(kind, '未知') AS resource_type, CAST(coalesce(points, 0) AS INT) AS points FROM p LEFT JOIN (SELECT * FROM k WHERE n = 1) USING (id)"""


def _labels_sql() -> str:
    # the record's words, and those of its site, link and status
    everything = "lower(concat_ws(' ', name, title, body, domain, coalesce(lang, ''), 'https://' || domain || CASE WHEN home THEN '/' ELSE '/texts/' || id END, CASE WHEN review THEN 'broken' ELSE 'success' END))"
    kinds = []
    for n, (kind, (domains, paths, words, titles)) in enumerate(lexicon.RESOURCE_RULES.items()):
        if kind != "仓库":
            points = [f"CASE WHEN {has_sql('everything', w)} THEN 2 ELSE 0 END" for w in words] + [f"CASE WHEN regexp_matches(title, '(?i){t}') THEN 2 ELSE 0 END" for t in titles]
            kinds.append(f"SELECT id, '{kind}' AS kind, {n} AS spot, {' + '.join(points)} AS points FROM r")
    intents = ", ".join(f"CASE WHEN {any_sql('everything', w)} THEN '{k}' END" for k, w in lexicon.INTENT_RULES.items())
    # 低信息量页, 官方, 社区, 高频访问候选: by code point
    official = any_sql("everything", lexicon.QUALITY_RULES["官方"][1])
    community = any_sql("everything", lexicon.QUALITY_RULES["社区"][1])
    return f"""WITH r AS MATERIALIZED (SELECT *, {everything} AS everything FROM ({TEXTS})), k AS (SELECT id, arg_max(kind, points * 100 - spot) AS kind FROM ({' UNION ALL '.join(kinds)}) WHERE points > 0 GROUP BY id), b AS ({BEST_SQL})
      SELECT id, concat_ws(',', {intents}) AS intents, array_to_string(list_sort([x FOR x IN [CASE WHEN length(body) < 20 AND length(domain) < 15 THEN '低信息量页' END, CASE WHEN {official} THEN '官方' END,
        CASE WHEN ({community}) OR kind = '博客' THEN '社区' END, CASE WHEN top >= 25 THEN '高频访问候选' END] IF x IS NOT NULL]), ',') AS signals FROM r LEFT JOIN k USING (id) LEFT JOIN b USING (id)"""


EXTRACT_SQL = r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r]+', ' ', 'g')) AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS nav,
  left(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), 1500) AS main_text FROM pages"""
SQL = {
    "keyword_rule_scores": f"SELECT id, category, domain, keyword, title, content, total FROM ({SCORES_SQL})",
    "rule_topk_confidence": f"SELECT id, category, top, second, second_category, strong, confidence FROM ({BEST_SQL})",
    "rule_root_support": f"""WITH g AS (SELECT id, split_part(category, '/', 1) AS root, sum(total) AS total, min(n) AS first FROM ({SCORES_SQL}) WHERE n <= 8 AND total >= 10.5 GROUP BY 1, 2)
      SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY total DESC, first) AS INT) AS rank, root, CAST(round_even(total, 2) AS DOUBLE) AS total, CAST(round_even(total / sum(total) OVER (PARTITION BY id), 4) AS DOUBLE) AS support FROM g""",
    "primary_secondary_topics": f"SELECT id, \"primary\", secondary, labels FROM ({DECIDE_SQL})",
    "decision_cascade": f"SELECT id, category, rule_confidence, cross_root_ambiguous, homepage_aggregate_only, review_topic_preserved, needs_confirmation, reasons, bucket, \"primary\" FROM ({DECIDE_SQL})",
    "assignment_override": f"""WITH s AS (SELECT id, root, row_number() OVER (PARTITION BY id ORDER BY total DESC, first) AS k FROM (SELECT id, split_part(category, '/', 1) AS root, sum(total) AS total, min(n) AS first FROM ({SCORES_SQL}) WHERE n <= 8 AND total >= 10.5 GROUP BY 1, 2)),
      d AS (SELECT *, {ASSIGNED} AS assigned FROM ({DECIDE_SQL})), p AS (SELECT d.*, CASE WHEN NOT review THEN raw WHEN review_topic_preserved THEN greatest(raw, 0.55::DOUBLE) ELSE least(raw, 0.45::DOUBLE) END AS capped FROM d LEFT JOIN (SELECT id, confidence AS raw FROM ({BEST_SQL})) USING (id))
      SELECT p.id, CASE WHEN assigned THEN 'assigned/topic' ELSE category END AS category, CASE WHEN assigned THEN round(greatest(coalesce(capped, 0.0::DOUBLE), CASE WHEN doc_id % 3 = 0 THEN 0.95::DOUBLE ELSE 0.75 END), 6) ELSE rule_confidence END AS rule_confidence, assigned,
        CASE WHEN assigned THEN greatest(top, 25.0::DOUBLE) ELSE top END AS score, CASE WHEN assigned THEN 'assigned' ELSE root END AS first_root FROM p LEFT JOIN (SELECT * FROM s WHERE k = 1) USING (id)""",
    "classification_stats": f"""WITH d AS MATERIALIZED ({DECIDE_SQL}) SELECT kind, value, count(*) AS records FROM (SELECT 'category' AS kind, category AS value FROM d UNION ALL SELECT 'bucket', bucket FROM d WHERE needs_confirmation
      UNION ALL SELECT 'reason', unnest(string_split(reasons, ',')) FROM d WHERE reasons <> '' AND needs_confirmation) GROUP BY 1, 2""",
    "tidy_breakdown": f"""SELECT CASE WHEN review THEN 'broken|review=True' ELSE 'success|review=False' END AS status, count(*) AS records FROM ({DECIDE_SQL}) WHERE category = '{lexicon.DEFAULT_CATEGORY}' GROUP BY 1""",
    "confirm_list": f"SELECT id, category, reasons, tops AS candidates FROM ({DECIDE_SQL}) WHERE needs_confirmation AND (category <> '{lexicon.DEFAULT_CATEGORY}' OR topical)",
    "resource_type_argmax": None, "intents_quality": _labels_sql(), "open_topics_top8": TOPICS_SQL,
    "uncovered_topics_top20": f"""SELECT topic, CAST(sum(score) AS BIGINT) AS score FROM ({TOPICS_SQL}) WHERE rank <= 3 GROUP BY topic ORDER BY sum(score) DESC, min(CAST(id AS BIGINT) * 10 + rank) LIMIT 20""",
    "page_extract_basic": EXTRACT_SQL, "page_type_hints": None,
    "stable_cluster_ids": "SELECT p_brand, 'bc_' || left(sha1(string_agg(p_type, chr(10) ORDER BY p_type)), 12) AS cluster_id FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand",
}
SQL["resource_type_argmax"] = _resource_sql()
SQL["page_type_hints"] = f"SELECT id, array_to_string(hints, ',') AS hints, array_to_string(list_distinct({facets_sql()}), ',') AS facets FROM ({hints_sql()})"
