"""From fetch results to records: what a page says best, its site's profile, fallbacks, external metadata, reports.

Fetch results come as tables, whatever fetched them: ``results`` by fetch key, ``homes`` by homepage link, both with a status, an error and a
``page`` struct (`sources.html.PAGE`).  Fallbacks are joins and conditional columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon, text, urls
from . import health
from .skew import top

#: Pages that say less than this are thin.
THIN = 120
LIMITED = (401, 403, 429)
PENDING = "Fetch pending at last checkpoint"


@dataclass(frozen=True)
class Proxy:
    """How links are reached."""

    enabled: bool = False
    trust_env: bool = False
    http: str | None = None
    https: str | None = None
    every: str | None = None

    @property
    def explicit(self) -> bool:
        return any((self.http, self.https, self.every))

    @property
    def configured(self) -> bool:
        return bool(self.enabled and (self.trust_env or self.explicit))

    def under(self, rule: dict | None) -> Proxy:
        """The proxy under a domain's override: direct wins over proxy."""
        rule = rule or {}
        if rule.get("prefer_direct") or rule.get("prefer_direct_retry"):
            return Proxy()
        if rule.get("prefer_proxy") and (self.explicit or self.trust_env):
            return Proxy(True, self.trust_env, self.http, self.https, self.every)
        return self

    def of(self, url: Column) -> Column:
        """The proxy that a link goes through; null for none."""
        if not self.enabled:
            return F.lit(None).cast("string")
        scheme = F.lower(urls.part(F.trim(url), 1))
        pick = lambda *names: F.lit(next((n for n in names if n), None)).cast("string")
        return F.when(scheme == "https", pick(self.https, self.every, self.http)).when(scheme == "http", pick(self.http, self.every, self.https)).otherwise(pick(self.every))


def fetch_context(proxy: Proxy, attempts: Column, url: Column) -> Column:
    """How a link was fetched: route, attempts, and the proxy's settings."""
    return F.struct(
        F.lit("proxy" if proxy.configured else "direct").alias("route"), attempts.alias("attempts"), F.lit(proxy.configured).alias("proxy_configured"), F.lit(proxy.explicit).alias("proxy_explicit"),
        F.lit(proxy.trust_env).alias("proxy_trust_env"), F.coalesce(proxy.of(url), F.lit("")).alias("resolved_proxy"),
    )


def best_title(page: Column) -> Column:
    return text.first_filled(*[page[x] for x in ("og_title", "twitter_title", "jsonld_title", "title", "h1")])


def best_description(page: Column) -> Column:
    return text.first_filled(*[page[x] for x in ("og_description", "twitter_description", "jsonld_description", "description")])


def best_keywords(page: Column) -> Column:
    return text.first_filled(page["keywords"], page["jsonld_keywords"])


def best_preview(page: Column) -> Column:
    return text.first_filled(page["main_text_preview"], page["jsonld_article_body"], page["content_preview"])


def generic_title(title: Column) -> Column:
    low = F.lower(title)
    return (low == "") | low.isin(*lexicon.GENERIC_TITLES) | (F.length(low) <= 12)


def wants_homepage(page: Column, segments: Column, override: Column | None = None) -> Column:
    """Whether a page says so little that its site's homepage is worth a look; an override decides alone."""
    little = (F.length(best_preview(page)) < THIN) | generic_title(best_title(page)) | (F.size(segments) >= 2)
    return little if override is None else F.coalesce(override, little)


def low_value(page: Column) -> Column:
    """A generic title, no description and a thin text."""
    return generic_title(best_title(page)) & (best_description(page) == "") & (F.length(best_preview(page)) < THIN)


def wants_warmup(status_code: Column, segments: Column, override: Column | None = None, on: bool = True) -> Column:
    """Whether a page that access is limited to is tried again after its homepage."""
    free = F.lit(True) if override is None else F.coalesce(override, F.lit(True))
    return status_code.isin(*LIMITED) & (F.size(segments) > 0) & free & F.lit(on)


def site_name(page: Column, home: Column, registrable: Column) -> Column:
    named = [F.nullif(x, F.lit("")) for x in (page["og_site_name"], home["og_site_name"], home["title"], page["og_title"])]
    return F.coalesce(*named, registrable)


def brand_terms(name: Column, registrable: Column, title: Column) -> Column:
    """Words of the site's name, labels of its domain, words of a title's first part; each once, longer than one character."""
    words = lambda x: F.split(x, rf"(?U)[^\w{text.HAN}]+")
    parts = F.concat(words(name), F.split(registrable, r"\."), words(F.split_part(title, F.lit("|"), F.lit(1))))
    return F.filter(text.text_list(parts), lambda w: F.length(w) > 1)


def site_types(page_hints: Column, home_hints: Column, home_url: Column, home_site: Column) -> Column:
    """Page types of page and homepage, repository if the homepage names a code host; nothing: general."""
    none = F.array().cast("array<string>")
    both = text.text_list(F.concat(F.coalesce(page_hints, none), F.coalesce(home_hints, none)))
    said = F.lower(F.concat_ws(" ", home_url, F.coalesce(home_site, F.lit(""))))
    host = F.exists(F.array(*map(F.lit, ("github", "gitlab", "bitbucket"))), lambda h: F.contains(said, h))
    kinds = F.when(host, F.array_union(both, F.array(F.lit("repository")))).otherwise(both)
    return F.when(F.size(kinds) == 0, F.array(F.lit("general"))).otherwise(kinds)


def records(links: DataFrame, results: DataFrame, homes: DataFrame, *, retries: DataFrame | None = None, overrides: DataFrame | None = None, external: DataFrame | None = None, warmup: bool = True, homepage_on_failure: bool = True, route: str = "direct") -> DataFrame:
    """Links with the columns of a record (`signals.RECORD`), out of what was fetched.

    ``links`` have url and fetch_key; ``results`` fetch_key, fetch_status (null for a response), status_code, error, resolved_url, page; ``homes``
    homepage_url, fetch_status, status_code, page; ``retries``, second tries after a homepage, like results; ``overrides`` (suffix, setting) with settings
    fetch_homepage and origin_warmup_retry; ``external`` doi, provider, title, description, canonical_url.  Links that are not HTTP are skipped.

    A page that failed keeps what its homepage says of the site; one to which access is limited is taken from its second try, if that
    got through; a page that says little is enriched from the homepage.  External metadata, only if given, fills what failed or thin pages lack.
    """
    c, lit = F.col, F.lit
    rows = links.withColumns({"http": F.coalesce("url", lit("")).rlike("^https?://"), "segments": urls.path_segments(F.coalesce("url", lit(""))), "host_name": urls.host(F.coalesce("url", lit("")))})
    if overrides is not None:
        rows = health.longest_override(rows, overrides, "host_name").withColumnsRenamed({"setting": "rule"})
    else:
        rows = rows.withColumn("rule", lit(None).cast("struct<fetch_homepage:boolean,origin_warmup_retry:boolean>"))
    one = results.select("fetch_key", F.struct("fetch_status", "status_code", "error", "resolved_url", "page").alias("first"))
    rows = rows.join(one, "fetch_key", "left")
    again = (retries if retries is not None else results.where("false")).select("fetch_key", F.struct("status_code", "page").alias("second"))
    rows = rows.join(again, "fetch_key", "left")
    answered = c("first.status_code").isNotNull() & c("first.fetch_status").isNull()
    rows = rows.withColumn("homepage_url", urls.homepage(F.when(answered, F.coalesce("first.resolved_url", "url")).otherwise(F.coalesce("url", lit("")))))
    rows = rows.join(homes.select("homepage_url", F.struct("fetch_status", "status_code", "page").alias("home")), "homepage_url", "left")
    apart = c("homepage_url") != F.when(answered, F.coalesce("first.resolved_url", "url")).otherwise(c("url"))
    home_state = F.when(c("home").isNull(), "error").when(c("home.fetch_status").isNotNull(), c("home.fetch_status")).when(c("home.status_code") < 400, "success").otherwise("broken")
    rows = rows.withColumns({"answered": answered & c("http"), "apart": apart, "home_state": home_state, "refused": answered & (c("first.status_code") >= 400)})
    rows = rows.withColumn("warmed", c("refused") & c("apart") & wants_warmup(c("first.status_code"), c("segments"), c("rule.origin_warmup_retry"), warmup))
    rows = rows.withColumn("recovered", c("warmed") & (c("home_state") == "success") & F.coalesce(c("second.status_code") < 400, lit(False)))
    rows = rows.withColumns({"success": c("answered") & (~c("refused") | c("recovered")), "told": F.when(c("recovered"), c("second.page")).otherwise(c("first.page"))})
    rows = rows.withColumn("page", F.when(c("success"), c("told")))
    fallen = c("http") & ~c("success") & c("apart") & (c("warmed") | lit(homepage_on_failure))
    enriched = c("success") & c("apart") & (c("warmed") | wants_homepage(c("page"), c("segments"), c("rule.fetch_homepage")))
    rows = rows.withColumns({"looked": fallen | enriched, "met": F.when((fallen | enriched) & (c("home_state") == "success"), c("home.page"))})
    status = F.when(~c("http"), "skipped").when(c("success"), "success").when(c("refused"), "broken").otherwise(F.coalesce("first.fetch_status", lit("error")))
    code = F.when(c("recovered"), c("second.status_code")).otherwise(c("first.status_code"))
    error = F.when(~c("http"), "Invalid URL").when(c("success"), lit("")).when(c("refused"), F.concat(lit("HTTP "), code.cast("string"))).otherwise(F.coalesce("first.error", lit("")))
    registrable = urls.registrable(c("host_name"))
    has_site = c("success") | c("looked")
    none = F.array().cast("array<string>")
    name = site_name(c("page"), c("met"), registrable)
    title = F.when(best_title(c("page")) != "", best_title(c("page"))).otherwise(best_title(c("met")))
    chain = F.array_compact(F.array(
        F.when(c("warmed") & (c("home_state") == "success"), lit("origin_warmup_homepage")), F.when(c("recovered"), lit("origin_warmup_retry")),
        F.when(fallen & ~c("warmed") & (c("home_state") == "success"), lit("homepage_site_profile")),
    ))
    said = lambda x: F.when(c("success"), F.coalesce(x, lit("")))
    listed = lambda x: F.when(c("success"), x)
    rows = rows.withColumns({
        "fetch_status": status, "status_code": code, "error": error, "route": F.when(c("http"), lit(route)), "attempts": F.when(c("http"), 1 + c("warmed").cast("int")),
        "title": said(best_title(c("page"))), "meta_description": said(best_description(c("page"))), "meta_keywords": said(best_keywords(c("page"))), "h1": said(c("page.h1")),
        "content_preview": said(best_preview(c("page"))), "canonical_url": said(c("page.canonical_url")), "meta_normalized": urls.normalize(c("url")), "registrable_domain": registrable,
        "subdomain": urls.subdomain(c("host_name")), "path_segments": c("segments"), "query_keys": urls.query_keys(c("url")),
        "page_title": said(c("page.title")), "page_description": said(c("page.description")), "page_keywords": said(c("page.keywords")), "page_h1": said(c("page.h1")), "page_canonical": said(c("page.canonical_url")),
        "page_lang": said(c("page.lang")), "page_preview": said(c("page.content_preview")), "og_title": said(c("page.og_title")), "og_description": said(c("page.og_description")), "og_site_name": said(c("page.og_site_name")),
        "twitter_title": said(c("page.twitter_title")), "twitter_description": said(c("page.twitter_description")), "jsonld_title": said(c("page.jsonld_title")), "jsonld_description": said(c("page.jsonld_description")),
        "jsonld_keywords": said(c("page.jsonld_keywords")), "main_text_preview": said(c("page.main_text_preview")), "page_schema_types": listed(c("page.schema_types")), "page_code_languages": listed(c("page.code_languages")),
        "page_hints": listed(c("page.page_type_hints")), "page_h1s": listed(c("page.headings_h1")), "page_h2s": listed(c("page.headings_h2")), "page_nav": listed(c("page.nav_text")), "page_generator": said(c("page.generator")),
        "site_given": F.when(has_site, name), "site_brands": F.when(has_site, brand_terms(name, registrable, title)),
        "site_types": F.when(c("met").isNotNull(), site_types(c("page.page_type_hints"), c("met.page_type_hints"), c("homepage_url"), c("met.og_site_name"))).when(c("success"), F.coalesce("page.page_type_hints", none)),
        "site_language": F.when(has_site, text.first_filled(c("page.lang"), c("met.lang"))),
        "site_fetch_status": F.when(c("looked"), c("home_state")).when(c("success"), "skipped"),
        "site_source": F.when(c("looked"), F.when(c("home_state") == "success", "fetched").otherwise("failed")).when(c("success"), "not_needed"),
        "fallback_chain": chain, "metadata_sources": F.array(F.when(c("success"), lit("page")).otherwise(lit("bookmark"))), "thin": ~c("success") | low_value(c("page")),
    })
    if external is not None:
        rows = with_external(rows, external)
    rows = health.link_health(rows.withColumn("status", c("fetch_status"))).drop("status")
    internal = ("http", "segments", "host_name", "rule", "first", "second", "home", "answered", "apart", "home_state", "refused", "warmed", "recovered", "success", "told", "page", "looked", "met", "thin")
    return rows.drop(*internal)


def with_external(rows: DataFrame, external: DataFrame) -> DataFrame:
    """Records that failed or are thin, with title, description and canonical link filled from the work that their first identifier names.

    ``external`` has doi, provider, title, description, canonical_url; one row for each identifier, however spelled.
    """
    c = F.col
    said = F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("canonical_url", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit("")), F.array_join("path_segments", "/"))
    rows = rows.withColumn("x_doi", F.when(c("thin"), F.lower(F.get(urls.dois(said), F.lit(0)))))
    given = external.groupBy(F.lower("doi").alias("x_doi")).agg(F.first(F.struct("provider", "title", "description", "canonical_url")).alias("x"))
    rows = rows.join(given, "x_doi", "left")
    provider = text.clean(c("x.provider"))
    return rows.withColumns({
        "title": F.when(c("x").isNotNull(), text.first_filled(c("title"), c("x.title"))).otherwise(c("title")),
        "meta_description": F.when(c("x").isNotNull(), text.first_filled(c("meta_description"), c("x.description"))).otherwise(c("meta_description")),
        "canonical_url": F.when(c("x").isNotNull(), text.first_filled(c("canonical_url"), c("x.canonical_url"))).otherwise(c("canonical_url")),
        "metadata_sources": F.when(c("x").isNotNull() & (provider != ""), F.array_union("metadata_sources", F.array(provider))).otherwise(c("metadata_sources")),
    }).drop("x", "x_doi")


def checkpoint(links: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Every link with its result so far; links without one are marked as pending errors, which a later run tries again."""
    both = links.join(done, key, "left")
    there = F.col("fetch_status").isNotNull()
    return both.withColumns({"checkpoint_pending": ~there, "fetch_status": F.coalesce("fetch_status", F.lit("error")), "error": F.when(there, F.col("error")).otherwise(PENDING)})


def two_passes(first: DataFrame, second: DataFrame, key: str, priority: Column) -> DataFrame:
    """The better result of two passes for each key: the second pass decides ties.  ``priority`` is over either pass's columns."""
    rest = [x for x in first.columns if x != key]
    tagged = lambda df, n: df.select(key, F.struct(priority.alias("p"), F.lit(n).alias("n"), *rest).alias("r"))
    return tagged(first, 0).unionByName(tagged(second, 1)).groupBy(key).agg(F.max("r").alias("r")).select(key, *[F.col(f"r.{x}").alias(x) for x in rest])


def stats(rows: DataFrame) -> DataFrame:
    """One row: totals by outcome, links without need of review, trusted ones by domain, all and those to review by route, the success rate as text.

    Rows have fetch_status, review_required, trusted_override, trusted_domain and route.
    """
    c = F.col
    route = F.coalesce("route", F.lit("unknown"))
    success = F.count_if(c("fetch_status") == "success")
    total = F.count(F.lit(1))
    one = rows.agg(
        total.alias("total"), success.alias("success"), F.count_if(c("fetch_status") == "broken").alias("broken"), F.count_if(~c("fetch_status").isin("success", "broken")).alias("failed"),
        F.count_if(~c("review_required")).alias("review_free"), F.count_if(c("trusted_override")).alias("trusted"),
        F.format_string("%.1f%%", F.coalesce(success * F.lit(100.0) / F.nullif(total, F.lit(0)), F.lit(0.0))).alias("success_rate"),
    )

    def by(where: Column, value: Column, name: str) -> DataFrame:
        counts = rows.where(where).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias(name))

    parts = [by(F.lit(True), route, "routes"), by(c("review_required"), route, "review_by_route"), by(c("trusted_override"), F.coalesce("trusted_domain", "domain"), "trusted_domains")]
    for part in parts:
        one = one.crossJoin(part)  # one row each
    return one


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: by how much each total of two passes' `stats` changed."""
    names = ("success", "broken", "failed", "review_free")
    a, b = (df.select(*[F.col(n).alias(f"{n}_{x}") for n in names]) for df, x in ((before, "a"), (after, "b")))
    return a.crossJoin(b).select(*[(F.col(f"{n}_b") - F.col(f"{n}_a")).alias(f"{n}_delta") for n in names])  # one row each


def hotspots(first: DataFrame, final: DataFrame) -> DataFrame:
    """Domains that need review after the final pass or changed between passes: counts, reasons, routes, five links each; most reviews first, then most links, then by name.

    Rows of a pass have domain, fetch_status, review_required, reason_code, route, name, url and ord.
    """
    c = F.col
    named = F.coalesce(F.nullif(F.trim(F.coalesce("domain", F.lit(""))), F.lit("")), F.lit("未知域名"))
    first, final = first.withColumn("domain", named), final.withColumn("domain", named)
    count = lambda p: (F.count(F.lit(1)).alias(f"{p}total"), F.count_if("review_required").alias(f"{p}review"), F.count_if(c("fetch_status") == "success").alias(f"{p}success"))
    both = first.groupBy("domain").agg(*count("first_")).join(final.groupBy("domain").agg(*count("")), "domain", "full_outer")
    both = both.na.fill(0)
    both = both.withColumns({"review_delta": c("review") - c("first_review"), "success_delta": c("success") - c("first_success")})
    both = both.where("review > 0 or review_delta <> 0 or success_delta <> 0")
    bad = final.where("review_required")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy("ord"))
    few = bad.withColumn("rank", rank).where(c("rank") <= 5).groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "url", "reason_code"))), lambda x: x.dropFields("rank")).alias("representatives"))
    out = both.join(top(bad, "domain", c("reason_code"), at=c("ord"), limit=10, name="reasons"), "domain", "left")
    out = out.join(top(final, "domain", F.coalesce("route", F.lit("unknown")), at=c("ord"), limit=4, name="routes"), "domain", "left").join(few, "domain", "left")
    return out.select("domain", "review", "total", "success", "reasons", "routes", "review_delta", "success_delta", "representatives").orderBy(c("review").desc(), c("total").desc(), "domain")


def broken_links(rows: DataFrame) -> DataFrame:
    """Links whose page answered with an error and whose site is not trusted, in input order."""
    return rows.where((F.col("fetch_status") == "broken") & ~F.coalesce("trusted_override", F.lit(False))).orderBy("ord").select("id", "name", "url", "status_code", "error", "reason_code", F.col("reason_label").alias("review_category"))


def review_queue(rows: DataFrame) -> DataFrame:
    """Links that need review, in input order, with what is known of the failure."""
    return rows.where("review_required").orderBy("ord").select("id", "name", "url", "domain", "fetch_status", "status_code", "error", F.col("reason_label").alias("review_category"), "reason_code", "access_pattern")
