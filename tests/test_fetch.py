"""Fetch results to records: fallbacks, enrichment, policies, reports."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import fetch, health
from linkloom.operators.fetch import Proxy
from linkloom.sources import html

RESULT = f"fetch_key string, fetch_status string, status_code int, error string, resolved_url string, page struct<{html.PAGE.replace(' string', ':string').replace(' array', ':array')}>"


def page(**said):
    return {**dict.fromkeys(html.TEXTS, ""), **{k: [] for k in html.LISTS}, **said}


RICH = "A very long text. " * 20


@pytest.fixture(scope="module")
def got(spark):
    links = ["https://rich.org/", "https://thin.org/a", "https://gone.org/a/b", "https://shy.org/a", "https://down.org/a", "ftp://x/y", "https://stubborn.org/a", "https://kept.org/a", "https://doi.org/10.1000/abc", "https://quiet.org/a"]
    rows = spark.createDataFrame([(n, u, u) for n, u in enumerate(links)], "ord long, url string, fetch_key string").withColumns({"id": F.col("ord").cast("string"), "domain": F.regexp_extract("url", "//([^/]*)", 1)})
    ok = lambda u, **said: (u, None, 200, None, u, page(**said))
    bad = lambda u, code: (u, None, code, None, u, page())
    results = [ok(links[0], og_title="A rich page about things", main_text_preview=RICH, lang="en"), ok(links[1], title="Home", page_type_hints=["blog"]), bad(links[2], 404), bad(links[3], 403), (links[4], "timeout", None, "timed out", None, None), bad(links[6], 403), ok(links[7], title="A rather long title here", main_text_preview=RICH), bad(links[8], 404), ok(links[9], title="Home")]
    home = lambda u, code=200, **said: (u, None, code, page(**said))
    homes = [home("https://thin.org/", og_site_name="Thin Site", lang="de", page_type_hints=["product"]), home("https://gone.org/", title="Gone | inc"), home("https://shy.org/", title="Shy home"), home("https://down.org/", 500), home("https://stubborn.org/", title="Stubborn github mirror", og_site_name="GitHub mirror"), home("https://quiet.org/", title="Quiet home")]
    again = [(links[3], None, 200, None, links[3], page(title="Shy but found at last", main_text_preview=RICH)), (links[6], None, 403, None, links[6], page())]
    overrides = spark.createDataFrame([("quiet.org", (False, None))], "suffix string, setting struct<fetch_homepage:boolean,origin_warmup_retry:boolean>")
    external = spark.createDataFrame([("10.1000/ABC", "works", "A paper", "Venue 2020", "https://doi.org/x")], "doi string, provider string, title string, description string, canonical_url string")
    homes = spark.createDataFrame(homes, RESULT.replace("fetch_key", "homepage_url").replace(", error string, resolved_url string", ""))
    out = fetch.records(rows, spark.createDataFrame(results, RESULT), homes, retries=spark.createDataFrame(again, RESULT), overrides=overrides, external=external)
    out = health.apply_trust(out, health.trust_rules({"enabled": True, "domain_suffixes": ["stubborn.org"], "allow_reason_codes": ["access_denied"]}), "domain")
    return {r["domain"] or r["url"]: r for r in out.collect()}


def test_success_keeps_what_the_page_says(got):
    r = got["rich.org"]
    assert (r["fetch_status"], r["title"], r["site_fetch_status"], r["site_source"], r["site_given"]) == ("success", "A rich page about things", "skipped", "not_needed", "A rich page about things")


def test_thin_pages_are_enriched_from_the_homepage(got):
    r = got["thin.org"]
    assert (r["site_given"], r["site_language"], r["site_types"], r["site_source"]) == ("Thin Site", "de", ["blog", "product"], "fetched")
    assert {"Thin", "Site", "thin", "org", "Home"} <= set(r["site_brands"]) and got["quiet.org"]["site_source"] == "not_needed"


def test_failures_keep_the_site(got):
    r = got["gone.org"]
    assert (r["fetch_status"], r["reason_code"], r["error"], r["site_given"], r["fallback_chain"], r["title"]) == ("broken", "not_found", "HTTP 404", "Gone | inc", ["homepage_site_profile"], None)
    assert (got["down.org"]["fetch_status"], got["down.org"]["site_source"], got["down.org"]["site_fetch_status"]) == ("timeout", "failed", "broken")


def test_second_tries_after_the_homepage(got):
    r = got["shy.org"]
    assert (r["fetch_status"], r["title"], r["fallback_chain"], r["attempts"]) == ("success", "Shy but found at last", ["origin_warmup_homepage", "origin_warmup_retry"], 2)
    r = got["stubborn.org"]
    assert (r["fetch_status"], r["fallback_chain"], r["site_types"], r["trusted_override"], r["reason_code"], r["raw_reason_code"], r["review_required"], r["trusted_domain"]) == ("broken", ["origin_warmup_homepage"], ["repository"], True, "trusted_access", "access_denied", False, "stubborn.org")


def test_other_schemes_are_skipped(got):
    r = got["x"]
    assert (r["fetch_status"], r["reason_code"], r["user_action_required"], r["error"], r["route"]) == ("skipped", "invalid_url", True, "Invalid URL", None)


def test_external_metadata_fills_failures_only(got):
    r = got["doi.org"]
    assert (r["title"], r["meta_description"], r["canonical_url"], r["metadata_sources"]) == ("A paper", "Venue 2020", "https://doi.org/x", ["bookmark", "works"])
    assert got["kept.org"]["metadata_sources"] == ["page"]


def test_proxy_routes(spark):
    p = Proxy(True, http="h", every="e")
    assert p.configured and not Proxy(True).configured and not p.under({"prefer_direct": True}).configured and Proxy(http="h").under({"prefer_proxy": True}).configured
    row = spark.range(1).select(p.of(F.lit("https://x/")).alias("s"), p.of(F.lit("http://x/")).alias("p"), p.of(F.lit("ftp://x/")).alias("f"), fetch.fetch_context(p, F.lit(2), F.lit("http://x/")).alias("c")).first()
    assert (row["s"], row["p"], row["f"], row["c"]["route"], row["c"]["resolved_proxy"]) == ("e", "h", "e", "proxy", "h") and not Proxy().configured


def test_checkpoint_marks_what_is_pending(spark):
    links = spark.createDataFrame([("a",), ("b",)], "id string")
    done = spark.createDataFrame([("a", "success", "")], "id string, fetch_status string, error string")
    got = {r["id"]: (r["fetch_status"], r["checkpoint_pending"], r["error"]) for r in fetch.checkpoint(links, done).collect()}
    assert got == {"a": ("success", False, ""), "b": ("error", True, fetch.PENDING)}
