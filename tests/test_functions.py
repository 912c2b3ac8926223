"""Scalar functions on literal cases."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from linkloom.functions import text, urls
from linkloom.operators import clusters, health, taxonomy
from linkloom.sources import html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url, want", [
    ("HTTP://Example.COM:80", "http://example.com/"), (" https://U:p@Ex.org:443/A?b#c ", "https://U:p@ex.org/A?b"), ("https://ex.org:8443/a/", "https://ex.org:8443/a/"),
    ("mailto:x@y.z", "mailto:x@y.z"), ("no url", "no url"), ("", ""), (None, ""),
])
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.lit(url).cast("string"))) == want


def test_normalize_keeps_fragment_on_request(spark):
    assert one(spark, urls.normalize(F.lit("https://ex.org/a#b"), True)) == "https://ex.org/a#b"


@pytest.mark.parametrize("host, by_suffix, by_country, two", [("docs.x.com.cn", "x.com.cn", "x.com.cn", "com.cn"), ("docs.x.cn", "x.cn", "docs.x.cn", "x.cn"), ("a.b.org.cn", "org.cn", "b.org.cn", "org.cn"), ("10.0.0.1", "10.0.0.1", "0.1", "0.1")])
def test_domain_notions_differ(spark, host, by_suffix, by_country, two):
    h = F.lit(host)
    assert (one(spark, urls.registrable(h)), one(spark, urls.by_country(h)), one(spark, urls.two_labels(h))) == (by_suffix, by_country, two)


def test_repository_and_doi(spark):
    assert one(spark, urls.repository(F.lit("https://github.com/a/b/tree"))) is True
    assert one(spark, urls.repository(F.lit("https://github.com/topics/b"))) is False
    assert one(spark, urls.dois(F.lit("see 10.1000/AbC). and 10.1000/abc"))) == ["10.1000/AbC"]


@pytest.mark.parametrize("said, keyword, want", [("an api.", "api", True), ("capital", "api", False), ("source codes", "source code", True), ("学习教程", "教程", True), ("c++ notes", "c++", True)])
def test_keyword_boundaries(spark, said, keyword, want):
    assert one(spark, text.has_keyword(F.lit(said), keyword)) is want
    assert one(spark, text.found_keywords(F.lit(said), [keyword, "absent"])) == ([keyword] if want else [])


def test_tokens(spark):
    assert one(spark, text.token(F.lit(" Foo-Bar 教程! "))) == "foobar教程"
    assert one(spark, text.generated_id(F.lit("deadbeef1234"))) is True
    assert one(spark, text.slogan(F.lit("发现你的发现"))) is True
    assert one(spark, text.label(F.lit("the_api_API home json"))) == "API JSON"
    assert one(spark, text.label(F.lit("the"))) == "其他"
    assert one(spark, text.escape_html(F.lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"


def test_time_bucket(spark):
    assert tuple(one(spark, text.time_bucket(F.lit("1704067200")))) == ("2024", "2024-01", "2024-W01")
    assert tuple(one(spark, text.time_bucket(F.lit("soon")))) == ("", "", "")
    assert tuple(one(spark, text.time_bucket(F.lit("-5")))) == ("", "", "")


@pytest.mark.parametrize("status, code, error, want", [
    ("success", 200, None, "ok"), ("timeout", None, "", "timeout"), ("broken", 403, "", "access_denied"), ("broken", 429, "", "rate_limited"), ("broken", 410, "", "not_found"),
    ("broken", 503, "", "server_error"), ("broken", 418, "", "http_error"), ("skipped", None, "", "invalid_url"), ("error", None, "Hostname mismatch", "certificate"),
    ("error", None, "getaddrinfo failed", "dns_connection"), ("error", None, None, "other_error"),
])
def test_reasons(spark, status, code, error, want):
    assert one(spark, health.reason(F.lit(status), F.lit(code).cast("int"), F.lit(error).cast("string"))) == want


EXPORT = """<DL><p><DT><H3>Bar</H3><DL><p>
<DT><H3>Languages</H3><DL><p><DT><A HREF="https://a.example.org/x" ADD_DATE="1710000000" ICON="i">A page</A>
<DT><H3>Deep</H3><DL><p><DT><A HREF="https://a.example.org/y" ADD_DATE="1710000001" DESCRIPTION="about y">Y</A></DL><p></DL><p>
<DT><A HREF="javascript:void(0)">no link</A><DT><A HREF="https://b.example.org/">B</A><DT><A HREF="HTTPS://B.example.org:443">again</A></DL><p></DL>"""
PAGE = """<html lang="en"><head><title>T</title><meta name="description" content="D"><meta name="keywords" content="k1, k2"><meta property="og:title" content="OG"><link rel="canonical" href="/c">
<meta name="generator" content="gen 1"><script type="application/ld+json">{"@graph": [{"@type": "TechArticle", "headline": "H", "author": {"name": "N"}, "keywords": ["x; y"]}]}</script><script type="application/ld+json">{bad</script></head>
<body><nav>a b</nav><h1>One</h1><h2>Two</h2><h2>Two</h2><main>main  text<script>no()</script></main><pre><code class="language-python hl">x</code></pre></body></html>"""


def test_export_folders(spark):
    files = spark.createDataFrame([(1, EXPORT), (2, None), (3, "")], "file_id long, text string")
    rows = html.parse_exports(files, ("Bar",)).orderBy("ord").collect()
    assert [(r["url"], r["folder_path"], r["icon"]) for r in rows[:3]] == [("https://a.example.org/x", ["Languages"], "i"), ("https://a.example.org/y", ["Languages", "Deep"], ""), ("https://b.example.org/", [], "")]
    kept = html.links_of(html.parse_exports(files, ("Bar",)), "n").orderBy("ord").collect()
    assert [(r["id"], r["domain"], r["copies"], r["description"]) for r in kept] == [("n0", "a.example.org", 1, ""), ("n1", "a.example.org", 1, "about y"), ("n2", "b.example.org", 2, "")]


def test_page_signals(spark):
    pages = [(1, "https://e.org/docs/b", PAGE, "text/html"), (2, "https://e.org/feed", "<rss><title>F</title><h1>no heading</h1></rss>", "application/rss+xml"), (3, None, None, None), (4, "u", "<main>m</main><article>a</article>", None)]
    r = {x["page_id"]: x for x in html.page_signals(spark.createDataFrame(pages, "page_id long, url string, html string, content_type string")).collect()}
    one_ = r[1]
    assert (one_["title"], one_["og_title"], one_["canonical_url"], one_["headings_h2"], one_["main_text_preview"], one_["schema_types"], one_["code_languages"]) == ("T", "OG", "https://e.org/c", ["Two"], "main text", ["TechArticle"], ["python"])
    assert (one_["jsonld_title"], one_["jsonld_authors"], one_["jsonld_keywords"], one_["keywords"], one_["generator"], one_["nav_text"]) == ("H", ["N"], "x, y", "k1, k2", "gen 1", ["a b"])
    assert "documentation" in one_["page_type_hints"] and "blog" in one_["page_type_hints"]
    assert (r[2]["title"], r[2]["headings_h1"], r[3]["title"], r[4]["main_text_preview"]) == ("F", [], "", "m")


@pytest.mark.parametrize("value, want", [("A/B tests", ["A", "B tests"]), (["x", {"name": "y"}, None], ["x", "y"]), ({"headline": "h; i"}, ["h", "i"]), (3, [])])
def test_structured_texts(value, want):
    assert html.text_list(value) == want


@pytest.mark.parametrize("given, want", [
    (text.title_case, {"pandas": "Pandas", "API": "API", "json": "JSON", "the": "The", "JSONlike": "Jsonlike", "x86": "x86"}),
    (text.leading_segment, {" | a - b": "a", "one | two": "one", "a - b - c": "a", "a-b": "a-b", "": ""}), (text.human_label, {"  Guide. | site": "Guide", "/x/": "x", "": ""}),
    (text.label, {"the_api_API home json": "API JSON", "the": "其他", "C++ notes": "C notes", "a/b x-y": "x-y"} | {"a/b x-y": "b x-y"}), (text.label_key, {"Foo_Bar-baz.q": "foobarbazq"}), (text.folder_key, {"Foo_Bar  baz": "foo bar baz", "": "其他"}),
    (text.domain_name, {"github.com": "GitHub", "abc.org": "ABC", "example.org": "Example", "": ""}), (text.slogan, {"发现你的发现": True, "开源技术社区": True, "开源": False, "a你的a": False}),
    (text.generated_id, {"deadbeef1234": True, "ab12cd34ef": False, "a1234567": True}), (text.low_signal_title, {"!!!": True, "12345678 x": True, "Hello": False, "": False, "202401 99": True}),
    (text.generic_label, {"": True, "Docs": True, "a.example.org": True, "Kubernetes": False, "其他": True}), (text.resource_name, {"Documentation": "文档", "": "未知", "x": "x"}),
    (text.specific_domain, {"org.cn": False, "https_redis.io": False, "rocksdb.org": True, "x": False, "Example.org.": True}), (text.default_category, {"待整理": True, "a/其他": True, "a/b": False, "": True}),
])
def test_labels(spark, given, want):
    rows = spark.createDataFrame(list(want.items()), "k string, v string") if all(isinstance(v, str) for v in want.values()) else spark.createDataFrame([(k,) for k in want], "k string")
    assert {r["k"]: r["x"] for r in rows.select("k", given(F.col("k")).alias("x")).collect()} == want


def test_paths_and_kinds(spark):
    path = text.path_keywords(F.lit("https://e.org/docs/papers/kube-proxy?x=1"))
    assert one(spark, path) == ["papers", "kube", "proxy"] and one(spark, text.url_types(path)) == ["论文"]
    assert one(spark, text.choose_resource(F.array(F.lit("博客"), F.lit("文档"), F.lit("a")))) == "文档" and one(spark, text.choose_resource(F.array().cast("array<string>"))) == "未知"
    assert one(spark, text.repository_label(F.lit("https://github.com/o/kube-proxy.git"), F.lit("github.com"))) == "kube-proxy"
    assert one(spark, text.repository_label(F.lit("https://e.org/o/kube-proxy"), F.lit("e.org"))) == ""
    assert one(spark, text.category_leaf_label(F.lit("a/b/c"), F.lit("a"))) == "b / c" and one(spark, text.category_leaf_label(F.lit("a"), F.lit("a"))) == ""
    assert one(spark, text.weighted_jaccard(F.create_map(F.lit("a"), F.lit(0.5)), F.create_map(F.lit("a"), F.lit(0.25), F.lit("b"), F.lit(0.5)))) == 0.25
    assert one(spark, urls.dois(F.lit("x 10.1000%2Fab+c"))) == ["10.1000/ab"]


@pytest.mark.parametrize("broken", [{"path": "a//b"}, {"path": "a/b/c/d"}, {"path": "x", "topic_domains": ["docs.github.com"]}, {"path": "x", "title_patterns": [{"regex": "("}]}])
def test_taxonomy_rejects(broken):
    with pytest.raises(taxonomy.InvalidTaxonomy):
        taxonomy.categories({"categories": [broken]})


@settings(max_examples=6, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components_whatever_the_order(spark, edges):
    parent = list(range(13))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = clusters.components(spark.range(13), spark.createDataFrame(edges[::-1], "a long, b long"))
    assert {r["id"]: r["cluster"] for r in got.collect()} == {n: top(n) for n in range(13)}
