"""The display tree of folders, routes, suggestions, bundles and exports on literal cases."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import clusters, display
from linkloom.operators.display import Folder, Options

O = Options()


def leaf(name, count, **more):
    return Folder(name, sources=[name], direct=count, **more)


def test_single_children_collapse_and_small_leaves_rise():
    root = Folder("Root", [Folder("Only Child", [leaf("Only Grandchild", 1)]), leaf("Tiny", 1)])
    out = display.optimize(root, 2, is_root=True)
    assert [c.name for c in out.children] == ["Only Grandchild"] and out.sources == ["Tiny"] and out.count == 2


def test_reference_folders_stay():
    out = display.optimize(Folder("ref", [leaf("topic", 1)], kind="reference"), 2)
    assert out.name == "ref" and [c.name for c in out.children] == ["topic"]


def test_names_that_differ_by_marks_merge_in_order():
    out = display.optimize(Folder("r", [leaf("Foo_Bar", 6, order=4), leaf("foo bar", 7, order=2), leaf("z", 9), leaf("empty", 0)], preserve=True), 2)
    assert [(c.name, c.count, c.order) for c in out.children] == [("Foo_Bar", 13, 2), ("z", 9, None)]


def test_depth_limit():
    tree = Folder("a", [Folder("b", [Folder("c", [leaf("d", 2)], sources=["c"], direct=1)])])
    cut = display.limit_depth(tree, 2)
    assert [p for p, _ in cut.walk()] == [("a",), ("a", "b")] and cut.children[0].direct == 3 and display.limit_depth(tree, 0) is tree


def roots(**counts):
    return {name: leaf(name, n, preserve=True) for name, n in counts.items()}


def test_small_discovery_joins_the_tidy_root():
    top = display.assemble(roots(园艺=2, 食谱=3, 待整理=1, 发现主题=1))
    assert [f.name for f in top] == ["园艺", "食谱", "待整理"] and [c.name for c in top[2].children] == ["发现主题"]
    top = display.assemble(roots(园艺=2, 待整理=1, 发现主题=3))
    assert [f.name for f in top] == ["园艺", "待整理", "发现主题"] and not top[1].children


def test_groups_of_roots():
    many = roots(**{f"r{n:02}": 1 for n in range(11)})
    assert [(f.name, len(f.children)) for f in display.assemble(many)] == [("主要主题", 11)]
    # a wrapper of all normal roots is no group in automatic mode
    assert [f.name for f in display.assemble(roots(a=1, b=1), [{"name": "主要主题", "roots": ["a", "b"]}])] == ["a", "b"]
    given = display.assemble(roots(a=1, b=1, c=1, 发现主题=4), [{"name": "G", "roots": ["a", "b", "missing"]}])
    assert [(f.name, [c.name for c in f.children]) for f in given] == [("G", ["a", "b"]), ("待整理", []), ("发现主题", [])]


def test_tidy_roots_and_oversized_leaves(spark):
    rows = [("待整理", "主题不明确", "", 1), ("待整理", "信息不足", "", 1), ("待整理", "候选主题", "Docker", 2), ("数据库", "PostgreSQL", "博客", 4), ("数据库", "PostgreSQL", "文档", 4)]
    top = {f.name: f for f in display.assemble(display.roots_of(rows))}
    assert [c.name for c in sorted(top["待整理"].children, key=Folder.sort_key)] == ["信息不足", "候选主题", "主题不明确"]
    assert [c.name for c in top["数据库"].children[0].children] == ["博客", "文档"] and top["数据库"].children[0].direct == 0
    kinds = [(n, "x", "文档" if n < 4 else "博客" if n < 8 else "未知") for n in range(10)] + [(n, "y", "文档") for n in range(10, 30)]
    parts = display.oversized_parts(spark.createDataFrame(kinds, "id long, leaf string, resource_type string"), 10)
    assert {(r["leaf"], r["part"], r["n"]) for r in parts.groupBy("leaf", "part").agg(F.count("*").alias("n")).collect()} == {("x", "文档", 4), ("x", "博客", 4), ("x", "其他", 2), ("y", "", 20)}


PROFILE = (
    "cluster long, size long, label string, average_confidence double, fetch_blocked_share double, review_share double, roots_found array<struct<value:string,n:double,share:double>>, "
    "categories array<struct<value:string,n:bigint,share:double>>, hints_found array<struct<value:string,n:bigint,share:double>>, domains array<struct<value:string,n:bigint,share:double>>, tokens array<string>"
)


def cell(*pairs):
    return [(v, 1, s) for v, s in pairs]


def profile(n, size=4, label="Fresh topic", confidence=0.4, blocked=0.0, review=0.0, roots=(("db", 1.0),), categories=(("待整理", 1.0),), hints=(("TiDB", 1.0),), domains=(("e.org", 1.0),), tokens=("tidb",)):
    return (n, size, label, confidence, blocked, review, [(v, s, s) for v, s in roots], cell(*categories), cell(*hints), cell(*domains), list(tokens))


CASES = {
    "discovery": (profile(1), "发现主题", "create_topic"), "blocked": (profile(2, blocked=1.0, review=1.0), "待整理", "investigate_fetch_failures"),
    "single": (profile(3, size=1, categories=(("db/x", 1.0),)), "db", None), "small": (profile(4, size=2), "待整理", None),
    "host": (profile(5, label="E", domains=(("e.org", 1.0),)), "待整理", "create_topic"), "normal": (profile(6, confidence=0.9, categories=(("db/x", 1.0),)), "db", None),
    "platform": (profile(7, domains=(("qq.com", 1.0),), tokens=("x",)), "待整理", "create_topic"),
    "mixed": (profile(8, confidence=0.9, roots=(("db", 0.4), ("web", 0.35)), categories=(("db/x", 0.4), ("web/y", 0.35))), "发现主题", "split_mixed_cluster"),
    "no roots": (profile(9, confidence=0.6, roots=(), hints=(), categories=(("db/x", 0.6),)), "db", None), "close": (profile(10, confidence=0.9, roots=(("db", 0.5), ("web", 0.45)), categories=(("db/x", 0.9),)), "发现主题", "add_specific_domain"),
    "public suffix": (profile(11, confidence=0.7, categories=(("db/x", 0.6), ("web/y", 0.4)), domains=(("org.cn", 0.5), ("https_redis.io", 0.25), ("rocksdb.org", 0.25))), "db", "add_specific_domain"),
    "alias": (profile(12, confidence=0.7, categories=(("db/x", 0.6), ("web/y", 0.4)), domains=(("org.cn", 1.0),)), "db", "add_alias"),
    "demote": (profile(13, confidence=0.7, categories=(("db/x", 0.6), ("web/y", 0.4)), domains=(("org.cn", 1.0),), tokens=(), hints=()), "db", "demote_noisy_keyword_or_folder_signal"),
}


@pytest.fixture(scope="module")
def routed(spark):
    return clusters.route(spark.createDataFrame([c[0] for c in CASES.values()], PROFILE), clusters.Options(discovery_min=3))


def test_routes(routed):
    got = {r["cluster"]: (r["destination_root"], r["route_reasons"]) for r in routed.collect()}
    assert {name: got[c[0][0]][0] for name, c in CASES.items()} == {name: c[1] for name, c in CASES.items()}
    assert got[2][1] == ["fetch_blocked_guard", "review_required_guard", "routed_to_tidy"] and got[5][1][0] == "source_host_label_guard" and got[7][1][0] == "generic_platform_guard"


def test_suggestions(routed):
    rows = clusters.suggestions(routed).collect()
    assert {r["cluster"]: r["type"] for r in rows} == {c[0][0]: c[2] for c in CASES.values() if c[2]}
    assert [(r["size"], r["label"]) for r in rows] == sorted(((r["size"], r["label"]) for r in rows), key=lambda x: (-x[0], x[1]))
    by = {r["cluster"]: r for r in rows}
    assert by[11]["proposed_domains"] == ["rocksdb.org"] and by[7]["proposed_domains"] == [] and by[8]["target_root"] == "" and by[12]["target_root"] == "db"


def test_strong_categories(spark):
    rows = [(n, 1, "a/x" if n < 3 else "b/y", 0.9, False) for n in range(5)] + [(n, 2, "a/x" if n < 13 else "b/y", 0.5, False) for n in range(10, 16)]
    rows += [(20, 3, "a/x", 0.9, True), (21, 3, "b/y", 0.9, True), (22, 3, "待整理", 0.9, True)] + [(30, 4, "a/x", 0.9, False), (31, 4, "b/y", 0.9, False), (32, 4, "c/z", 0.9, False)]
    got = clusters.strong_groups(spark.createDataFrame(rows, "id long, cluster long, category string, confidence double, platform boolean"))
    assert {r["id"]: r["part"] for r in got.collect()} == {0: "a/x", 1: "a/x", 2: "a/x", 3: "b/y", 4: "b/y", 20: "a/x", 21: "b/y", 22: ""}


def test_document_order_and_escapes(spark):
    sources = spark.createDataFrame([(1, "b", "", ""), (2, "a & b", "x", ""), (3, "a & b", "x", ""), (4, "a & b", "", "")], "id long, root string, folder string, sub string")
    folders, shown = display.tree(spark, sources, options=Options(small=0))
    records = spark.createDataFrame([(n, f"<{n}>", f"https://e.org/?a=1&b={n}", "7" if n == 1 else None, "i" if n == 2 else None) for n in range(1, 5)], "id long, name string, url string, add_date string, icon string")
    text = "\n".join(r["line"] for r in display.document(folders, shown, records, now=5, doctype="<!D>", title="T", toolbar="Bar", other="Rest").orderBy("at", "ord").collect())
    places = [text.index(x) for x in ("<!D>", "Bar", "a &amp; b", ">x<", "&lt;2&gt;", "&lt;3&gt;", "&lt;4&gt;", ">b<", "&lt;1&gt;", "Rest")]
    assert places == sorted(places) and 'ADD_DATE="7"' in text and ' ICON="i"' in text and "a=1&amp;b=3" in text and text.count("<DL><p>") == text.count("</DL><p>")


def bundle_row(n, topic="Docker", root="", hints=(), category="待整理", canonical=None, **more):
    candidates = [(f"{root}/Leaf", root, "Leaf", 30.0, True, ["title"])] if root else []
    return (n, f"r{n}", f"https://e.org/{n}#/{n}", canonical or f"https://e.org/{n}", "候选主题", category, candidates, [], [(topic, 4, ["title"])] if topic else [], list(hints), "e.org", "e.org", False)


def test_semantic_bundles(spark):
    schema = (
        "id long, record string, url string, canonical string, bucket_name string, category string, rule_candidates array<struct<category:string,root:string,leaf:string,total:double,strong:boolean,signals:array<string>>>, "
        "rule_roots array<struct<root:string,total:double,support:double>>, open_topics array<struct<topic:string,score:int,sources:array<string>>>, cluster_hints array<string>, registered string, low_domain string, platform boolean"
    )
    rows = [bundle_row(1, canonical="same"), bundle_row(2, canonical="same"), bundle_row(3, topic="", hints=("Docker",)), *[bundle_row(n, topic="", root="db") for n in (4, 5)], bundle_row(6, topic="Lonely", root="ops"), bundle_row(7, topic="", root="ops", category="ops/x"), bundle_row(8, topic="", root="ops")]
    rows = [(*r[:10], f"s{r[0]}.org", f"s{r[0]}.org", False) for r in rows]
    f = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["bundle"], r["priority"]) for r in display.semantic_bundles(f, min_support=2, root_min=1).collect()}
    assert got[1] == got[2] == got[3] == ("Docker", 4) and got[4] == got[5] == ("Leaf", 5) and got[6] == got[7] == got[8] == ("Leaf", 5)
    shaped = display.bundle_rows(display.semantic_bundles(f), f).collect()
    assert [(r["bundle"], r["support"], r["root_hint"]) for r in shaped] == [("Leaf", 3, "ops"), ("Docker", 3, ""), ("Leaf", 2, "db")] and all(r["bundle_id"].startswith("ts_") for r in shaped)
    alone = display.semantic_bundles(f.where("id in (4, 8)"), root_min=1)
    assert {r["id"]: r["bundle"] for r in alone.collect()} == {4: "db相关", 8: "ops相关"}
