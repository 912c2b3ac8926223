"""The display tree: where clusters' records are shown, the tidy root by reason, oversized folders by kind, groups of roots.

What concerns records is DataFrame work; folders are few (they are read by people), so the tree of folders itself is put together on
the driver, out of one row for each folder, and the result joined back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon, text, urls
from .skew import written

#: Folders without an order of their own come after those with one.
LAST = 10**6
BUCKET_ORDER = {name: n for n, name in enumerate(lexicon.BUCKET_NAMES.values())}


@dataclass(frozen=True)
class Options:
    """Names and sizes of the display tree."""

    max_depth: int = 3
    collapse: bool = True
    mode: str = "auto"
    main: str = lexicon.MAIN_GROUP
    fallback: str = lexicon.DEFAULT_CATEGORY
    discovery: str = lexicon.DISCOVERY_ROOT
    tidy: str = lexicon.DEFAULT_CATEGORY
    max_direct_roots: int = 10
    standalone_discovery: int = 3
    semantic_min: int = 3
    root_min: int = 3
    resource_min: int = 5
    resource_max: int = 40
    oversized: int = 40
    small: int = 5


# ---- records -------------------------------------------------------------------------------------

def place(profiles: DataFrame, members: DataFrame, options: Options = Options(), inline: int = 20) -> DataFrame:
    """(id, cluster, root, folder) of each record; an empty folder is the root itself.

    A cluster of one record has a folder only where its leaf or label says something.  Folders of a root whose names differ by case
    and marks alone are one, under the name that came first.
    """
    c, o = F.col, options
    root = F.coalesce("destination_root", F.lit(o.discovery))
    leaf = F.when(c("dominant") != "", text.category_leaf_label(c("dominant"), root)).otherwise("")
    shown = F.when(c("label") != "", c("label")).when(leaf != "", leaf).otherwise(root)
    rows = profiles.select("cluster", "size", "cluster_order", "dominant_share", root.alias("root"), leaf.alias("leaf"), shown.alias("shown"))
    said = (c("leaf") != "") & ~text.generic_label(c("leaf"), c("root"))
    special = c("root").isin(o.discovery, o.tidy)
    merged_in = ~special & (c("size") <= inline) & (c("dominant_share") >= 0.8) & (c("size") == 1) & ~(said | ~text.generic_label(c("shown"), c("root")))
    own = ~merged_in & (special | (c("size") > 1) | said)
    name = F.when(~own, "").when((c("size") == 1) & (c("leaf") != ""), c("leaf")).otherwise(c("shown"))
    rows = rows.select("cluster", "root", name.alias("name"), "cluster_order").withColumn("key", F.when(c("name") != "", text.folder_key(c("name"))))
    named = rows.where("key is not null").groupBy("root", "key").agg(F.min_by("name", "cluster_order").alias("folder"))
    folders = rows.join(named, ["root", "key"], "left").select("cluster", "root", F.coalesce("folder", F.lit("")).alias("folder"))
    return members.select("id", "cluster").join(folders, "cluster")


def bucket_name(bucket: Column) -> Column:
    """The display name of a confirmation bucket; anything else is of low confidence."""
    return F.coalesce(F.try_element_at(text.lookup(lexicon.BUCKET_NAMES), F.lower(F.trim(F.coalesce(bucket, F.lit(""))))), F.lit(lexicon.BUCKET_NAMES["low_confidence"]))


def root_hint(tidy: str = lexicon.DEFAULT_CATEGORY) -> Column:
    """The root a tidy record is nearest to: its category's, a strong or high candidate's, or a root with 45 % of the support; else empty."""
    c = F.col
    by_rule = F.filter(F.slice("rule_candidates", 1, 3), lambda x: (x["root"] != "") & ~text.default_category(x["category"]) & (x["strong"] | (x["total"] >= 18)))
    by_root = F.filter(F.slice("rule_roots", 1, 2), lambda x: (x["root"] != "") & ((x["support"] >= 0.45) | (x["total"] >= 18)))
    own = F.when(~text.default_category(c("category")) & (c("category") != tidy), text.category_root(c("category")))
    return F.coalesce(own, F.get(by_rule, F.lit(0))["root"], F.get(by_root, F.lit(0))["root"], F.lit(""))


def label_candidates() -> Column:
    """What a tidy record could be filed under: leaves of good rules (5), open topics (4), hints (3), its site (2), in this order, as (key, label, source, priority).

    Rows have root_hint and bucket_name besides their features; labels that say nothing under these are left out, and so are repeats of a key.
    """
    c = F.col
    least = F.when(c("bucket_name") == lexicon.BUCKET_NAMES["low_confidence"], 3).otherwise(2)
    good = F.filter(F.slice("rule_candidates", 1, 2), lambda x: ~text.default_category(x["category"]) & (x["strong"] | (x["total"] >= 20)))
    topics = F.filter(F.slice("open_topics", 1, 2), lambda x: x["score"] >= least)
    site = F.when(c("registered") != "", c("registered")).otherwise(c("low_domain"))
    none = F.array().cast("array<string>")
    sources = (
        ("rule_leaf", 5, F.transform(good, lambda x: text.category_leaf_label(x["category"], x["root"]))), ("open_topic", 4, F.transform(topics, lambda x: x["topic"])),
        ("cluster_hint", 3, F.slice("cluster_hints", 1, 4)), ("domain", 2, F.when((site != "") & ~c("platform"), F.array(text.domain_name(site))).otherwise(none)),
    )

    def tag(source: str, priority: int):
        return lambda x: F.struct(text.label(text.human_label(x)).alias("label"), F.lit(source).alias("source"), F.lit(priority).alias("priority"))

    tagged = F.flatten(F.array(*[F.transform(v, tag(s, p)) for s, p, v in sources]))
    keyed = F.transform(tagged, lambda x: F.struct(text.token(x["label"]).alias("key"), x["label"].alias("label"), x["source"].alias("source"), x["priority"].alias("priority")))
    context = F.when(c("root_hint") != "", c("root_hint")).otherwise(c("bucket_name"))
    taken = F.array(text.token(c("bucket_name")), text.token(F.lit(lexicon.DEFAULT_CATEGORY)), text.token(c("root_hint")))
    usable = F.filter(keyed, lambda x: (x["key"] != "") & ~F.array_contains(taken, x["key"]) & ~text.generic_label(x["label"], context) & ~text.weak(x["label"]) & ~text.noisy_label(x["label"]))
    keys = F.transform(usable, lambda x: x["key"])
    return F.filter(usable, lambda x, n: F.array_position(keys, x["key"]) == n + 1)


def semantic_bundles(rows: DataFrame, *, min_support: int = 2, root_min: int = 3, tidy: str = lexicon.DEFAULT_CATEGORY) -> DataFrame:
    """(id, bucket_name, bundle, root_hint, sources, priority): the bundle of each tidy record, null for leftovers.

    A record goes to its first candidate that ``min_support`` records of its bucket and root share; a bundle that is left with fewer is none.
    Leftovers meet under their root, if ``root_min`` of them have the same: X相关.  Rows are features with bucket_name.
    """
    c = F.col
    rows = rows.withColumn("root_hint", root_hint(tidy))
    # labels are judged once: what follows reads them again and again
    rows = written(rows.select("id", "bucket_name", "root_hint", label_candidates().alias("candidates")))
    offers = rows.select("id", "bucket_name", "root_hint", F.posexplode("candidates").alias("n", "x"))
    offers = offers.select("id", "bucket_name", "root_hint", "n", "x.*")
    group = ["bucket_name", "root_hint", "key"]
    support = offers.groupBy(*group).agg(F.count_distinct("id").alias("support"), F.max("priority").alias("priority"), F.array_sort(F.collect_set("source")).alias("sources")).where(c("support") >= min_support)
    spelled = offers.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("times"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(c("times").desc(), F.length(text.token(c("label"))).desc(), "label"))
    label = spelled.withColumn("rank", rank).where("rank = 1").select(*group, "label")
    first = offers.select("id", *group, "n").join(support.select(*group), group, "left_semi").groupBy("id", "bucket_name", "root_hint").agg(F.min_by("key", "n").alias("key"))
    first = written(first)
    kept = first.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where(c("size") >= min_support).select(*group)
    bundled = first.join(kept, group, "left_semi").join(support.select(*group, "priority", "sources"), group).join(label, group).select("id", c("label").alias("bundle"), "priority", "sources")
    found = rows.select("id", "bucket_name", "root_hint").join(bundled, "id", "left")
    by_root = found.where("bundle is null and root_hint <> ''").groupBy("bucket_name", "root_hint").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= root_min).select("bucket_name", "root_hint", F.lit(True).alias("rooted"))
    found = found.join(by_root, ["bucket_name", "root_hint"], "left").withColumn("fall", c("bundle").isNull() & F.coalesce("rooted", F.lit(False)))
    return found.select(
        "id", "bucket_name", F.when(c("fall"), F.concat("root_hint", F.lit("相关"))).otherwise(c("bundle")).alias("bundle"), "root_hint",
        F.when(c("fall"), F.array(F.lit("root_hint_fallback"))).otherwise(c("sources")).alias("sources"), F.when(c("fall"), F.lit(1)).otherwise(c("priority")).alias("priority"),
    )


def bundle_rows(bundled: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each bundle: support, sources, priority, stable id; by falling support, falling priority, then label."""
    named = rows.select("id", F.when(F.col("canonical") != "", F.col("canonical")).otherwise(F.coalesce("url", "record")).alias("identity"))
    out = bundled.where("bundle is not null").join(named, "id").groupBy("bucket_name", "root_hint", "bundle", "sources", "priority").agg(F.count(F.lit(1)).alias("support"), text.stable_id("ts_", F.collect_list("identity")).alias("bundle_id"))
    return out.orderBy(F.col("support").desc(), F.col("priority").desc(), "bundle")


def good_tidy_label(label: Column, bucket: Column, root: str, count: Column) -> Column:
    """Two records, and a label that is not generic, weak, noisy, the bucket's or root's own name, or a platform's suffix."""
    shown = text.human_label(label)
    return (
        (count >= 2) & (shown != "") & ~text.generic_label(shown, bucket) & ~text.weak(shown) & ~text.noisy_label(shown) & (text.token(shown) != text.token(bucket))
        & (text.token(shown) != text.token(F.lit(root))) & ~F.lower(shown).rlike("-(csdn|zhihu|github)$")
    )


#: Columns of features that the tidy root's folders are made by.
TIDY = ("id", "own_bucket", "category", "rule_candidates", "rule_roots", "open_topics", "cluster_hints", "registered", "low_domain", "platform", "resource_type", "time_bucket")


def tidy_places(placed: DataFrame, features: DataFrame, options: Options = Options()) -> DataFrame:
    """(id, bucket_name, folder) of the tidy root's records: by the reason they are there, then by meaning, kind and year.

    A folder with a good label stays whole under the reason that most of its records have; the records of others are bundled by meaning,
    what is left by kind where five share one, and by year where a kind has more than forty and the years part it well.
    """
    c, o = F.col, options
    f = features.withColumn("own_bucket", bucket_name(c("confirmation_bucket")))
    read = [x for x in f.columns if x in TIDY]
    rows = written(placed.where(c("root") == o.tidy).select("id", "folder").join(f.select(*read), "id"))
    order = F.create_map(*[F.lit(x) for k, v in BUCKET_ORDER.items() for x in (k, v)])
    counts = rows.where("folder <> ''").groupBy("folder", "own_bucket").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("folder").agg(F.min_by("own_bucket", F.struct(-c("n"), order[c("own_bucket")])).alias("bucket_name"), F.sum("n").alias("n"))
    main = main.withColumn("stays", (c("n") >= o.semantic_min) & good_tidy_label(c("folder"), c("bucket_name"), o.tidy, c("n"))).drop("n")
    rows = rows.join(main, "folder", "left").withColumns({"bucket_name": F.coalesce("bucket_name", "own_bucket"), "stays": F.coalesce("stays", F.lit(False))})
    rows = written(rows)
    pending = rows.where("not stays")
    bundled = semantic_bundles(pending, min_support=o.semantic_min, root_min=o.root_min, tidy=o.tidy).select("id", "bundle")
    kind = F.when(F.coalesce("resource_type", F.lit("")).isin("", lexicon.UNKNOWN), lexicon.OTHER).otherwise(c("resource_type"))
    left = pending.join(bundled, "id").withColumns({"kind_name": kind, "year": F.when(c("time_bucket.year") == "", "较早").otherwise(c("time_bucket.year"))})
    rest = left.where("bundle is null")
    years = rest.groupBy("bucket_name", "kind_name", "year").agg(F.count(F.lit(1)).alias("n"))
    kinds = years.groupBy("bucket_name", "kind_name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("years"), F.max("n").alias("most"))
    kinds = kinds.where((c("kind_name") != lexicon.OTHER) & (c("total") >= o.resource_min))
    by_year = F.lit(o.resource_max > 0) & (c("total") > o.resource_max) & (c("years") > 1) & (c("most") <= o.resource_max)
    left = left.join(kinds.select("bucket_name", "kind_name", by_year.alias("by_year")), ["bucket_name", "kind_name"], "left")
    folder = F.when(c("bundle").isNotNull(), c("bundle")).when(c("by_year").isNull(), "").when(c("by_year"), F.concat("kind_name", F.lit(" "), "year")).otherwise(c("kind_name"))
    return rows.where("stays").select("id", "bucket_name", "folder").unionByName(left.select("id", "bucket_name", folder.alias("folder")))


def oversized_parts(rows: DataFrame, limit: int = 40, least: int = 3) -> DataFrame:
    """(id, leaf, part): records of leaves of ``limit`` or more part by kind where two kinds have ``least``; smaller kinds are 其他, other leaves have an empty part.

    Rows have id, leaf and resource_type.
    """
    c = F.col
    kind = F.when(F.coalesce("resource_type", F.lit("")).isin("", lexicon.UNKNOWN), lexicon.OTHER).otherwise(c("resource_type"))
    rows = rows.select("id", "leaf", kind.alias("kind"))
    counts = rows.groupBy("leaf", "kind").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.groupBy("leaf").agg(F.sum("n").alias("size"), F.count_if(c("n") >= least).alias("large")).where((c("size") >= limit) & (c("large") >= 2) & F.lit(limit > 0)).select("leaf")
    names = counts.join(shape, "leaf", "left_semi").select("leaf", "kind", F.when(c("n") >= least, c("kind")).otherwise(lexicon.OTHER).alias("part"))
    return rows.join(names, ["leaf", "kind"], "left").select("id", "leaf", F.coalesce("part", F.lit("")).alias("part"))


def source_folders(profiles: DataFrame, members: DataFrame, features: DataFrame, options: Options = Options()) -> DataFrame:
    """(id, root, folder, sub) of every record before roots are grouped: tidy records by reason, oversized leaves of normal roots by kind."""
    c, o = F.col, options
    placed = written(place(profiles, members, o))
    tidy = tidy_places(placed, features, o).select("id", F.lit(o.tidy).alias("root"), c("bucket_name").alias("folder"), c("folder").alias("sub"))
    others = placed.where(c("root") != o.tidy).select("id", "root", "folder")
    normal = others.where(~c("root").isin(o.discovery, lexicon.UNSORTED))
    # a root's own records are a leaf only where it has no folders
    with_folders = normal.where("folder <> ''").select("root").distinct().withColumn("parted", F.lit(True))
    leaf = normal.join(with_folders, "root", "left").join(features.select("id", "resource_type"), "id")
    leaf = leaf.where((c("folder") != "") | c("parted").isNull())
    parts = oversized_parts(leaf.withColumn("leaf", F.struct("root", "folder")), o.oversized).select("id", "part")
    others = others.join(parts, "id", "left").withColumn("part", F.coalesce("part", F.lit("")))
    flat = (c("folder") == "") & (c("part") != "")
    return tidy.unionByName(others.select("id", "root", F.when(flat, c("part")).otherwise(c("folder")).alias("folder"), F.when(flat, "").otherwise(c("part")).alias("sub")))


# ---- folders -------------------------------------------------------------------------------------

@dataclass
class Folder:
    """A folder with the source folders (by key) whose records lie directly in it."""

    name: str
    children: list[Folder] = field(default_factory=list)
    sources: list = field(default_factory=list)
    direct: int = 0
    order: int | None = None
    kind: str = "mixed"
    preserve: bool = False

    @property
    def count(self) -> int:
        return self.direct + sum(c.count for c in self.children)

    def take(self, other: Folder) -> None:
        """The other folder's own records come into this one."""
        self.sources += other.sources
        self.direct += other.direct

    def sort_key(self) -> tuple:
        return (LAST if self.order is None else self.order, -self.count, self.name)

    def walk(self, path: tuple = ()) -> Iterator[tuple[tuple, Folder]]:
        yield (*path, self.name), self
        for child in self.children:
            yield from child.walk((*path, self.name))


def _folder_key(name: str) -> str:
    for mark in "_-/":
        name = name.replace(mark, " ")
    return " ".join(name.lower().split()) or lexicon.OTHER


def optimize(node: Folder, small: int, is_root: bool = False) -> Folder:
    """Empty folders out, folders of one name together, small leaves into their parent, folders with a single child and nothing else replaced by it.

    A folder that preserves its children keeps small ones and is not replaced; where all children are small the first stays;
    a reference folder is not replaced by one of another kind.
    """
    merged: dict[str, Folder] = {}
    for child in [optimize(c, small) for c in node.children if c.count > 0]:
        known = merged.setdefault(_folder_key(child.name), child)
        if known is not child:
            known.take(child)
            known.children = known.children + child.children
            known.kind = known.kind if known.kind == child.kind else "mixed"
            known.order = min((x for x in (known.order, child.order) if x is not None), default=None)
    out = Folder(node.name, sorted(merged.values(), key=Folder.sort_key), list(node.sources), node.direct, node.order, node.kind, node.preserve)
    if not out.preserve:
        low = [c for c in out.children if c.count <= small and not c.children]
        if low and len(low) == len(out.children):
            low = low[1:]
        for child in low:
            out.take(child)
        out.children = [c for c in out.children if not any(c is x for x in low)]
    while len(out.children) == 1 and not out.direct and not is_root and not out.preserve:
        only = out.children[0]
        if out.kind == "reference" != only.kind:
            break
        out.name, out.kind, out.children, out.sources, out.direct = only.name, only.kind, only.children, only.sources, only.direct
    return out


def limit_depth(node: Folder, depth: int) -> Folder:
    """The tree with what lies below ``depth`` levels moved up into the last one; 0 limits nothing."""
    if depth <= 0:
        return node
    out = Folder(node.name, [], list(node.sources), node.direct, node.order, node.kind, node.preserve)
    for child in node.children:
        if depth == 1:
            for _, below in child.walk():
                out.take(below)
        else:
            out.children.append(limit_depth(child, depth - 1))
    return out


def auto_groups(counts: dict[str, int], options: Options = Options()) -> list[tuple[str, list[str]]]:
    """Groups of roots: each normal root alone, all in one group when there are many; tidy roots; discovery alone unless it is small and there is a tidy root."""
    o = options
    normal = [r for r in counts if r not in (o.discovery, o.tidy, lexicon.UNSORTED)]
    groups = [(o.main, normal)] if len(normal) > o.max_direct_roots else [(r, [r]) for r in normal]
    tidy = [r for r in dict.fromkeys((o.tidy, lexicon.UNSORTED)) if r in counts]
    small = bool(tidy) and 0 <= counts.get(o.discovery, -1) < o.standalone_discovery
    if tidy:
        groups.append((o.tidy, tidy + [o.discovery] * small))
    if o.discovery in counts and not small:
        groups.append((o.discovery, [o.discovery]))
    return groups


def roots_of(rows: list[tuple[str, str, str, int]], options: Options = Options()) -> dict[str, Folder]:
    """Root folders out of (root, folder, sub, count) rows, normal roots by name, discovery last."""
    o, roots = options, {}
    for root, folder, sub, count in sorted(rows, key=lambda r: (r[0] == o.discovery, r)):
        node = roots.setdefault(root, Folder(root, preserve=True))
        for name in (folder, sub):
            if name:
                below = next((c for c in node.children if c.name == name), None)
                if below is None:
                    below = Folder(name, preserve=root == o.tidy, order=BUCKET_ORDER.get(name) if root == o.tidy and node.name == root else None)
                    node.children.append(below)
                    if name == sub:
                        node.preserve = True
                node = below
        node.sources.append((root, folder, sub))
        node.direct += count
    return roots


def assemble(roots: dict[str, Folder], groups: list[dict] | None = None, options: Options = Options()) -> list[Folder]:
    """The display tree: roots under their groups, roots without one under the fallback group, discovery last; optimised and cut at the depth limit."""
    o = options
    normal = {r for r in roots if r not in (o.discovery, o.tidy, lexicon.UNSORTED)}
    named = [(str(g.get("name") or "未命名分组"), list(dict.fromkeys(g.get("roots") or []))) for g in groups or []]
    only_wrapper = o.mode == "auto" and len(named) == 1 and named[0][0] == o.main and set(named[0][1]) == normal
    specs = named if named and not only_wrapper else auto_groups({r: f.count for r, f in roots.items()}, o)
    specs = [(name, list(rs)) for name, rs in specs]
    given = {r for _, rs in specs for r in rs}
    rest = [r for r in roots if r not in given and r != o.discovery]
    if rest:
        found = next((rs for name, rs in specs if name == o.fallback), None)
        if found is None:
            specs.append((o.fallback, rest))
        else:
            found += [r for r in rest if r not in found]
    if o.discovery in roots and o.discovery not in given:
        specs.append((o.discovery, [o.discovery]))
    out: dict[str, Folder] = {}
    for order, (name, rs) in enumerate(specs):
        there = [r for r in rs if r in roots]
        if not there:
            continue
        if o.collapse and len(there) == 1:
            node = roots[there[0]]
            node = Folder(name, list(node.children), list(node.sources), node.direct, order, node.kind, node.preserve)
        else:
            base = roots[o.tidy] if name == o.tidy and o.tidy in there else Folder(name)
            node = Folder(name, list(base.children), list(base.sources), base.direct, order, preserve=True)
            for n, r in enumerate(there):
                if roots[r] is not base:
                    f = roots[r]
                    node.children.append(Folder(r, list(f.children), list(f.sources), f.direct, n, f.kind, f.preserve))
        made = limit_depth(optimize(node, o.small, is_root=True), o.max_depth)
        made.order = order
        out[name] = made
    return list(out.values())


def tree(spark: SparkSession, sources: DataFrame, groups: list[dict] | None = None, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(folders, shown): the display tree's folders in order, and (id, node) of every record.

    Folders have node (place in reading order), parent, depth, name, path, direct, records, is_leaf, and before and after, the places of
    its own records and its end.  One row for each source folder reaches the driver.
    """
    rows = [tuple(r) for r in sources.groupBy("root", "folder", "sub").agg(F.count(F.lit(1)).alias("n")).collect()]
    top_level = sorted(assemble(roots_of(rows, options), groups, options), key=Folder.sort_key)
    top_level = [f for f in top_level if f.name != lexicon.UNSORTED] + [f for f in top_level if f.name == lexicon.UNSORTED]
    folders, moves, clock = [], [], 0

    def visit(node: Folder, parent: int | None, path: tuple) -> None:
        nonlocal clock
        me, path = clock, (*path, node.name)
        clock += 1
        for child in sorted(node.children, key=Folder.sort_key):
            visit(child, me, path)
        folders.append((me, parent, len(path), node.name, list(path), node.direct, node.count, not node.children, clock, clock + 1))
        moves.extend((*key, me) for key in node.sources)
        clock += 2

    for node in top_level:
        visit(node, None, ())
    folders.sort()
    shape = "node long, parent long, depth int, name string, path array<string>, direct long, records long, is_leaf boolean, before long, after long"
    moved = spark.createDataFrame(moves, "root string, folder string, sub string, node long")
    return spark.createDataFrame(folders, shape), sources.join(moved, ["root", "folder", "sub"]).select("id", "node")


def displayed(shown: DataFrame, features: DataFrame) -> DataFrame:
    """(identity) of every shown record: its id, else its link."""
    rows = shown.join(features.select("id", "record", "url"), "id")
    return rows.select(F.coalesce(F.nullif("record", F.lit("")), "url").alias("identity"))


def review_folders(rows: DataFrame) -> DataFrame:
    """(root, folder, records, ids): links that the user can mend, under what is wrong with them, by name."""
    label = F.when(F.coalesce("user_action_label", F.lit("")) == "", lexicon.ACTION_FALLBACK).otherwise(F.col("user_action_label"))
    found = rows.where("user_action_required").groupBy(label.alias("folder")).agg(F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"))
    return found.select(F.lit(lexicon.REVIEW_ROOT).alias("root"), "folder", "records", "first_id").orderBy("folder")


def compact(rows: DataFrame) -> DataFrame:
    """What is written of a record beside its folder: name, link and a summary of its classification."""
    return rows.select("id", "name", "url", "add_date", "icon", "domain", "fetch_key", F.struct("category", "resource_type", "review_required", F.col("reason_label").alias("review_category")).alias("classification"))


def document(folders: DataFrame, shown: DataFrame, records: DataFrame, *, now: int, doctype: str = "<!DOCTYPE html>", title: str = "Links", toolbar: str = "Links", other: str = "Other") -> DataFrame:
    """(at, ord, line) of an HTML export in reading order: header, toolbar folder, folders with their folders first and then their records, an empty folder for others.

    Names of the frame come from the caller, as formats differ.  Every line carries its place, so a sorted write gives the file and no task
    holds a whole folder.  Records without a date get ``now``.
    """
    c = F.col
    esc, lit = text.escape_html, F.lit
    indent = F.repeat(lit("    "), (c("depth") + 1).cast("int"))
    head = F.concat(indent, lit(f'<DT><H3 ADD_DATE="{now}">'), esc(c("name")), lit("</H3>\n"), indent, lit("<DL><p>"))
    opened = folders.select(c("node").alias("at"), lit(-1).cast("long").alias("ord"), head.alias("line"))
    closed = folders.select(c("after").alias("at"), lit(-1).cast("long").alias("ord"), F.concat(indent, lit("</DL><p>")).alias("line"))
    icon = F.when(F.coalesce("icon", lit("")) != "", F.concat(lit(' ICON="'), esc(c("icon")), lit('"'))).otherwise("")
    date = F.when(F.coalesce("add_date", lit("")) == "", lit(str(now))).otherwise(c("add_date"))
    item = F.concat(indent, lit('    <DT><A HREF="'), esc(F.coalesce("url", lit(""))), lit('" ADD_DATE="'), date, lit('"'), icon, lit(">"), esc(F.coalesce("name", lit("未命名"))), lit("</A>"))
    rows = shown.join(folders.select("node", "before", "depth"), "node").join(records.select("id", "name", "url", "add_date", "icon"), "id")
    items = rows.select(c("before").alias("at"), c("id").cast("long").alias("ord"), item.alias("line"))
    spark = folders.sparkSession
    frame = [
        f"{doctype}\n<!-- This is an automatically generated file. DO NOT EDIT! -->\n<META HTTP-EQUIV=\"Content-Type\" CONTENT=\"text/html; charset=UTF-8\">\n<TITLE>{title}</TITLE>\n<H1>{title}</H1>\n<DL><p>",
        f'    <DT><H3 PERSONAL_TOOLBAR_FOLDER="true">{toolbar}</H3>\n    <DL><p>', f"    </DL><p>\n    <DT><H3>{other}</H3>\n    <DL><p>\n    </DL><p>\n</DL><p>",
    ]
    edge = spark.createDataFrame([(-2, -1, frame[0]), (-1, -1, frame[1]), (1 << 62, -1, frame[2])], "at long, ord long, line string")
    return edge.unionByName(opened).unionByName(items).unionByName(closed)
