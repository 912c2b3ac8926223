"""Links: first-wins deduplication, duplicates, statistics, cache merge reports, homepage fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from .skew import written


def first_wins(links: DataFrame, key: str = "key", ord_col: str = "ord") -> DataFrame:
    """The first row (by ``ord``) of each key, with the size of its group.

    A min over a struct is combined before the shuffle, so a hot key costs one row for each task.
    """
    rest = [c for c in links.columns if c not in (key, ord_col)]
    first = links.groupBy(key).agg(F.min(F.struct(ord_col, *rest)).alias("__r"), F.count(F.lit(1)).alias("copies"))
    return first.select(key, "__r.*", "copies")


def duplicates(links: DataFrame, key: str = "key", ord_col: str = "ord", limit: int = 100) -> DataFrame:
    """All but the first row of each key, in input order, at most ``limit`` (a report).

    Rows are held against the smallest ``ord`` of any key, which are combined before the shuffle; a hot key's rows lie apart.
    """
    first = links.groupBy(key).agg(F.min(ord_col).alias(ord_col)).select(ord_col)
    return links.join(first, ord_col, "left_anti").orderBy(ord_col).limit(limit)


def numbered(links: DataFrame, prefix: str, ord_col: str = "ord") -> DataFrame:
    """Links with ``id``, the prefix and their dense number from 0 by ``ord``.

    Rows are sorted and written once; only each partition's number of rows reaches the driver, so no task numbers all rows.
    """
    number, part = "__n", "__p"
    rows = written(links.orderBy(ord_col).withColumns({number: F.monotonically_increasing_id()})).withColumn(part, F.shiftright(number, 33))
    counts = {r[part]: r["n"] for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, so_far = [], 0
    for p in sorted(counts):
        before.append((p, so_far))
        so_far += counts[p]
    starts = links.sparkSession.createDataFrame(before, f"{part} long, __b long")
    place = F.col("__b") + F.col(number).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), part).withColumn("id", F.concat(F.lit(prefix), place.cast("string"))).drop(number, part, "__b")


def parse_stats(links: DataFrame, duplicate_count: int | None = None) -> DataFrame:
    """One row about kept links (domain, folder_path, copies, ord): links, duplicates, distinct domains, distinct folders as the walk up from a link meets them."""
    c = F.col
    rows = links.withColumn("suffixes", F.transform(F.sequence(F.lit(1), F.greatest(F.size("folder_path"), F.lit(1))), lambda n: F.array_join(F.slice("folder_path", n, F.size("folder_path")), "/")))
    folders = rows.select(F.explode(F.when(F.size("folder_path") > 0, c("suffixes"))).alias("f")).agg(F.count_distinct("f").alias("total_folders"))
    one = rows.agg(F.count(F.lit(1)).alias("total"), (F.sum("copies") - F.count(F.lit(1))).alias("duplicates"), F.count_distinct(F.nullif("domain", F.lit(""))).alias("unique_domains"))
    return one.crossJoin(folders)  # one row each


def top_folders(links: DataFrame, limit: int = 20) -> DataFrame:
    """Whole folder paths by falling count, ties by first appearance; links without a folder don't count."""
    rows = links.withColumn("folder", F.array_join("folder_path", "/")).where("folder <> ''")
    return top_domains(rows, "folder", limit=limit)


def top_domains(links: DataFrame, domain: str, ord_col: str = "ord", limit: int = 20) -> DataFrame:
    """Domains by falling count, ties by first appearance."""
    counts = links.groupBy(domain).agg(F.count(F.lit(1)).alias("links"), F.min(ord_col).alias("first_ord"))
    return counts.orderBy(F.col("links").desc(), "first_ord").limit(limit)


def hotspots(first: DataFrame, final: DataFrame, key: str = "domain") -> DataFrame:
    """Rows of either pass by key with counts of both, missing ones 0; most reviews of the final pass first, then most rows, then by key."""
    a = first.groupBy(key).agg(F.count(F.lit(1)).alias("primary_total"), F.count_if("review_required").alias("primary_review"))
    b = final.groupBy(key).agg(F.count(F.lit(1)).alias("final_total"), F.count_if("review_required").alias("final_review"))
    both = a.join(b, key, "full_outer").na.fill(0, ["primary_total", "primary_review", "final_total", "final_review"])
    return both.withColumn("review_delta", F.col("final_review") - F.col("primary_review")).orderBy(F.col("final_review").desc(), F.col("final_total").desc(), key)


def homepage_fallback(pages: DataFrame, homepages: DataFrame) -> DataFrame:
    """Each page with the title of its site's homepage where that was fetched."""
    home = homepages.select(F.col("url").alias("home_url"), F.col("title").alias("home_title"))
    return pages.withColumn("homepage_url", urls.homepage(F.col("url"))).join(home, F.col("homepage_url") == F.col("home_url"), "left").drop("home_url")
