"""The stages of a run: links, fetch results, classification, clusters and display, export, and the taxonomy rounds between them.

A stage reads the datasets of the one before and writes its own as Parquet; a dataset carries its version, and one of another
version is refused.
"""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import config as configuration
from .operators import clusters, display, features, fetch, health, links, reports, rules, signals, skew, taxonomy
from .sources import html

LINKS, FETCHED, CLASSIFIED, CLUSTERED = "links/v1", "fetch_output/v2", "classified_output/v2", "clustering_output/v2"
TAXONOMY, ASSIGNMENTS = "user_taxonomy/v1", "bookmark_taxonomy_assignments/v1"


def save(df: DataFrame, path: str, version: str) -> None:
    """Rows as Parquet; the version, a folder beside them, is written last."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(version,)], "version string").write.mode("overwrite").parquet(f"{path}/version")


def load(spark: SparkSession, path: str, version: str, stage: str) -> DataFrame:
    """Rows of a dataset, if it is of the expected version."""
    there = spark.read.schema("version string").parquet(f"{path}/version").first()
    if there is None or there["version"] != version:
        raise ValueError(f"{stage}: {path} is {there['version'] if there else 'missing'!r}, not {version!r}; run the stage before it again")
    return spark.read.parquet(f"{path}/rows")


def parse(spark: SparkSession, config: configuration.Config) -> DataFrame:
    """Links of the export, the first of each."""
    configuration.require_input(config)
    files = spark.read.text(str(config.path("input")), wholetext=True).select(F.lit(0).cast("long").alias("file_id"), F.col("value").alias("text"))
    save(html.links_of(html.parse_exports(files, tuple(config.raw["ignored_folders"]))), config.out("links"), LINKS)
    rows = load(spark, config.out("links"), LINKS, "parse")
    links.parse_stats(rows).write.mode("overwrite").json(config.out("reports/links"))
    return rows


def fetched(spark: SparkSession, config: configuration.Config, results: DataFrame, homes: DataFrame, **more) -> DataFrame:
    """Links with what a fetch of them gave, under the review policy; links with a good cached result keep it, pending ones are replaced."""
    rows = load(spark, config.out("links"), LINKS, "fetch").drop("copies")
    given = config.raw["fetch"]
    out = fetch.records(rows, results, homes, warmup=given["warmup"], homepage_on_failure=given["homepage_on_failure"], **more)
    out = health.apply_trust(out, health.trust_rules(given["review_policy"].get("trusted_access")), "domain")
    save(out, config.out("fetched"), FETCHED)
    out = load(spark, config.out("fetched"), FETCHED, "fetch")
    for name, report in (("broken_links", fetch.broken_links(out)), ("review_queue", fetch.review_queue(out)), ("fetch_stats", fetch.stats(out))):
        report.coalesce(1).write.mode("overwrite").json(config.out(f"reports/{name}"))
    return out


def classify(spark: SparkSession, config: configuration.Config) -> DataFrame:
    rows = signals.signals(load(spark, config.out("fetched"), FETCHED, "classify"))
    given = None
    if Path(config.path("assignments")).exists():
        given = load(spark, str(config.path("assignments")), ASSIGNMENTS, "classify")
    save(rules.classify(rows, config.rules, config.options, given), config.out("classified"), CLASSIFIED)
    out = load(spark, config.out("classified"), CLASSIFIED, "classify")
    for name, report in (("confirmation", rules.confirmation_report(out, config.options)), ("classification", rules.counters(out, config.options)), ("uncovered_topics", rules.uncovered_topics(out))):
        report.coalesce(1).write.mode("overwrite").json(config.out(f"reports/{name}"))
    return out


def feature_rows(classified: DataFrame) -> DataFrame:
    """Feature sets with the numeric id that clustering needs; the record's own id is ``record``."""
    return features.feature_sets(classified).withColumns({"record": F.col("id"), "id": F.col("ord")})


def cluster_tables(classified: DataFrame, options: clusters.Options = clusters.Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, members, profiles) of classified records."""
    f = skew.written(feature_rows(classified))
    members = clusters.clusters(f, options)
    return f, members, skew.written(clusters.profiles(members, f, options))


def cluster(spark: SparkSession, config: configuration.Config) -> None:
    """Clusters, their profiles, the display tree, and the reports on all of it."""
    classified = load(spark, config.out("classified"), CLASSIFIED, "cluster")
    options, shape = config.cluster_options(), config.display_options()
    f, members, profiles = cluster_tables(classified, options)
    sources = skew.written(display.source_folders(profiles, members, f, shape))
    folders, shown = display.tree(spark, sources, config.root_groups, shape)
    folders, shown, suggested = skew.written(folders), skew.written(shown), clusters.suggestions(profiles, options)
    save(display.compact(f.withColumn("id", F.col("record"))), config.out("clustered/records"), CLUSTERED)
    for name, table in (("members", members), ("profiles", profiles), ("folders", folders), ("shown", shown), ("links", f.select("id", "record", "name", "url", "add_date", "icon"))):
        save(table, config.out(f"clustered/{name}"), CLUSTERED)
    tables = {
        "rule_suggestions": suggested, "quality": reports.quality_report(f, profiles, suggested, sources, folders, shown, options), "label_issues": reports.label_issues(profiles, options).limit(20),
        "outcome": reports.outcome(f, profiles), "review_hotspots": reports.review_hotspots(f), "signal_fields": reports.signal_audit(classified, f), "signal_families": reports.signal_audit(classified, f, "family"),
        "signal_hotspots": reports.audit_hotspots(f), "flat_roots": reports.flat_roots(sources, options).limit(10), **reports.sections(profiles, options),
    }
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(config.out(f"reports/{name}"))


def export(spark: SparkSession, config: configuration.Config, *, now: int | None = None, **frame: str) -> str:
    """The display tree as one HTML file, written by the driver line by line."""
    folders, shown, rows = (load(spark, config.out(f"clustered/{n}"), CLUSTERED, "export") for n in ("folders", "shown", "links"))
    lines = display.document(folders, shown, rows, now=int(time.time()) if now is None else now, **frame).orderBy("at", "ord").select("line")
    with open(config.out("export.html"), "w", encoding="utf-8") as f:
        for row in lines.toLocalIterator():
            f.write(row["line"] + "\n")
    return config.out("export.html")


def bootstrap(spark: SparkSession, config: configuration.Config, limit: int = 120) -> DataFrame:
    """Clusters as an external taxonomy is asked about them, with the prompt; routed with a discovery of two records."""
    classified = load(spark, config.out("classified"), CLASSIFIED, "bootstrap")
    f, members, profiles = cluster_tables(classified, config.cluster_options(discovery_min=2))
    rows = skew.written(reports.bootstrap(profiles, members, f))
    save(rows, config.out("reports/bootstrap"), reports.BOOTSTRAP_VERSION)
    Path(config.out("reports/bootstrap.md")).write_text(reports.bootstrap_prompt(rows.orderBy(F.col("size").desc(), "cluster_id"), limit), encoding="utf-8")
    return rows


def followup(spark: SparkSession, config: configuration.Config, limit: int = 40) -> DataFrame:
    """Bundles of what no rule settles, with the prompt for a second round."""
    classified = load(spark, config.out("classified"), CLASSIFIED, "followup")
    options = config.cluster_options(discovery_min=2)
    f, members, profiles = cluster_tables(classified, options)
    rows = skew.written(reports.followup(profiles, members, f, options))
    save(rows, config.out("reports/followup"), reports.FOLLOWUP_VERSION)
    Path(config.out("reports/followup.md")).write_text(reports.followup_prompt(rows.orderBy(F.col("support").desc(), "bundle_type", "bundle_id"), limit), encoding="utf-8")
    return rows


def apply(spark: SparkSession, config: configuration.Config, response: str, *, merge_existing: bool = False, bundles: str = "bootstrap") -> list[rules.Rule]:
    """Import an external response: the taxonomy file and the assignments, over the existing ones if asked to."""
    payload = taxonomy.parse(Path(response).read_text(encoding="utf-8"))
    file = config.path("taxonomy")
    before = json.loads(file.read_text(encoding="utf-8")) if merge_existing and file.exists() else {}
    if before and before.get("schema_version") != TAXONOMY:
        raise taxonomy.InvalidTaxonomy(f"{file} is {before.get('schema_version')!r}, not {TAXONOMY}")
    old, _ = rules.bundle(before)
    new = taxonomy.merge_rules(old, taxonomy.categories(payload, spark))
    paths = [r.category for r in new]
    groups = taxonomy.merge_groups(payload, before.get("root_groups") or [], paths)
    version = reports.BOOTSTRAP_VERSION if bundles == "bootstrap" else reports.FOLLOWUP_VERSION
    given = None
    if payload.get("cluster_assignments"):
        rows = load(spark, config.out(f"reports/{bundles}"), version, "apply")
        key = "cluster_id" if bundles == "bootstrap" else "bundle_id"
        given = taxonomy.assignments(spark, payload, rows.select(F.col(key).alias("cluster_id"), F.explode("identities").alias("identity")), paths)
    target = str(config.path("assignments"))
    shape = "identity string, category string, confidence double, confidence_label string, source_cluster_id string"
    given = given if given is not None else spark.createDataFrame([], shape)
    if merge_existing and Path(target).exists():
        known = load(spark, target, ASSIGNMENTS, "apply")
        value = lambda n: F.struct("confidence", F.lit(n).alias("n"), "category", "confidence_label", "source_cluster_id").alias("v")
        both = known.select("identity", value(0)).unionByName(given.select("identity", value(1)))
        given = both.groupBy("identity").agg(F.max("v").alias("v")).select("identity", "v.category", "v.confidence", "v.confidence_label", "v.source_cluster_id")
    save(skew.written(given), target, ASSIGNMENTS)
    file.write_text(json.dumps(configuration.taxonomy_document(new, groups), ensure_ascii=False, indent=2), encoding="utf-8")
    return new
