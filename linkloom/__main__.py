"""Run a registered query or a stage: python -m linkloom query NAME IN OUT, python -m linkloom parse --config FILE, ..."""

from __future__ import annotations

import argparse
import os
import sys


def _parser() -> argparse.ArgumentParser:
    from linkloom import catalogue

    parser = argparse.ArgumentParser(prog="linkloom", description="Clean, understand and reorganise a collection of links.")
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="run a registered query over a folder of Parquet tables")
    query.add_argument("query", choices=sorted(catalogue.queries()))
    query.add_argument("input")
    query.add_argument("output")
    query.add_argument("--format", default="parquet", choices=("parquet", "json", "orc"))
    query.add_argument("--explain", action="store_true", help="print the physical plan instead of running")
    stages = {
        "parse": "read the link export", "fetch": "take in fetch results (Parquet tables)", "classify": "score and classify", "cluster": "cluster, route, display, report", "export": "write the tree as HTML",
        "bootstrap": "summarise clusters for an external taxonomy", "followup": "bundle what no rule settles", "apply": "import an external taxonomy response", "reset": "delete what a run wrote",
    }
    made = {}
    for name, text in stages.items():
        made[name] = commands.add_parser(name, help=text)
        made[name].add_argument("--config", default=None)
        made[name].add_argument("--log-level", default=None)
    made["fetch"].add_argument("--pages", required=True, help="pages: page_id, url, html, status_code, fetch_status, error")
    for name, default in (("bootstrap", 120), ("followup", 40)):
        made[name].add_argument("--limit", type=int, default=default)
    made["apply"].add_argument("--response", required=True)
    made["apply"].add_argument("--merge-existing", action="store_true")
    made["apply"].add_argument("--bundles", default="bootstrap", choices=("bootstrap", "followup"))
    made["reset"].add_argument("--clear-cache", action="store_true")
    return parser


def _page_tables(spark, path: str):
    """(results, homes) out of a table of pages."""
    from pyspark.sql import functions as F

    from linkloom.functions import urls
    from linkloom.sources import html

    pages = spark.read.parquet(path)
    said = html.page_signals(pages)
    page = F.struct(*[F.col(c) for c in (*html.TEXTS, *html.LISTS)]).alias("page")
    rows = pages.select("page_id", F.col("url").alias("resolved_url"), "status_code", "fetch_status", "error").join(said.select("page_id", page), "page_id").withColumn("fetch_key", urls.normalize(F.col("resolved_url")))
    homes = rows.where(F.col("fetch_key") == urls.homepage(F.col("resolved_url"))).select(F.col("fetch_key").alias("homepage_url"), "fetch_status", "status_code", "page")
    return rows.dropDuplicates(["fetch_key"]), homes.dropDuplicates(["homepage_url"])


def main(args: list[str] | None = None) -> int:
    from linkloom import catalogue, config as configuration, stages
    from linkloom.session import session

    given = _parser().parse_args(args)
    if given.command == "query":
        rows = catalogue.queries()[given.query](session(os.environ.get("SPARK_MASTER", "local[*]")), given.input)
        if given.explain:
            rows.explain("formatted")
        else:
            rows.write.mode("overwrite").format(given.format).save(given.output)
        return 0
    config = configuration.Config.load(given.config)
    if given.log_level:
        config.raw["logging"]["level"] = given.log_level
    if given.command == "reset":
        print("\n".join(configuration.reset(config, given.clear_cache)))
        return 0
    log = config.logger()
    spark = session(os.environ.get("SPARK_MASTER", "local[*]"))
    if given.command == "fetch":
        stages.fetched(spark, config, *_page_tables(spark, given.pages))
    elif given.command in ("bootstrap", "followup"):
        getattr(stages, given.command)(spark, config, given.limit)
    elif given.command == "apply":
        stages.apply(spark, config, given.response, merge_existing=given.merge_existing, bundles=given.bundles)
    else:
        getattr(stages, given.command)(spark, config)
    log.info("%s done", given.command)
    return 0


if __name__ == "__main__":
    sys.exit(main())
