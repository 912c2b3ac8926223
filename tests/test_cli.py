"""The command line: a query's rows, and all stages in turn with a taxonomy round."""

import json

import pytest
from pyspark.sql import functions as F

from linkloom import config, stages
from linkloom.__main__ import main

from .test_functions import EXPORT


def test_runs_a_query(spark, sf, tmp_path):
    assert main(["query", "tree_rollup", sf, f"{tmp_path}/out", "--format", "json"]) == 0
    assert spark.read.json(f"{tmp_path}/out").count() > 0


def test_explains(sf, tmp_path, capsys):
    assert main(["query", "domain_stats_top20", sf, f"{tmp_path}/none", "--explain"]) == 0
    assert "Scan parquet" in capsys.readouterr().out


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    (folder / "links.html").write_text(EXPORT, encoding="utf-8")
    (folder / "config.json").write_text(json.dumps({"ignored_folders": ["Bar"], "logging": {"console": False}, "clustering": {"min_cluster_size": 2}}), encoding="utf-8")
    rows = [(n, u, f"<html><title>Widget making {n}</title><main>{'widgets and gears ' * 12}</main></html>", 200, None, "") for n, u in enumerate(("https://a.example.org/x", "https://a.example.org/y"))]
    rows.append((9, "https://b.example.org/", "", 404, None, ""))
    spark.createDataFrame(rows, "page_id long, url string, html string, status_code int, fetch_status string, error string").write.parquet(f"{folder}/pages")
    given = ["--config", f"{folder}/config.json"]
    for command in (["parse"], ["fetch", "--pages", f"{folder}/pages"], ["classify"], ["cluster"], ["export"], ["bootstrap"]):
        assert main([command[0], *given, *command[1:]]) == 0
    return folder, given


def test_stages_in_turn(spark, run):
    folder, given = run
    out = folder / "output"
    shown = (out / "export.html").read_text(encoding="utf-8")
    assert shown.count("<A HREF=") == 3 and "Widget" not in shown.split("<TITLE>")[1].split("</TITLE>")[0]
    assert spark.read.json(f"{out}/reports/broken_links").select("url", "reason_code").collect() == [("https://b.example.org/", "not_found")]
    q = spark.read.json(f"{out}/reports/quality").first()
    assert (q["total"], q["display_missing"], q["display_repeated"], q["guardrails"]) == (3, 0, 0, "pass")
    with pytest.raises(ValueError):
        stages.load(spark, f"{out}/links", "links/v0", "test")


def test_taxonomy_round(spark, run):
    folder, given = run
    rows = spark.read.parquet(f"{folder}/output/reports/bootstrap/rows").orderBy(F.col("size").desc()).collect()
    assert "Taxonomy" in (folder / "output/reports/bootstrap.md").read_text(encoding="utf-8")
    answer = {"schema_version": "user_taxonomy_response/v1", "categories": [{"path": "craft/Widgets", "aliases": ["widget"]}], "cluster_assignments": [{"cluster_id": rows[0]["cluster_id"], "category": "craft/Widgets", "confidence": "high"}]}
    (folder / "answer.txt").write_text(f"```json\n{json.dumps(answer)}\n```", encoding="utf-8")
    assert main(["apply", *given, "--response", f"{folder}/answer.txt", "--merge-existing"]) == 0
    assert main(["classify", *given]) == 0
    got = {r["url"]: (r["category"], r["assigned"]) for r in spark.read.parquet(f"{folder}/output/classified/rows").collect()}
    assert all(got[i] == ("craft/Widgets", True) for i in rows[0]["identities"]) and config.Config.load(f"{folder}/config.json").root_groups == [{"name": "主要主题", "roots": ["craft"]}]


def test_reset_keeps_the_source(run):
    folder, given = run
    assert main(["reset", *given]) == 0
    left = {p.name for p in (folder / "output").iterdir()}
    assert (folder / "links.html").exists() and (folder / "taxonomy.json").exists() and "fetched" in left and not {"links", "classified", "clustered", "reports"} & left
    assert main(["reset", *given, "--clear-cache"]) == 0 and not (folder / "output" / "fetched").exists()


def test_missing_input(tmp_path):
    with pytest.raises(FileNotFoundError):
        config.require_input(config.Config.load(f"{tmp_path}/none.json"))
