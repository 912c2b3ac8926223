"""The registered queries, their SQL, and the flagship."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("links", "classify", "structure", "reports")


def _modules():
    return [import_module(f"linkloom.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links deduplicated and counted by domain."""
    return queries()["domain_stats_top20"](spark, sf_dir)
