"""The Spark session that the command line and the tests use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """UTC, adaptive execution, shuffle partitions by the cores; ``conf`` overrides (dots as double underscores)."""
    builder = (
        SparkSession.builder.master(master).appName("linkloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
