"""Session defaults: adaptive plans, UTC, and settings that suit a cluster as well as a laptop."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution picks the number of reduce tasks and splits skewed joins; Bloom joins prune large scans.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "skarn", master: str | None = None, **more: str) -> SparkSession:
    """A session with the defaults; ``more`` overrides them (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
