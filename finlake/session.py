"""Session builder: UTC, ANSI casts, adaptive execution, stream state on disk."""

from __future__ import annotations

from pyspark.sql import SparkSession

from finlake.streaming.state import SETTINGS


def build(name: str = "finlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC. Sizes are left to adaptive execution unless conf gives them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        **SETTINGS,
    }
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
