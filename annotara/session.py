"""Session settings that the package's operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "annotara", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf overrides (dots as double underscores)."""
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
