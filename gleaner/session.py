"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution on.  ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()
