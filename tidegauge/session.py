"""Session defaults for applications and tests; library code never builds a session itself."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidegauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries assume: UTC, adaptive plans, Arrow transfer.

    Every other setting (memory, shuffle partitions, checkpoint folder) belongs to the cluster and is passed in ``conf``
    with underscores for dots, or by spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {key.replace("_", "."): value for key, value in conf.items()}
    return builder.config(map=settings).getOrCreate()
