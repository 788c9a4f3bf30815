"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "furrow", shuffle_partitions: int = 8, **config: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split, Arrow for the few Python operators."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | config
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
