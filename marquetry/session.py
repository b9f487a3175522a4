"""Session settings the operators assume; a caller's own session works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create a session. On a cluster leave ``master`` and ``shuffle_partitions`` to spark-submit."""
    builder = SparkSession.builder.appName("marquetry")
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS, **(extra or {}))
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
