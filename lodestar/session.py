"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "lodestar", **conf: str) -> SparkSession:
    """The active session, or a new one with the library's defaults and ``conf``.

    Keys of ``conf`` use underscores for dots.  Partition counts are left to the
    cluster's own settings and to adaptive execution.
    """
    builder = SparkSession.builder.appName(name)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
