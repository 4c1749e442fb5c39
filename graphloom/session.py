"""A Spark session with the settings that the iterative operators like."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session. Settings of a running session are left alone; master is only set when given,
    so that a cluster's own configuration holds. Extra settings use ``__`` for the dots of a key."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
