"""A session for programs that have none; sessions that callers bring are used as they are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_or_create(name: str = "docloom", **conf: str) -> SparkSession:
    """The active session, or a new one in UTC with adaptive execution."""
    if found := SparkSession.getActiveSession():
        return found
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
