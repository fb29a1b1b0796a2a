"""A session with the settings the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "annalist", **settings: str) -> SparkSession:
    """Session time zone UTC, AQE on, the last of repeated JSON keys taken; everything else is the cluster's. Underscores in names stand for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.variant.allowDuplicateKeys", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
