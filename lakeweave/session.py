"""The session that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "lakeweave", **settings: str) -> SparkSession:
    """A session with the library's settings; keyword arguments add others, dots written as double underscores."""
    own = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=own).getOrCreate()
