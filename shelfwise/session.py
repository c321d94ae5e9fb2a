"""The Spark session the library expects: UTC, ANSI casts, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "shelfwise", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
