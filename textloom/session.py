"""A session with the settings that the operators assume: UTC and adaptive execution; sizes are left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "textloom", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()
