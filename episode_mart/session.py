"""Recommended session settings. All may be set on a running session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Join strategies, partition sizes and skewed partitions are decided at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The cleaned transactions are one wide projection of decimals. As a single generated
    # method it exceeds what the JVM compiles (8000 bytes) and would be interpreted; with this
    # limit Spark generates it as many small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
