"""Spark session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the run-time work: it merges small shuffle
# partitions, splits skewed join partitions and turns a shuffled join into a
# broadcast one once a side is measured to be small.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # no Python call-site capture per column expression; it costs more than the plans themselves
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "fenland", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; `conf` entries win over them.

    Keyword names use `_` for `.`: `build_session(spark_ui_enabled="false")`.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    named = {key.replace("_", "."): value for key, value in conf.items()}
    for key, value in {**SETTINGS, **named}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
