"""Tables written once in a run and read by several later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; on one machine without it a temporary one.

    A cluster's executors do not see the driver's temporary folder, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="fenland-")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later readers prune its columns and never repeat the work."""
    path = f"{shared_folder(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
