"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The path in spark.checkpoint.dir; where a local session names none (tests), a temporary folder.

    On a cluster executors would each write to their own disk, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="weftline-")


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there, and their size lets Spark broadcast few of them."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
