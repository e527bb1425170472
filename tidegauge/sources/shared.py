"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset (one machine, tests), in a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
