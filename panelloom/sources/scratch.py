"""New folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir; where none is set, a temporary one on a local master, whose executors are the driver, and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
