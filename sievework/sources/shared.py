"""A folder of its own for what an operator writes on its way, where the driver and all executors see it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only a local master may go without the setting, and gets a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="sievework-")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
