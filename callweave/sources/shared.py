"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a local session, as in tests, has a default."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or '/tmp/callweave-shared').rstrip('/')}/callweave/{label}-{uuid.uuid4().hex}"
