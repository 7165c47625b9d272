"""Where tables between steps go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset a local master gets one of its own; a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="streetloom-")
    return base.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark)}/{tag}-{uuid.uuid4().hex}"
