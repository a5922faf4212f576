"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder of spark.checkpoint.dir. Where none is named, a temporary one in local mode and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        top = _LOCAL[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
