"""Passing files, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; without that setting, and only on a local master, under the machine's temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wirelake-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
