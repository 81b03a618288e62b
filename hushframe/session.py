"""The folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the one the session names.

    Only a local session without the setting gets a folder of its own.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that every machine can reach")
        root = tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
