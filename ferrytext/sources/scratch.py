"""Places for tables that a job makes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share, which ``spark.checkpoint.dir`` names; on a local master,
    where it may be unset, in a new folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
