"""Where intermediate datasets go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for one run, under the shared folder that the cluster names in
    ``spark.checkpoint.dir``. Only a local session without the setting uses a temporary folder."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
