"""Where tables go that a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder of the session's ``spark.checkpoint.dir``.

    Only a local session that names none falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="nearwave-")
    return f"{base.rstrip('/')}/nearwave-{label}-{uuid.uuid4().hex}"
