"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster there
    is nowhere to write, which is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="canlake-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()
