"""The folder that the driver and all executors share, for reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, set as the context's too; an own one only on one machine, as in tests."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not place and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="gridforge-"))
    return (place or context.getCheckpointDir()).rstrip("/")
