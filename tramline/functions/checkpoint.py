"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder. Where the session names none, a temporary one, on a local master alone: other executors would not see it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tramline-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, and its lineage cut there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
