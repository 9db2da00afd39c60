"""The shared folder, and cutting lineage in loops by reliable checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; in local mode one of our own where unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.getCheckpointDir() and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skarn-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
