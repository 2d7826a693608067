"""The folder that all executors share, and tables cut off from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only where it is unset and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="promptmix-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, so it is not computed again and lost executors do not undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
