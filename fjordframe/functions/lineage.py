"""Cutting lineage between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine has none (tests), a temporary folder; on a cluster the setting is needed, as executors
    would not see each other's files.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fjordframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
