"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the shared checkpoint folder that the session names.  Only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints", "chronosweep"))


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and go on from there: lost executors don't undo it."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as a shuffle has, for work in Python: it is small in bytes, by which Spark would merge tasks, but long in time."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
