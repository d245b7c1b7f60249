"""Folders for what jobs write and read again: in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one on this machine only where the session names none and runs here alone (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not known and jsc.getCheckpointDir().isDefined():
        known = jsc.getCheckpointDir().get()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
