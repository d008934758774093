"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, leaf: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{(base or 'file://' + tempfile.mkdtemp()).rstrip('/')}/{leaf}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: what it holds is made once, and a lost executor costs no second making."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder(spark, "checkpoints"))
    return df.checkpoint()
