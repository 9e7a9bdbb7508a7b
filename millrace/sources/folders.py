"""A folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, a local session gets a temporary one and a cluster an error."""
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    spark.sparkContext.setCheckpointDir(top)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder."""
    return f"{ensure(spark).rstrip('/')}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and what is drawn at random stays."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
