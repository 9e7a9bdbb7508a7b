"""Folders that the driver and all executors share, and sums of arrays over all tasks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with so large a part of all rows is frequent; there can be no more such keys.
HOT = 1000


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder as a URI. Where it names none, a local session gets a temporary one and a cluster an error."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    asked = spark.conf.get("spark.checkpoint.dir", None)
    if not asked:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        asked = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    sc.setCheckpointDir(asked)
    return sc._jsc.sc().getCheckpointDir().get()


def plain_uri(path: str) -> str:
    """file:/a is written file:///a, which other libraries expect."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def fresh(spark: SparkSession, name: str) -> str:
    """A folder of its own inside the shared one."""
    return f"{plain_uri(folder(spark)).rstrip('/')}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def regrouped(rows: DataFrame, keys: list[str], aggregate: Column, name: str, own: list[str], total: int) -> DataFrame:
    """Rows whose keys occur again, with an aggregate of the rows of these keys.

    The first key is a long, ``own`` tells rows apart, ``total`` is the number of
    rows or more. A key with at least a ``HOT``-th of so many rows comes by
    broadcast of at most ``HOT`` such keys, and its rows are dealt by ``own``.
    """
    groups = rows.groupBy(*keys).agg(aggregate.alias(name), F.count("*").alias("__n")).where("__n > 1")
    hot = F.col("__n") >= max(2, -(-total // HOT))
    few = groups.where(hot).select(*keys, F.col(name).alias("__hot"))
    many = groups.where(~hot).select(*keys, name).withColumnRenamed(keys[0], "__key")
    dealt = rows.join(F.broadcast(few), keys, "left").withColumn("__key", F.when(F.col("__hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*own)))
    both = dealt.join(many, ["__key", *keys[1:]], "left")
    out = F.when(F.col("__hot").isNull(), F.col(name)).otherwise(F.col("__hot"))
    return both.select(*rows.columns, out.alias(name)).where(F.col(name).isNotNull())


def summed(parts: DataFrame, dtype: str, combine: np.ufunc = np.add) -> DataFrame:
    """Sum (or another ufunc) of arrays in blocks: rows of block (int) and data (binary of ``dtype``), one row per block.

    Blocks are added as they arrive, so a task holds one array for each of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                own = np.frombuffer(data.as_buffer(), dtype)
                total[block] = combine(total[block], own) if block in total else own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "data"])

    return parts.select("block", "data").repartition("block").mapInArrow(run, "block int, data binary")


def in_blocks(values: np.ndarray, size: int) -> pa.RecordBatch:
    """An array as rows for ``summed``."""
    cut = range(0, len(values), size)
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([values[k : k + size].tobytes() for k in cut], pa.binary())], names=["block", "data"])


def joined_blocks(sums: DataFrame, dtype: str) -> np.ndarray | None:
    """The whole array on the driver; its length is a parameter of the caller and not of the data."""
    rows = sorted(sums.collect())
    return np.concatenate([np.frombuffer(r[1], dtype) for r in rows]) if rows else None
