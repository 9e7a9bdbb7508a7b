"""Tables of relational databases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")


def checked(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def load_table(spark: SparkSession, table: str, url: str, schema: str | None = None, limit: int | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table, read in parallel ranges of ``partition_column`` where one is given; the limit reaches the database."""
    name = f"{checked(schema)}.{checked(table)}" if schema else checked(table)
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=checked(partition_column), lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    df = reader.load()
    return df.limit(limit) if limit else df


def save_table(df: DataFrame, table: str, url: str, schema: str | None = None, if_exists: str = "replace", **options: str) -> int:
    """Write a table (replace, append or fail) and return its rows, counted on the way."""
    modes = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}
    if if_exists not in modes:
        raise ValueError(f"unknown mode {if_exists}")
    name = f"{checked(schema)}.{checked(table)}" if schema else checked(table)
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.format("jdbc").options(url=url, dbtable=name, **options).mode(modes[if_exists]).save()
    return seen.get["rows"]
