"""Row order without a global window: gaps, row numbers, carried values and steps.

Rows are dealt into ranges of their order by one range shuffle and sorted inside
each. The number of ranges follows the number of rows, equal keys are split by ties
and by a number of the row, and a table of one row per range (at most
``MOST_RANGES``) carries what crosses the borders. Sorted rows are written to the
shared folder once, since ranges that are drawn anew could differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.sources import folders

RANGE_ROWS = 1 << 20
MOST_RANGES = 20_000
PLACES = 1 << 33  # rows of a partition, in the numbers that Spark gives to rows


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def in_ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """row (a struct of the columns), range and place: dealt by range and sorted inside, rows that are equal in all of ``order`` split as well."""
    keys = [f"o{k}" for k in range(len(order))]
    number = max(1, min(MOST_RANGES, -(-rows.count() // RANGE_ROWS)))
    wide = rows.select(*(o.alias(k) for o, k in zip(order, keys)), F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in rows.columns)).alias("row"), F.monotonically_increasing_id().alias("own"))
    dealt = wide.repartitionByRange(number, *keys, "own").sortWithinPartitions(*keys, "own")
    place = F.monotonically_increasing_id()
    return dealt.select("row", F.spark_partition_id().alias("range"), (place % PLACES).alias("place"))


def before(ends: DataFrame, *columns: str) -> DataFrame:
    """range and columns: of each range, the last values that are no null in the ranges before it. ``ends`` has a row for each range."""
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(ends.select("range", *(F.last(c, ignorenulls=True).over(over).alias(c) for c in columns)))


def gaps(df: DataFrame, column: Column) -> DataFrame:
    """at (micros), gap (micros since the value before) and n (how often), of a temporal column.

    Equal times are one row first; their zero gaps are added as counts.
    """
    return gaps_of(folders.stored(df.select(micros(column).alias("at")).where("at IS NOT NULL").groupBy("at").agg(F.count("*").alias("n")), "times"))


def gaps_of(times: DataFrame) -> DataFrame:
    """The gaps of distinct times (at, n)."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            at = batch.column("row").field("at")
            if len(at):
                earlier = pa.concat_arrays([pa.array([last], pa.int64()), at[:-1]])
                last = at[-1].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("range"), at, earlier, batch.column("row").field("n")], names=["range", "at", "earlier", "n"])

    rows = folders.stored(in_ranges(times, [F.col("at")]).mapInArrow(steps, "range int, at long, earlier long, n long"), "steps")
    borders = before(rows.groupBy("range").agg(F.max("at").alias("last")), "last")
    joined = rows.join(borders, "range").select("at", "n", (F.col("at") - F.coalesce("earlier", "last")).alias("gap"))
    pair = F.array(F.struct(F.col("gap").alias("gap"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("n")))
    return joined.select("at", F.explode(pair).alias("x")).select("at", "x.gap", "x.n").where("gap IS NOT NULL AND n > 0")


def numbered(rows: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """The rows with ``idx``, counted from 0 in the order of key and ties."""
    dealt = folders.stored(in_ranges(rows, [F.col(c) for c in (key, *ties)]), "ordered")
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"))
    over = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("range", F.coalesce(F.sum("size").over(over), F.lit(0)).alias("start")))  # one row per range
    return dealt.join(starts, "range").select("row.*", (F.col("start") + F.col("place")).alias("idx"))


def carried(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """The rows with some columns filled forward in the given order; nulls before the first value stay."""
    schema = T.StructType([T.StructField("row", rows.schema), T.StructField("range", T.IntegerType()), T.StructField("place", T.LongType()), *(T.StructField(f"c{k}", rows.schema[c].dataType) for k, c in enumerate(columns))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [None] * len(columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for k, c in enumerate(columns):
                own = pc.fill_null_forward(batch.column("row").field(c))
                if last[k] is not None:
                    own = pc.fill_null(own, last[k])
                last[k] = own[-1] if own[-1].is_valid else None
                out.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f"c{k}" for k in range(len(columns)))])

    filled = folders.stored(in_ranges(rows, order).mapInArrow(fill, schema), "carried")
    names = [f"c{k}" for k in range(len(columns))]
    ends = filled.groupBy("range").agg(*(F.max_by(c, "place").alias(c) for c in names))
    borders = before(ends, *names).toDF("range", *(f"b{k}" for k in range(len(columns))))
    new = {c: F.coalesce(f"c{k}", f"b{k}").alias(c) for k, c in enumerate(columns)}
    return filled.join(borders, "range").select(*(new[c] if c in new else F.col("row")[c].alias(c) for c in rows.columns))


def steps(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """column (its number), up, down and pairs: of neighbouring rows whose values both are there, how many don't fall, don't rise, and are in all.

    A range returns its counts and its first and last row, so only a row per range is kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, last, number = np.zeros((3, len(columns)), np.int64), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column("row").field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            number = batch.column("range")[0].as_py()
            first = x[0] if first is None else first
            x = x if last is None else np.vstack([last, x])
            last = x[-1]
            total += compared(x[:-1], x[1:])
        if first is not None:
            yield pa.RecordBatch.from_pydict({"range": pa.array([number], pa.int32()), "total": [total.ravel().tolist()], "first": [first.tolist()], "last": [last.tolist()]})

    parts = in_ranges(rows, order).mapInArrow(count, "range int, total array<long>, first array<double>, last array<double>").orderBy("range").collect()  # one row per range
    total = sum((np.array(p["total"], np.int64).reshape(3, -1) for p in parts), np.zeros((3, len(columns)), np.int64))
    for a, b in zip(parts, parts[1:]):
        total += compared(np.array([a["last"]], float), np.array([b["first"]], float))
    return rows.sparkSession.createDataFrame([(k, *map(int, total[:, k])) for k in range(len(columns))], "column int, up long, down long, pairs long")


def compared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each column: steps from a to b that don't fall, that don't rise, and all; those with a missing value are none."""
    with np.errstate(invalid="ignore"):
        return np.array([(b >= a).sum(axis=0), (b <= a).sum(axis=0), (~np.isnan(a) & ~np.isnan(b)).sum(axis=0)])
