"""Moments of numeric columns, and co-moments of all their pairs, from one scan.

Tasks add up powers and products of whole blocks of columns for each Arrow batch,
with masks for nulls, around a value of the column, so that constant columns stay
exactly constant. A task returns a row for each column or pair, and these merge by
moving all of them to the common mean. Values are never turned into rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.columns import Col, ref


def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values of all columns (0 where there is none) and where there are values."""
    known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
    x = np.column_stack([c.fill_null(0.0).to_numpy() for c in batch.columns])
    return x, known


class Centre:
    """A value of each column near its middle: the median of the first batch that has any."""

    def __init__(self, columns: int) -> None:
        self.at, self.set = np.zeros(columns), np.zeros(columns, bool)

    def shifted(self, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        for j in np.flatnonzero(~self.set & known.any(axis=0)):
            own = x[known[:, j], j]
            self.at[j], self.set[j] = np.median(own) if np.isfinite(own).all() else 0.0, True
        return np.where(known, x - self.at, 0.0)


def doubles(df: DataFrame, cols: list[Col]) -> DataFrame:
    return df.select(*(ref(c.name).cast("double").alias(f"v{c.pos}") for c in cols))


def singles(df: DataFrame, cols: list[Col]) -> DataFrame:
    """pos, n, mean, m2, m3, m4 (sums of powers around the mean), low and high of each column with values."""
    places = [c.pos for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, n, s = Centre(len(places)), np.zeros(len(places), np.int64), np.zeros((4, len(places)))
        low, high = np.full(len(places), np.inf), np.full(len(places), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, known = matrix(batch)
            n += known.sum(axis=0)
            low = np.minimum(low, np.where(known, x, np.inf).min(axis=0))
            high = np.maximum(high, np.where(known, x, -np.inf).max(axis=0))
            d = centre.shifted(x, known)
            power = np.ones_like(d)
            for k in range(4):
                power = power * d
                s[k] += power.sum(axis=0)
        j = np.flatnonzero(n)
        if len(j):
            m, a = n[j].astype(float), s[:, j] / n[j]
            mean = a[0]
            m2 = m * (a[1] - mean**2)
            m3 = m * (a[2] - 3 * mean * a[1] + 2 * mean**3)
            m4 = m * (a[3] - 4 * mean * a[2] + 6 * mean**2 * a[1] - 3 * mean**4)
            yield pa.RecordBatch.from_pydict({"pos": pa.array(np.array(places)[j], pa.int32()), "n": n[j], "mean": centre.at[j] + mean, "m2": m2, "m3": m3, "m4": m4, "low": low[j], "high": high[j]})

    parts = doubles(df, cols).mapInArrow(run, "pos int, n long, mean double, m2 double, m3 double, m4 double, low double, high double")
    moved, n, d = to_common(parts, ["pos"], "mean")
    up = lambda c, *more: F.sum(F.col(c) + sum(more, F.lit(0.0)))
    return moved.groupBy("pos").agg(
        F.sum("n").alias("n"),
        F.first("common_mean").alias("mean"),
        up("m2", n * d * d).alias("m2"),
        up("m3", 3 * d * F.col("m2"), n * d * d * d).alias("m3"),
        up("m4", 4 * d * F.col("m3"), 6 * d * d * F.col("m2"), n * d * d * d * d).alias("m4"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def to_common(parts: DataFrame, keys: list[str], *means: str) -> tuple[DataFrame, Column, Column]:
    """The rows of tasks with the common mean of each key, their numbers, and the distance of (the first of) their means to it.

    The common mean is taken from the least one upwards, so equal means stay as they are.
    """
    over = Window.partitionBy(*keys)  # a row for each task
    for c in means:
        parts = parts.withColumn(f"least_{c}", F.min(c).over(over))
    for c in means:
        parts = parts.withColumn(f"common_{c}", F.col(f"least_{c}") + F.sum(F.col("n") * (F.col(c) - F.col(f"least_{c}"))).over(over) / F.sum("n").over(over))
    return parts, F.col("n").cast("double"), F.col(means[0]) - F.col(f"common_{means[0]}")


def pairs(df: DataFrame, cols: list[Col]) -> DataFrame:
    """pos_a, pos_b, n, xx, yy and xy (sums of products around the means) of each pair of columns, over the rows that have both."""
    places = np.array([c.pos for c in cols])
    first, second = np.triu_indices(len(cols), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = Centre(len(places))
        n, s, q, p = (np.zeros((len(places), len(places))) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, known = matrix(batch)
            d, m = centre.shifted(x, known), known.astype(float)
            n += m.T @ m
            s += d.T @ m
            q += (d * d).T @ m
            p += d.T @ d
        a, b = first[n[first, second] > 0], second[n[first, second] > 0]
        if len(a):
            both = n[a, b]
            mx, my = s[a, b] / both, s[b, a] / both
            yield pa.RecordBatch.from_pydict({
                "pos_a": pa.array(places[a], pa.int32()), "pos_b": pa.array(places[b], pa.int32()), "n": both.astype(np.int64), "mx": centre.at[a] + mx, "my": centre.at[b] + my,
                "xx": q[a, b] - both * mx * mx, "yy": q[b, a] - both * my * my, "xy": p[a, b] - both * mx * my,
            })

    parts = doubles(df, cols).mapInArrow(run, "pos_a int, pos_b int, n long, mx double, my double, xx double, yy double, xy double")
    moved, n, dx = to_common(parts, ["pos_a", "pos_b"], "mx", "my")
    dy = F.col("my") - F.col("common_my")
    return moved.groupBy("pos_a", "pos_b").agg(F.sum("n").alias("n"), F.sum(F.col("xx") + n * dx * dx).alias("xx"), F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy"))
