"""The rows behind an issue: filters and top-k in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import normal, ref
from millrace.operators import stats

# Fixed values
FENCE = 1.5  # interquartile ranges


def shown(df: DataFrame, k: int = 6) -> list[Column]:
    """The first columns as text."""
    return [ref(c).cast("string").alias(c) for c in df.columns[:k]]


def bounds(df: DataFrame, column: str, threshold: float = 1.5) -> DataFrame:
    """One row: n, mean, std, p25, p75, lower and upper of a numeric column."""
    own = normal(df.select(ref(column)))
    return stats.fences(own, threshold).select("n", "mean", "std", "p25", "p75", "lower", "upper")


def flagged(df: DataFrame, column: str, method: str, threshold: float) -> DataFrame:
    df = normal(df)
    with_bounds = df.crossJoin(F.broadcast(bounds(df, column, threshold if method == "iqr" else 1.5)))
    v = ref(column).cast("double")
    if method == "iqr":
        out = (v < F.col("lower")) | (v > F.col("upper"))
    else:
        out = F.abs(F.try_divide(v - F.col("mean"), F.col("std"))) > threshold
    return with_bounds.where((F.col("n") >= 4) & out)


def outlier_rows(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5, limit: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """value, direction, distance from the mean, the usual range, and the first columns as text."""
    v = ref(column).cast("double")
    rows = flagged(df, column, method, threshold)
    order = [ref(c) for c in order_by or df.columns]
    r4 = lambda c: F.round(c, 4)
    return rows.orderBy(*order).limit(limit).select(
        v.alias("_value"), F.when(v > F.col("upper"), "above").otherwise("below").alias("_direction"), r4(F.abs(v - F.col("mean"))).alias("_distance"),
        r4("lower").alias("_normal_min"), r4("upper").alias("_normal_max"), r4("mean").alias("_mean"), r4("p25").alias("_q1"), r4("p75").alias("_q3"), *shown(df),
    )


def issue_rows(df: DataFrame, column: str, issue: str, limit: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """``_count`` rows in all with the issue (missing, outliers or duplicates), and the first of them."""
    order = [ref(c) for c in order_by or df.columns]
    if issue == "missing":
        rows = normal(df).where(ref(column).isNull())
    elif issue == "outliers":
        rows = flagged(df, column, "iqr", FENCE).select(*(ref(c) for c in df.columns))
    elif issue == "duplicates":
        return duplicate_rows(df, column, limit, order_by or df.columns)
    else:
        raise ValueError(f"unknown issue {issue}")
    total = rows.agg(F.count("*").alias("_count"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).select("_count", *shown(df))


def duplicate_rows(df: DataFrame, column: str, limit: int, order_by: list[str]) -> DataFrame:
    """Rows whose value stood in an earlier row. First rows come from an aggregation, so a frequent value meets no window."""
    df = normal(df)
    key = F.struct(*(ref(c) for c in order_by))
    total = df.groupBy(ref(column).alias("v")).agg((F.count("*") - 1).alias("n"), F.min(key).alias("first"))
    count = total.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_count"))
    later = df.withColumn("__key", key).join(total.where("n > 0"), ref(column).eqNullSafe(F.col("v"))).where(F.col("__key") > F.col("first"))
    return later.orderBy(*(ref(c) for c in order_by)).limit(limit).crossJoin(F.broadcast(count)).select("_count", *shown(df))

