"""Profiles of temporal columns: frequency, gaps, trend, seasonality, stationarity.

Trend, seasonality and stationarity take the values in the order of time, ties
by the other columns; row numbers come from sorted ranges and not from one window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import columns, normal, numeric, ref
from millrace.operators import moments, ordering, profile, stats

BLOCK = 1 << 16  # rows of a block of autocorrelations
LAGS = [7, 12, 14, 24, 28, 30, 52, 60, 90, 365]  # fixed values


def time_columns(df: DataFrame) -> list[str]:
    """Temporal columns, and text columns of which most values are dates."""
    return [c.name for c in columns(df, "temporal")] + profile.date_like(df)


def at(df: DataFrame, column: str) -> Column:
    return profile.as_time(ref(column)) if dict(df.dtypes)[column] == "string" else ref(column)


def rhythm(df: DataFrame, column: str) -> DataFrame:
    """points, first, last, mode_seconds, frequency, regular and gap_count."""
    own = ordering.gaps(df, at(df, column))
    mode = profile.modal_gap(own)
    total = F.sum("n")
    gaps = own.crossJoin(F.broadcast(mode)).agg(
        F.max("mode").alias("mode"),
        F.try_divide(F.sum(F.when(F.col("gap") == F.col("mode"), F.col("n")).otherwise(0)), total).alias("share"),
        F.coalesce(F.sum(F.when((F.col("mode") > 0) & (F.col("gap") > 2 * F.col("mode")), F.col("n"))), F.lit(0)).alias("gap_count"),
    )
    ends = df.agg(F.count(at(df, column)).alias("points"), F.min(at(df, column)).cast("string").alias("first"), F.max(at(df, column)).cast("string").alias("last"))
    seconds = F.col("mode") / 1e6
    kind = F.when(F.col("points") < 2, "insufficient_data").otherwise(profile.frequency_class(seconds))
    return ends.crossJoin(gaps).select("points", "first", "last", seconds.alias("mode_seconds"), kind.alias("frequency"), F.coalesce(F.col("share") > 0.9, F.lit(False)).alias("regular"), "gap_count")


def gap_places(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The first gaps over twice the modal one: where they end, and their seconds."""
    own = ordering.gaps(df, at(df, column))
    large = own.crossJoin(F.broadcast(profile.modal_gap(own))).where("mode > 0 AND gap > 2 * mode")
    return large.orderBy("at").limit(limit).select(F.timestamp_micros("at").cast("string").alias("after"), (F.col("gap") / 1e6).alias("gap_seconds"))


def ordered(df: DataFrame, column: str, value: str) -> DataFrame:
    """idx (from 0, by time), v and n (how many): the values that aren't null."""
    df = normal(df)
    rest = [c for c in df.columns if c not in (column, value)]
    rows = df.select(ordering.micros(at(df, column)).alias("us"), ref(value).cast("double").alias("v"), *(ref(c).alias(f"t{k}") for k, c in enumerate(rest))).where("us IS NOT NULL AND v IS NOT NULL")
    sizes = rows.agg(F.count("*").alias("n"))
    return ordering.numbered(rows, "us", ["v", *(f"t{k}" for k in range(len(rest)))]).crossJoin(F.broadcast(sizes)).select("idx", "v", "n")


def trend(values: DataFrame) -> DataFrame:
    """One row: direction (increasing, decreasing or flat) by the means of both halves."""
    first = F.avg(F.when(F.col("idx") < F.floor(F.col("n") / 2), F.col("v")))
    second = F.avg(F.when(F.col("idx") >= F.floor(F.col("n") / 2), F.col("v")))
    a = values.agg(first.alias("a"), second.alias("b"), F.max("n").alias("n"))
    change = (F.col("b") - F.col("a")) / (F.abs("a") + 1e-10)
    return a.select(F.when(F.coalesce("n", F.lit(0)) < 10, "flat").when(change > 0.1, "increasing").when(change < -0.1, "decreasing").otherwise("flat").alias("trend"))


def autocorrelation(values: DataFrame, lags: list[int] = LAGS) -> DataFrame:
    """lag and r for lags below half the length.

    Rows are cut into blocks of their numbers, each with the first rows of the next;
    a block returns sums for each lag.
    """
    halo = max(lags)
    own = values.select(F.explode(F.when(F.col("idx") % BLOCK < halo, F.array(F.floor(F.col("idx") / BLOCK), F.floor(F.col("idx") / BLOCK) - 1)).otherwise(F.array(F.floor(F.col("idx") / BLOCK)))).alias("block"), "idx", "v", "n").where("block >= 0")

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        start, v = int(rows["block"].iloc[0]) * BLOCK, rows["v"].to_numpy(float)
        begin = int(rows["idx"].iloc[0]) - start  # 0: numbers have no holes
        out = []
        for lag in lags:
            if lag < rows["n"].iloc[0] // 2:
                size = max(0, min(BLOCK - begin, len(v) - lag))
                x, y = v[:size], v[lag : lag + size]
                if size:
                    mx, my = x[0] + (x - x[0]).mean(), y[0] + (y - y[0]).mean()
                    out.append((lag, size, mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum()))
        return pd.DataFrame(out, columns=["lag", "n", "mx", "my", "xx", "yy", "xy"])

    parts = own.groupBy("block").applyInPandas(sums, "lag int, n long, mx double, my double, xx double, yy double, xy double")
    moved, n, dx = moments.to_common(parts, ["lag"], "mx", "my")
    dy = F.col("my") - F.col("common_my")
    total = lambda c, d: F.sum(F.col(c) + n * d)
    return moved.groupBy("lag").agg(F.try_divide(total("xy", dx * dy), F.sqrt(total("xx", dx * dx)) * F.sqrt(total("yy", dy * dy))).alias("r"))


def seasonality(values: DataFrame) -> DataFrame:
    """One row: the lag of the largest absolute autocorrelation over 0.4, if any; at least 30 values."""
    best = autocorrelation(values.where("n >= 30")).agg(F.max(F.struct(F.abs("r").alias("strength"), (-F.col("lag")).alias("less"))).alias("x"))
    strong = F.col("x.strength") > 0.4
    return best.select(F.coalesce(strong, F.lit(False)).alias("seasonal"), F.when(strong, -F.col("x.less")).alias("period"), F.round("x.strength", 4).alias("strength"))


def stationarity(values: DataFrame) -> DataFrame:
    """One row: the variances of three equal parts, and whether their ratio stays below 2."""
    size = F.floor(F.col("n") / 3)
    parts = values.where("n >= 30").select(F.floor(F.col("idx") / size).alias("part"), "v").where("part < 3").groupBy("part").agg(F.var_pop("v").alias("var")).agg(F.min("var").alias("low"), F.max("var").alias("high"))
    steady = F.col("low").isNull() | (F.col("low") == 0) | (F.col("high") / (F.col("low") + 1e-10) < 2)
    return parts.select(F.round("low", 4).alias("var_min"), F.round("high", 4).alias("var_max"), steady.alias("stationary"))


def report(df: DataFrame, column: str | None = None, value: str | None = None) -> DataFrame:
    """One row for each temporal column, with the first numeric column as its values."""
    names = [column] if column else time_columns(df)
    numbers = numeric(df)
    value = value or (numbers[0].name if numbers else None)
    parts = []
    for name in names:
        row = rhythm(df, name)
        if value:
            values = ordered(df, name, value)
            row = row.crossJoin(trend(values)).crossJoin(seasonality(values).select("seasonal", "period")).crossJoin(stationarity(values).select("stationary"))
        parts.append(row.select(F.lit(name).alias("column"), "*"))
    if not parts:
        raise ValueError("no temporal column")
    return stats.union(parts)
