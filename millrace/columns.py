"""Kinds of columns, and one aggregation over all of them at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Col:
    pos: int
    name: str
    kind: str  # integer, float, text, boolean, temporal or other


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def columns(df: DataFrame, *kinds: str) -> list[Col]:
    found = [Col(k, f.name, kind_of(f.dataType)) for k, f in enumerate(df.schema)]
    return [c for c in found if not kinds or c.kind in kinds]


def numeric(df: DataFrame) -> list[Col]:
    return columns(df, "integer", "float")


def ref(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def normal(df: DataFrame) -> DataFrame:
    """NaN becomes null and decimals doubles, once at entry."""
    out = []
    for f in df.schema:
        c = ref(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def per_column(df: DataFrame, cols: list[Col], measures: dict[str, Callable[[Col], Column]]) -> DataFrame:
    """pos, column, kind and the measures: one job and one aggregation for all columns."""
    if not cols:
        row = df.limit(0).select(F.lit(0).alias("pos"), F.lit("").alias("column"), F.lit("").alias("kind"))
        return row.select("*", *(F.lit(None).cast("double").alias(m) for m in measures))
    wide = df.agg(*(f(c).alias(f"{c.pos}_{m}") for c in cols for m, f in measures.items()))
    rows = [F.struct(F.lit(c.pos).alias("pos"), F.lit(c.name).alias("column"), F.lit(c.kind).alias("kind"), *(F.col(f"{c.pos}_{m}").alias(m) for m in measures)) for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
