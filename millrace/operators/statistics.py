"""All statistics of a table from one scan: its frequency table, and what derives from it.

The table is read once, for how often each value of each column occurs, nulls
included. This frequency table is written to the shared folder; counts, flags,
lengths, moments, quantiles, outliers and the gaps of times come from it, each when
it is first asked for. Values of all columns share one shuffle and equal values
combine before it. A text is looked at once for each distinct value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import columns, normal
from millrace.operators import stats
from millrace.operators.times import as_time
from millrace.sources import folders

NUMBER = ("integer", "float")
DECIMALS = 5


class Statistics:
    """Statistics of a table. ``values``: pos, there, num, whole, text and n; ``columns``: a row for each column."""

    def __init__(self, df: DataFrame, threshold: float = 1.5) -> None:
        self.df, self.threshold = normal(df), threshold
        self.cols = columns(self.df)

    def of(self, *kinds: str) -> list[int]:
        return [c.pos for c in self.cols if c.kind in kinds]

    @cached_property
    def values(self) -> DataFrame:
        return folders.stored(stats.frequency(self.df, self.cols, nulls=True), "values")

    @cached_property
    def columns(self) -> DataFrame:
        """pos, column, kind, counts, lengths and flags of each column; one aggregation over the frequency table."""
        is_text, is_number, is_true = (F.col("pos").isin(p) if p else F.lit(False) for p in (self.of("text"), self.of(*NUMBER), self.of("boolean")))
        n, t, x = F.col("n"), F.when(is_text, F.col("text")), F.when(is_number, F.col("num"))
        filled = F.coalesce(F.sum(F.when(F.col("there"), n)), F.lit(0))

        def rows_where(test: Column) -> Column:
            return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

        def any_of(test: Column) -> Column:
            return F.coalesce(F.max(test), F.lit(False))

        cased = F.lower(t) != F.upper(t)
        digits = F.coalesce(*(F.when(F.round(x, k) == x, F.lit(max(k, 1))) for k in range(DECIMALS)), F.when(x.isNotNull(), F.lit(DECIMALS)))
        truth = F.when(is_number, F.col("num") != 0).when(is_true, F.col("text") == "true").otherwise(F.col("text") != "")
        found = self.values.groupBy("pos").agg(
            F.sum(n).alias("total"),
            filled.alias("filled"),
            F.count(F.when(F.col("there"), 1)).alias("distinct"),
            F.max(F.when(F.col("there"), n)).alias("most"),
            F.min(F.when(F.col("there"), n)).alias("least"),
            F.try_divide(F.sum(x * n), F.sum(F.when(x.isNotNull(), n))).alias("mean"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.max(digits).alias("decimals"),
            rows_where(F.abs(x) == float("inf")).alias("infinite"),
            rows_where(x == 0).alias("zeros"),
            F.min(F.when(~is_number, F.col("text"))).alias("low_text"),
            F.max(F.when(~is_number, F.col("text"))).alias("high_text"),
            F.try_divide(F.sum(F.length(t) * n).cast("double"), F.sum(F.when(t.isNotNull(), n))).alias("avg_len"),
            F.min(F.length(t)).alias("min_len"),
            F.max(F.length(t)).alias("max_len"),
            (any_of((t == F.lower(t)) & cased) & any_of((t == F.upper(t)) & cased)).alias("mixed_case"),
            any_of(t.startswith(" ") | t.endswith(" ")).alias("spaced"),
            F.try_divide(rows_where(t.rlike(r"^\d+\n?$")).cast("double"), filled).alias("digit_share"),
            any_of(t.rlike("[a-zA-Z]")).alias("letters"),
            rows_where(F.trim(t) == "").alias("empty"),
            F.try_divide(rows_where(as_time(t).isNotNull()).cast("double"), filled).alias("dated"),
            rows_where(t.startswith("[") | t.startswith("{")).alias("json"),
            F.try_divide(rows_where(truth & F.col("there")).cast("double"), filled).alias("truth"),
        )
        names = self.df.sparkSession.createDataFrame([(c.pos, c.name, c.kind) for c in self.cols], "pos int, column string, kind string")
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "filled", "distinct", "infinite", "zeros", "empty", "json")}
        rows = F.broadcast(names).join(found, "pos", "left").withColumns(zero)
        share = F.coalesce(F.try_divide(F.col("filled") * 100.0, F.col("total")), F.lit(0.0))
        ratio = F.coalesce(F.try_divide(F.col("distinct").cast("double"), F.col("filled")), F.lit(0.0))
        flags = {c: F.coalesce(c, F.lit(False)) for c in ("mixed_case", "spaced", "letters")}
        return folders.stored(rows.withColumns(flags | {"nulls": F.col("total") - F.col("filled"), "completeness": F.round(share, 2), "unique_ratio": ratio}), "columns")

    @cached_property
    def spread(self) -> DataFrame:
        """pos, std, g1, g2, quartiles, fences and outliers of numeric columns: two more aggregations over the frequency table."""
        places = self.of(*NUMBER)
        known = self.columns.where(F.col("pos").isin(places) if places else F.lit(False)).select("pos", "mean", "distinct", "filled")
        numbers = self.values.where("num IS NOT NULL").select("pos", "num", "n").join(F.broadcast(known), "pos")
        d, n = F.col("num") - F.col("mean"), F.col("n")
        sums = numbers.groupBy("pos").agg(F.max("distinct").alias("distinct"), F.sum("n").alias("m"), F.sum(d * d * n).alias("m2"), F.sum(d * d * d * n).alias("m3"), F.sum(d * d * d * d * n).alias("m4"))
        g1, g2, std = stats.corrected(F.col("m").cast("double"), F.when(F.col("distinct") > 1, F.col("m2")).otherwise(0.0), F.col("m3"), F.col("m4"))
        quartiles = stats.quantiles(self.values.where("num IS NOT NULL"), [0.25, 0.5, 0.75])
        wide = F.col("q2") - F.col("q0")
        bounds = folders.stored(
            sums.join(quartiles, "pos").select(
                "pos", "m", std.alias("std"), g1.alias("g1"), g2.alias("g2"), F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), (F.col("q0") - self.threshold * wide).alias("lower"), (F.col("q2") + self.threshold * wide).alias("upper")
            ),
            "bounds",
        )
        beyond = (F.col("num") < F.col("lower")) | (F.col("num") > F.col("upper"))
        out = numbers.select("pos", "num", "n").join(F.broadcast(bounds.where("m >= 4").select("pos", "lower", "upper")), "pos").groupBy("pos").agg(F.coalesce(F.sum(F.when(beyond, F.col("n"))), F.lit(0)).alias("outliers"))
        return folders.stored(bounds.drop("m").join(F.broadcast(out), "pos", "left"), "spread")

    @cached_property
    def dated(self) -> list[str]:
        """Text columns with over 80 % parseable values among all that aren't null."""
        return [r[0] for r in self.columns.where("kind = 'text' AND dated > 0.8").orderBy("pos").select("column").collect()]

    @cached_property
    def temporal(self) -> list[str]:
        """Temporal columns, then date-like text columns."""
        return [c.name for c in self.cols if c.kind == "temporal"] + self.dated

    def times(self, column: str) -> DataFrame:
        """at (micros) and n of a temporal or date-like column, a row for each time."""
        own = next(c for c in self.cols if c.name == column)
        rows = self.values.where(F.col("pos") == own.pos)
        if own.kind == "temporal":
            return rows.where("whole IS NOT NULL").select(F.col("whole").alias("at"), "n")
        return rows.select(F.unix_micros(as_time(F.col("text"))).alias("at"), "n").where("at IS NOT NULL").groupBy("at").agg(F.sum("n").alias("n"))


def of(table: DataFrame | Statistics) -> Statistics:
    return table if isinstance(table, Statistics) else Statistics(table)
