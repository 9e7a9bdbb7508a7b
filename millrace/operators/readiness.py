"""Checks whether a table is fit for model training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import numeric
from millrace.operators import correlation, statistics, stats
from millrace.operators.statistics import Statistics
from millrace.sources import folders

CHECKS = ["Missing Values", "Class Imbalance", "Constant Columns", "High Cardinality", "Feature Correlation", "Target Leakage", "Data Size"]
#: What to do about a failed check; fixed values.
SUGGESTIONS = [
    "Apply imputation or drop columns with >50% missing",
    "Consider SMOTE, class weights, or stratified sampling",
    "Remove constant columns - they provide no signal",
    "Use target encoding, hashing, or embeddings instead of one-hot",
    "Drop one of each correlated pair or use PCA for dimensionality reduction",
    "Verify these features are available at prediction time",
    "Collect more data or use few-shot / transfer learning approaches",
]


def measured(table: DataFrame | Statistics) -> DataFrame:
    """check (1 to 7) and value: percent of missing cells, worst class ratio, constant columns, columns of high cardinality, correlated pairs, leaking pairs, rows."""
    s = statistics.of(table)
    counts = each = s.columns
    pairs = folders.stored(correlation.matrix(s.df), "pairs")
    number = {c.pos for c in numeric(s.df)}

    def row(k: int, of: DataFrame, value: Column) -> DataFrame:
        return of.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")).select(F.lit(k).alias("check"), "value")

    balance = each.where((F.col("kind") == "text") & F.col("distinct").between(2, 20))
    two = each.where(F.col("pos").isin(*number) & (F.col("distinct") == 2)).select("pos") if number else each.limit(0).select("pos")
    exact = pairs.where(F.abs("r") > 0.99)
    leaking = exact.select(F.col("pos_a").alias("pos")).union(exact.select("pos_b")).join(two, "pos", "left_semi")
    return stats.union(
        [
            row(1, counts, F.avg(F.try_divide(F.col("nulls") * 100.0, F.col("total")))),
            row(2, balance, F.coalesce(F.min(F.col("least") / F.col("most")), F.lit(1.0))),
            row(3, each, F.sum((F.col("distinct") <= 1).cast("long"))),
            row(4, each.where("kind = 'text'"), F.sum(((F.col("distinct") > 0.5 * F.col("total")) & (F.col("distinct") > 100)).cast("long"))),
            row(5, pairs, F.sum((F.abs("r") > 0.95).cast("long"))),
            row(6, leaking, F.count("*")),
            row(7, counts, F.max("total")),
        ]
    )


def checks(table: DataFrame | Statistics) -> DataFrame:
    """check, name, passed, severity, value and suggestion."""
    k, v = F.col("check"), F.col("value")
    passed = F.when(k == 1, v < 5).when(k == 2, v > 0.3).when(k == 7, v >= 50).otherwise(v == 0)
    worst = F.when(k.isin(1, 6, 7), "critical").otherwise("warning")
    mild = F.when((k == 1) & (v > 0), "warning").when((k == 7) & (v < 500), "warning").otherwise("info")
    text = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k)
    return measured(table).select("check", text(CHECKS).alias("name"), passed.alias("passed"), F.when(passed, mild).otherwise(worst).alias("severity"), F.round("value", 4).alias("value"), F.when(~passed, text(SUGGESTIONS)).alias("suggestion"))


def report(table: DataFrame | Statistics) -> DataFrame:
    """ready, score (percent of checks passed) and next_steps."""
    steps = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("check", "suggestion")))), lambda x: x["suggestion"])
    return checks(table).agg(F.min("passed").alias("ready"), F.round(F.avg(F.col("passed").cast("double")) * 100, 1).alias("score"), steps.alias("next_steps"))
