"""Advice on the physical layout: which columns an index, or Spark's clustering, would serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.columns import columns, ref
from millrace.operators import ordering, statistics
from millrace.operators.statistics import Statistics

# Names that suggest filters; fixed values.
FILTER_WORDS = ["id", "key", "code", "type", "status", "category", "date", "time", "created", "updated", "timestamp", "country", "region", "city", "state", "department", "user", "customer", "account", "order", "product"]
FILTER_ENDS = "(_id|_key|_code|_type|_status|_date|_name)$"
FILTER_STARTS = "^(id_|is_|has_)"


def json_like(table: DataFrame | Statistics) -> list[str]:
    """Text columns with an array or object among their values."""
    return [r[0] for r in statistics.of(table).columns.where("kind = 'text' AND json > 0").orderBy("pos").select("column").collect()]


def sortedness(df: DataFrame, order_by: str) -> DataFrame:
    """pos and share_sorted: the larger share of steps that don't fall or don't rise, in the order of a numeric column.

    Columns follow each other in ranges of the order; the last row of a range meets the first of the next.
    """
    cols = columns(df, "integer", "float")
    rows = df.select(ref(order_by).cast("double").alias("k"), *(ref(c.name).cast("double").alias(f"v{c.pos}") for c in cols)).where("k IS NOT NULL")
    names = [f"v{c.pos}" for c in cols]
    found = ordering.steps(rows, [F.col(x) for x in ("k", *names)], names)
    places = df.sparkSession.createDataFrame([(k, c.pos) for k, c in enumerate(cols)], "column int, pos int")
    return found.join(places, "column").select("pos", F.try_divide(F.greatest("up", "down").cast("double"), F.col("pairs")).alias("share_sorted"))


def analyze(table: DataFrame | Statistics, order_by: str | None = None) -> DataFrame:
    """One row for each column: cardinality and its ratio, nulls, length, order, and whether it looks like a filter."""
    s = statistics.of(table)
    base = s.columns
    steps = sortedness(s.df, order_by) if order_by else base.select("pos", F.lit(None).cast("double").alias("share_sorted"))
    base = base.join(steps, "pos", "left")
    cardinality = F.coalesce("distinct", F.lit(0))
    ratio = F.coalesce(F.try_divide(cardinality.cast("double"), F.col("total")), F.lit(0.0))
    name = F.lower("column")
    is_filter = (
        F.arrays_overlap(F.split(F.regexp_replace(name, "-", "_"), "_"), F.array(*map(F.lit, FILTER_WORDS)))
        | name.rlike(FILTER_ENDS)
        | name.rlike(FILTER_STARTS)
        | ((F.col("kind") == "integer") & (ratio > 0.9))
        | (F.col("kind") == "temporal")
        | ((F.col("kind") == "text") & (ratio < 0.05))
    )
    is_sorted = F.coalesce((F.col("share_sorted") > 0.95) & (F.col("filled") > 10), F.lit(False))
    nulls = F.coalesce(F.try_divide(F.col("nulls").cast("double"), F.col("total")), F.lit(0.0))
    out = base.select("pos", "column", "kind", "total", cardinality.alias("cardinality"), ratio.alias("ratio"), nulls.alias("null_ratio"), "avg_len", is_sorted.alias("is_sorted"), (F.col("json") > 0).alias("is_json"), is_filter.alias("is_filter"))
    index, priority = rule()
    return out.select("*", index.alias("index_type"), priority.alias("priority"))


def rule() -> tuple[Column, Column]:
    """Kind of index and its priority, from the columns of ``analyze``."""
    c = F.col
    cases = [
        (c("null_ratio") > 0.95, None, "low"),
        (c("is_json"), "GIN", "high"),
        (c("cardinality") <= 1, None, "low"),
        (~c("is_filter"), None, "low"),
        ((c("kind") == "text") & (c("avg_len") > 100), "GIN", "medium"),
        (c("is_sorted") & (c("total") > 10000), "BRIN", "high"),
        ((c("ratio") > 0.01) & (c("cardinality") > 10) & (c("total") > 1000), "BTREE", "high"),
        ((c("ratio") > 0.01) & (c("cardinality") > 10), "BTREE", "medium"),
        ((c("ratio") < 0.05) & (c("cardinality") > 2), "BTREE", "low"),
    ]
    index, priority = None, None
    for when, kind, level in cases:
        index = F.when(when, F.lit(kind)) if index is None else index.when(when, F.lit(kind))
        priority = F.when(when, level) if priority is None else priority.when(when, level)
    return index.otherwise(F.lit(None).cast("string")), priority.otherwise("low")


def recommend(df: DataFrame | Statistics, table: str, exclude: tuple[str, ...] = (), order_by: str | None = None) -> DataFrame:
    """rank, column, index_type, priority, reason and the SQL text, the most useful first; ``exclude``: columns that have an index."""
    rows = analyze(df, order_by).where(F.col("index_type").isNotNull())
    if exclude:
        rows = rows.where(~F.col("column").isin(*exclude))
    level = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    # The reasons are fixed values.
    reason = (
        F.when(F.col("index_type") == "BTREE", F.concat(F.lit("High cardinality ("), F.col("cardinality").cast("string"), F.lit(" unique), good selectivity for filtered queries")))
        .when(F.col("index_type") == "BRIN", "Data is physically ordered - BRIN provides compact range filtering")
        .when(F.col("is_json"), "Array/JSON data - GIN enables fast containment queries")
        .otherwise("Long text values - GIN supports full-text search")
    )
    column = F.replace("column", F.lit('"'), F.lit('""'))
    sql = F.concat(F.lower(F.concat(F.lit(f'CREATE INDEX "idx_{table}_'), column)), F.lit(f'" ON "{table}" USING '), F.lower("index_type"), F.lit(' ("'), column, F.lit('");'))
    sql = F.concat(F.lit("CREATE INDEX"), F.substring(sql, 13, 10_000))
    rank = F.row_number().over(Window.orderBy(level, "pos"))  # one row per column
    return rows.select(rank.cast("int").alias("rank"), "column", "index_type", "priority", reason.alias("reason"), sql.alias("sql"))
