"""Column profiles: statistics, roles and insights, one row for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import columns, normal, ref
from millrace.operators import ordering, statistics, stats, topk
from millrace.operators.statistics import Statistics
from millrace.operators.times import as_time
from millrace.sources import folders

# Fixed values
FENCE = 1.5  # interquartile ranges
NEAR_CONSTANT = 0.01  # distinct values by values
ID_RATIO = 0.95  # the same, of identifiers
ID_ROWS = 50  # rows of a table with identifiers
FREE_TEXT = 50.0  # average length

#: Shape of a numeric column and what it means; fixed values.
INTERPRETATIONS = {
    "normal": "Normally distributed, standard parametric methods apply",
    "right_skewed": "Right-skewed, consider log transformation for modeling",
    "left_skewed": "Left-skewed, consider power transformation",
    "heavy_tailed": "Heavy-tailed, sensitive to outliers",
    "symmetric": "Symmetric distribution, well-behaved for most analyses",
    "moderate_skew": "Moderate skew, may benefit from normalization",
    "insufficient_data": "Too few values for reliable distribution analysis",
}


def ranges(df: DataFrame) -> DataFrame:
    """pos, low_text and high_text: least and greatest value of each column as text, in the column's own order."""
    from millrace.columns import per_column

    usable = columns(df, "text", "boolean", "temporal")
    return per_column(df, usable, {"low_text": lambda c: F.min(ref(c.name)).cast("string"), "high_text": lambda c: F.max(ref(c.name)).cast("string")}).drop("kind")


def samples(df: DataFrame, order_by: list[str], k: int = 5) -> DataFrame:
    """pos, column and samples: the first k values of each column that aren't null, in the given order."""
    cells = [F.struct(F.lit(c.pos).alias("pos"), F.lit(c.name).alias("column"), ref(c.name).cast("string").alias("value")) for c in columns(df)]
    keys = [ref(o).alias(f"o{i}") for i, o in enumerate(order_by)]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*(f"o{i}" for i in range(len(keys))), "x.pos", "x.column", "x.value").where("value IS NOT NULL")
    first = topk.firsts(rows, "pos", {**{f"o{i}": True for i in range(len(keys))}, "value": True}, k)
    return first.groupBy("pos", "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))


def date_like(df: DataFrame) -> list[str]:
    """Text columns with over 80 % parseable values among all that aren't null. Each distinct value is read once."""
    texts = [ref(c.name) for c in columns(df, "text")]
    return Statistics(df.select(*texts)).dated if texts else []


def basics(table: DataFrame | Statistics) -> DataFrame:
    """All statistics of each column; the base of the other reports."""
    s = statistics.of(table)
    base = s.columns.join(F.broadcast(s.spread), "pos", "left")
    shape = F.when(F.col("kind").isin("integer", "float"), stats.distribution(F.col("g1"), F.col("g2"), F.col("filled"))).otherwise("categorical")
    return base.withColumns({"outliers": F.coalesce("outliers", F.lit(0)), "distribution": shape})


def issues() -> Column:
    """Issues of a row of ``basics``."""
    # The words of the issues are fixed values.
    found = [
        F.when(F.col("completeness") < 95, F.concat(F.round(100 - F.col("completeness"), 1).cast("decimal(18,1)").cast("string"), F.lit("% missing values"))),
        F.when(F.col("outliers") > 0, F.concat(F.col("outliers").cast("string"), F.lit(" outliers detected"))),
        F.when((F.col("unique_ratio") == 1) & (F.col("total") > 100), F.lit("possible ID column (all values unique)")),
        F.when((F.col("unique_ratio") < NEAR_CONSTANT) & (F.col("total") > 100), F.lit("near-constant column")),
        F.when(F.col("filled") == 0, F.lit("entirely null")),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def roles(table: DataFrame | Statistics) -> DataFrame:
    """The columns of a table with their statistics and roles."""
    s = statistics.of(table)
    base, dated = s.columns, s.dated
    kind, distinct, ratio = F.col("kind"), F.col("distinct"), F.col("unique_ratio")
    is_id = (ratio > ID_RATIO) & (F.col("total") > ID_ROWS)
    role = (
        F.when((kind == "boolean") | ((distinct <= 2) & (F.col("filled") > 0)), "boolean")
        .when(kind == "temporal", "datetime")
        .when((kind == "text") & (F.col("filled") > 10) & F.col("column").isin(dated), "datetime")
        .when(kind.isin("integer", "float") & is_id, "id")
        .when(kind.isin("integer", "float"), "measure")
        .when((kind == "text") & is_id, "id")
        .when((kind == "text") & ((F.coalesce("avg_len", F.lit(0.0)) > FREE_TEXT) | (ratio > 0.8)), "free_text")
        .when(kind == "text", "category")
        .otherwise("measure")
    )
    return base.withColumn("role", role)


def columns_report(table: DataFrame | Statistics) -> DataFrame:
    """The basic profile of every column."""
    r4 = lambda c: F.round(c, 4)
    base = basics(table)
    return base.select(
        "column", "kind", "total", "nulls", "completeness", F.col("distinct").alias("unique_count"), r4("unique_ratio").alias("unique_ratio"), r4("mean").alias("mean"), r4("std").alias("std"),
        F.col("low").alias("min_value"), F.col("high").alias("max_value"), F.col("low_text").alias("min_text"), F.col("high_text").alias("max_text"), "distribution", "outliers", issues().alias("issues"),
    )


def top_values(table: DataFrame | Statistics, k: int = 8) -> DataFrame:
    """column, value, n, rank, share (percent of the first) and skewed: the most frequent values of each column that isn't numeric.

    Each task keeps k values of a column.
    """
    known = isinstance(table, Statistics)
    df = table.df if known else normal(table)
    cols = columns(df, "text", "boolean", "temporal")
    freq = table.values.where(F.col("there") & F.col("pos").isin([c.pos for c in cols])) if known and cols else stats.frequency(df, cols)
    freq = freq.select("pos", F.col("text").alias("value"), "n")
    freq = freq if known else folders.stored(freq, "values")
    ranked = topk.firsts(freq, "pos", {"n": False, "value": True}, k)
    sizes = freq.groupBy("pos").agg(F.sum("n").alias("filled"), F.max("n").alias("most"))
    names = F.create_map(*(x for c in cols for x in (F.lit(c.pos), F.lit(c.name)))) if cols else F.lit("")
    share = F.round(F.col("most") * 100.0 / F.col("filled"), 1)
    return ranked.join(F.broadcast(sizes), "pos").select(names[F.col("pos")].alias("column") if cols else names.alias("column"), "value", "n", "rank", share.alias("dominant_pct"), (share > 50).alias("is_skewed"))


def numeric_insights(df: DataFrame) -> DataFrame:
    """median, range, quartiles, shape and what it means, of numeric columns."""
    df = normal(df)
    m = stats.fences(df, FENCE).where("n > 0")
    shape = stats.distribution(F.col("g1"), F.col("g2"), F.col("n"))
    meaning = F.create_map(*(F.lit(x) for kv in INTERPRETATIONS.items() for x in kv))
    return m.select("column", F.round("median", 4).alias("median"), F.round(F.col("high") - F.col("low"), 4).alias("range_value"), F.round("p25", 4).alias("p25"), F.round("p75", 4).alias("p75"), shape.alias("shape"), meaning[shape].alias("interpretation"))


def frequency_class(seconds: Column) -> Column:
    return F.when(seconds < 7200, "hourly").when(seconds < 172800, "daily").when(seconds < 864000, "weekly").when(seconds < 3888000, "monthly").otherwise("irregular")


def modal_gap(gaps: DataFrame) -> DataFrame:
    """One row with ``mode``, the most frequent gap, the smallest of several."""
    sizes = gaps.groupBy("gap").agg(F.sum("n").alias("n"))
    return sizes.agg(F.max(F.struct("n", (-F.col("gap")).alias("less"))).alias("x")).select((-F.col("x.less")).alias("mode"))


def datetime_insights(table: DataFrame | Statistics) -> DataFrame:
    """First and last day, frequency and number of gaps over twice the modal one, of temporal and date-like columns."""
    s = statistics.of(table)
    parts = []
    for name in s.temporal:
        times = s.times(name)
        own = ordering.gaps_of(times)
        mode = modal_gap(own)
        large = own.crossJoin(F.broadcast(mode)).agg(F.max("mode").alias("mode"), F.coalesce(F.sum(F.when((F.col("gap") > 2 * F.col("mode")) & (F.col("mode") > 0), F.col("n"))), F.lit(0)).alias("gap_count"))
        day = lambda c: F.timestamp_micros(c).cast("date").cast("string")
        ends = times.agg(day(F.min("at")).alias("range_start"), day(F.max("at")).alias("range_end"), F.sum("n").alias("n"))
        parts.append(ends.where("n >= 2").crossJoin(large).select(F.lit(name).alias("column"), "range_start", "range_end", frequency_class(F.col("mode") / 1e6).alias("frequency"), "gap_count"))
    return stats.union(parts) if parts else s.df.sparkSession.createDataFrame([], "column string, range_start string, range_end string, frequency string, gap_count long")


def insight(role: Column, truth: Column, top: Column, top_share: Column, spans: Column) -> Column:
    """One sentence on a column."""
    missing = F.concat(F.round(F.col("nulls") * 100.0 / F.greatest("total", F.lit(1)), 1).cast("string"), F.lit("% missing"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    outliers = F.when(F.col("outliers") > 0, F.concat(F.lit(", "), text(F.col("outliers")), F.lit(" outliers"))).otherwise("")
    words = F.regexp_replace("distribution", "_", " ")
    shape = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 100))
    return (
        F.when(role == "id", F.concat(F.lit("Identifier column, "), F.round("completeness", 0).cast("int").cast("string"), F.lit("% complete with "), text(F.col("distinct")), F.lit(" unique values")))
        .when((role == "boolean") & truth.isNull(), "Binary flag column")
        .when(role == "boolean", F.concat(F.lit("Binary flag, "), F.round(truth * 100, 1).cast("string"), F.lit("% true, "), missing))
        .when(role == "category", F.concat(text(F.col("distinct")), F.lit(" categories, "), text(top_share), F.lit("% are '"), text(top), F.lit("'")))
        .when(role == "datetime", F.coalesce(spans, F.lit("Temporal column")))
        .when(role == "free_text", F.concat(F.lit("Free-form text, avg "), F.coalesce(F.round("avg_len", 0).cast("int"), F.lit(0)).cast("string"), F.lit(" chars, "), missing))
        .otherwise(F.concat(shape, F.lit(" distribution (range "), text(F.coalesce(F.col("low").cast("string"), F.col("low_text"))), F.lit(" to "), text(F.coalesce(F.col("high").cast("string"), F.col("high_text"))), F.lit(")"), outliers))
    )


def in_context(issue: Column, role: Column) -> Column:
    """What an issue means for the role of its column."""
    has = lambda s: F.lower(issue).contains(s)
    # The sentences are fixed values.
    missing = (
        F.when(role == "id", " - critical for an ID column, investigate data pipeline integrity")
        .when(role == "category", " - may introduce bias in categorical analysis")
        .when(role == "measure", " - consider imputation strategy before aggregation")
        .when(role == "free_text", " - acceptable for text fields, low impact")
        .otherwise("")
    )
    more = (
        F.when(has("missing"), missing)
        .when(has("outlier"), " - verify these are real values, not data entry errors")
        .when(has("near-constant"), " - provides no analytical value, consider dropping")
        .when(has("entirely null"), " - column should be removed or data source investigated")
        .otherwise("")
    )
    return F.concat(issue, more)


def enhanced(table: DataFrame | Statistics) -> DataFrame:
    """The profile with roles, insights and issues in context."""
    s = statistics.of(table)
    base = roles(s).join(basics(s).select("pos", "outliers", "distribution"), "pos")
    top = top_values(s, 1).select("column", F.col("value").alias("top"), F.col("dominant_pct").alias("top_share"))
    dates = datetime_insights(s).select("column", F.concat(F.initcap("frequency"), F.lit(" data spanning "), "range_start", F.lit(" to "), "range_end").alias("spans"))
    all_ = base.join(top, "column", "left").join(dates, "column", "left")
    found = issues()
    return all_.select("column", "kind", "role", "total", "nulls", "completeness", "distinct", insight(F.col("role"), F.col("truth"), F.col("top"), F.col("top_share"), F.col("spans")).alias("insight"), F.transform(found, lambda x: in_context(x, F.col("role"))).alias("anomalies"))
