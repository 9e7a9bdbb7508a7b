"""Quality on five weighted dimensions, with the issues behind each score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.columns import ref
from millrace.operators import ordering, profile, statistics, stats
from millrace.operators.statistics import Statistics
from millrace.sources import folders

# Fixed values
WEIGHTS = {"completeness": 0.25, "consistency": 0.20, "uniqueness": 0.20, "validity": 0.20, "timeliness": 0.15}  # of the dimensions in the score

DIMENSIONS = ["completeness", "consistency", "uniqueness", "validity", "timeliness"]
#: Weight of a missing value by the role of its column; fixed values.
NULL_WEIGHT = {"id": 5.0, "category": 1.5, "measure": 1.0, "datetime": 2.0, "boolean": 1.0, "free_text": 0.3}


# The words of the issues below are fixed values.


def found(rows: DataFrame, dimension: str, when: Column, text: Column) -> DataFrame:
    return rows.where(when).select(F.lit(dimension).alias("dimension"), "column", text.alias("issue"))


def completeness_issues(table: DataFrame | Statistics) -> DataFrame:
    share = F.try_divide(F.col("nulls") * 100.0, F.col("total"))
    rows = table.columns if isinstance(table, Statistics) else stats.counts(table)
    return found(rows, "completeness", share > 5, F.concat(F.round(share, 1).cast("string"), F.lit("% missing")))


def consistency_issues(table: DataFrame | Statistics) -> DataFrame:
    t = statistics.of(table).columns.where("kind = 'text' AND filled > 0")
    same_length = (F.col("min_len") == F.col("max_len")) & (F.col("distinct") > 1)
    return stats.union(
        [
            found(t, "consistency", F.col("mixed_case"), F.lit("mixed case formatting")),
            found(t, "consistency", F.col("spaced"), F.lit("inconsistent whitespace")),
            found(t, "consistency", ~same_length & (F.col("digit_share") > 0.5) & F.col("letters"), F.lit("mixed numeric and text values")),
        ]
    )


def duplicates(df: DataFrame) -> DataFrame:
    """total and dups: rows, and rows that equal an earlier one (nulls equal each other)."""
    return df.groupBy(*(ref(c) for c in df.columns)).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("dups"))


def uniqueness_issues(table: DataFrame | Statistics, repeated: DataFrame | None = None) -> DataFrame:
    """``repeated``: what ``duplicates`` returns, where it is known."""
    s = statistics.of(table)
    repeated = duplicates(s.df) if repeated is None else repeated
    whole = repeated.where("dups > 0").select(F.lit("uniqueness").alias("dimension"), F.lit("").alias("column"), F.concat(F.col("dups").cast("string"), F.lit(" duplicate rows")).alias("issue"))
    each = s.columns.where(F.col("kind").isin("text", "boolean", "temporal"))
    repeats = F.col("total") - F.col("distinct") - F.when(F.col("nulls") > 0, 1).otherwise(0)
    low = found(each, "uniqueness", (F.try_divide(repeats * 100.0, F.col("total")) > 80) & (F.col("distinct") < 5), F.concat(F.lit("very low cardinality ("), F.col("distinct").cast("string"), F.lit(" unique values)")))
    return whole.unionByName(low)


def validity_issues(table: DataFrame | Statistics) -> DataFrame:
    rows = statistics.of(table).columns.where("filled > 0")
    n, t = rows.where("kind IN ('integer', 'float')"), rows.where("kind = 'text'")
    return stats.union(
        [
            found(n, "validity", F.col("low") < -1e10, F.lit("suspicious extreme negative values")),
            found(n, "validity", F.col("infinite") > 0, F.concat(F.col("infinite").cast("string"), F.lit(" infinite values"))),
            found(n, "validity", (F.col("zeros") > 0.9 * F.col("filled")) & (F.col("filled") > 100), F.lit("mostly zeros - possibly missing data encoded as 0")),
            found(t, "validity", F.col("empty") > 0, F.concat(F.col("empty").cast("string"), F.lit(" empty strings (not null)"))),
        ]
    )


def large_gaps(gaps: DataFrame) -> DataFrame:
    """One row: n gaps in all, and large: those over three times the median gap."""
    sizes = gaps.groupBy("gap").agg(F.sum("n").alias("n"))
    median = stats.quantiles(sizes.select(F.lit(0).alias("pos"), F.col("gap").cast("double").alias("num"), "n"), [0.5]).select("q0")
    return sizes.crossJoin(F.broadcast(median)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("gap") > 3 * F.col("q0"), F.col("n"))), F.lit(0)).alias("large"))


def timeliness_issues(table: DataFrame | Statistics) -> DataFrame:
    s = statistics.of(table)
    if not s.temporal:
        return s.df.sparkSession.sql("SELECT 'timeliness' AS dimension, '' AS column, 'No temporal columns found for timeliness check' AS issue")
    parts = []
    for name in s.temporal[:3]:
        times = s.times(name)
        span = times.agg(F.floor((F.max("at") - F.min("at")) / 86_400_000_000).alias("days")).withColumn("column", F.lit(name))
        parts.append(found(span, "timeliness", F.col("days") == 0, F.lit("all dates are the same")))
        gaps = large_gaps(ordering.gaps_of(times)).withColumn("column", F.lit(name))
        parts.append(found(gaps, "timeliness", (F.col("n") > 1) & (F.col("large") > 0), F.concat(F.col("large").cast("string"), F.lit(" unusual temporal gaps detected"))))
    return stats.union(parts)


def parts(table: DataFrame | Statistics) -> tuple[Statistics, DataFrame, DataFrame]:
    """The statistics, the duplicate counts and all issues (dimension, column, issue), stored: the table is read for the statistics and for duplicates, and not again."""
    s = statistics.of(table)
    repeated = folders.stored(duplicates(s.df), "duplicates")
    return s, repeated, folders.stored(stats.union([completeness_issues(s), consistency_issues(s), uniqueness_issues(s, repeated), validity_issues(s), timeliness_issues(s)]), "issues")


def issues(table: DataFrame | Statistics) -> DataFrame:
    """dimension, column and issue."""
    return parts(table)[2]


def scores(s: Statistics, repeated: DataFrame, all_issues: DataFrame) -> DataFrame:
    """One row with the five scores (0 to 100) and the number of rows."""
    filled = F.col("filled") > 0
    texts, numbers = (F.col("kind") == "text") & filled, F.col("kind").isin("integer", "float") & filled
    cells = s.columns.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("x"), F.count(F.when(texts, 1)).alias("texts"), F.count(F.when(texts | numbers, 1)).alias("checks"), F.coalesce(F.max("total"), F.lit(0)).alias("rows"))
    of = lambda d: F.col("dimension") == d
    lost = F.when(F.col("issue").startswith("all dates"), 10).when(F.col("column") == "", 20).otherwise(5)
    bad = all_issues.agg(F.count(F.when(of("consistency"), 1)).alias("inconsistent"), F.count(F.when(of("validity"), 1)).alias("invalid"), F.coalesce(F.sum(F.when(of("timeliness"), lost)), F.lit(0)).alias("late"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    each = {
        "completeness": share((F.col("n") - F.col("x")) * 100.0, F.col("n")),
        "consistency": F.greatest(F.lit(0.0), 100 - share(F.col("inconsistent").cast("double"), F.col("texts")) * 50),
        "uniqueness": F.coalesce(F.try_divide((F.col("total") - F.col("dups")) * 100.0, F.col("total")), F.lit(100.0)),
        "validity": F.greatest(F.lit(0.0), 100 - share(F.col("invalid").cast("double"), F.col("checks")) * 30),
        "timeliness": F.greatest(F.lit(0.0), 100.0 - F.col("late")),
    }
    return cells.crossJoin(F.broadcast(bad)).crossJoin(F.broadcast(repeated)).select(*(F.round(c.cast("double"), 2).alias(d) for d, c in each.items()), "rows")


def dimensions(table: DataFrame | Statistics) -> DataFrame:
    """dimension and score (0 to 100)."""
    row = scores(*parts(table))
    return row.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in DIMENSIONS))).alias("x")).select("x.*")


def score(table: DataFrame | Statistics) -> DataFrame:
    """overall, the five scores, rows, and the five least complete columns."""
    s, repeated, all_issues = parts(table)
    overall = sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0))
    worst = s.columns.agg(F.slice(F.array_sort(F.collect_list(F.struct("completeness", "pos", "column"))), 1, 5).alias("w"))
    return scores(s, repeated, all_issues).crossJoin(F.broadcast(worst)).select(F.round(overall, 2).alias("overall"), *DIMENSIONS, "rows", F.array_join(F.transform("w", lambda x: x["column"]), ",").alias("worst_columns"))


def detailed(table: DataFrame | Statistics) -> DataFrame:
    """dimension, rank, column, role, issue, severity and impact (points of the overall score): at most ten for each dimension."""
    s, repeated, all_issues = parts(table)
    cols = len(s.cols)
    base = profile.roles(s)
    share = F.try_divide(F.col("nulls") * 100.0, F.col("total"))
    weight = F.create_map(*(F.lit(x) for kv in NULL_WEIGHT.items() for x in kv))[F.col("role")]
    severity = F.when(share * weight > 25, "critical").when(share * weight > 10, "warning").otherwise("info")
    missing = base.where(share > 2).select(
        F.lit("completeness").alias("dimension"), "pos", "column", "role", F.concat(F.round(share, 1).cast("string"), F.lit("% missing")).alias("issue"), severity.alias("severity"), F.round(share * weight * 0.25 / cols, 1).alias("impact")
    )
    row = scores(s, repeated, all_issues)
    each = row.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in DIMENSIONS))).alias("x")).select("x.*")
    rest = all_issues.where("dimension <> 'completeness'").join(each, "dimension").join(base.select("pos", "column", "role"), "column", "left")
    rest = rest.select("dimension", F.coalesce("pos", F.lit(-1)).alias("pos"), "column", F.coalesce("role", F.lit("measure")).alias("role"), "issue", F.lit("warning").alias("severity"), F.round((100 - F.col("score")) * 0.1, 1).alias("impact"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy("pos", "issue"))
    return missing.unionByName(rest).withColumn("rank", rank).where("rank <= 10").select("dimension", "rank", "column", "role", "issue", "severity", "impact")
