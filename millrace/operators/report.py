"""The combined report: all sections of a table in one row, as JSON and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import layout_advisor, profile, quality, readiness, statistics


def rows_of(df: DataFrame) -> DataFrame:
    return df.agg(F.sort_array(F.collect_list(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).alias("rows"))


def safe(text: Column) -> Column:
    """Text for a cell of a table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def tenth(c: Column) -> Column:
    return F.round(c, 1).cast("decimal(18,1)").cast("string")


def lines_of(df: DataFrame, order: str, line: Column) -> DataFrame:
    """One row: the lines of all rows in their order. ``df`` has a row for each column or check."""
    return df.select(F.col(order).alias("o"), line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "").alias("text"))


def table_of(head: list[str], body: Column) -> Column:
    return F.concat(F.lit("| " + " | ".join(head) + " |\n|" + "---|" * len(head) + "\n"), body)


def combined(df: DataFrame, name: str) -> DataFrame:
    """name, report_json and report_markdown.

    The JSON has a list for each section. The Markdown has the number of rows and
    columns, a table of scores, a table of columns with the number of their issues,
    the recommended indexes with their SQL, and the checks.
    """
    s = statistics.of(df)
    score, columns, indexes, checks = quality.score(s), profile.columns_report(s), layout_advisor.recommend(s, name), readiness.checks(s)
    parts = {"score": score, "columns": columns, "indexes": indexes, "checks": checks}
    out = df.sparkSession.range(1).select(F.lit(name).alias("name"))
    for key, part in parts.items():
        out = out.crossJoin(F.broadcast(rows_of(part).toDF(key)))
    cell = lambda *xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |\n"))
    scores = F.concat(*(cell(F.lit(d), tenth(F.col(d))) for d in quality.DIMENSIONS))
    head = score.select(
        F.concat(F.lit(f"# Report: {name}\n\n"), F.col("rows").cast("string"), F.lit(f" rows, {len(s.cols)} columns\n\n## Quality: "), tenth(F.col("overall")), F.lit(" of 100\n\n"), table_of(["Dimension", "Score"], scores)).alias("text")
    )
    places = F.create_map(*(x for c in s.cols for x in (F.lit(c.name), F.lit(c.pos)))) if s.cols else F.lit(0)
    each = lines_of(columns.withColumn("pos", places[F.col("column")]), "pos", cell(safe(F.col("column")), F.col("kind"), F.concat(F.col("completeness").cast("string"), F.lit("%")), F.col("unique_count").cast("string"), F.size("issues").cast("string")))
    advice = lines_of(indexes, "rank", F.concat(F.lit("### "), safe(F.col("column")), F.lit(": "), F.col("index_type"), F.lit(" ("), F.col("priority"), F.lit(")\n\n"), F.col("reason"), F.lit("\n\n```sql\n"), F.col("sql"), F.lit("\n```\n\n")))
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    checked = lines_of(checks, "check", F.concat(F.lit("- "), F.when(F.col("passed"), "passed").otherwise("failed"), F.lit(": **"), F.col("name"), F.lit("** ("), value, F.lit(")"), F.coalesce(F.concat(F.lit(". "), F.col("suggestion")), F.lit("")), F.lit("\n")))
    ready = checks.agg(F.round(F.avg(F.col("passed").cast("double")) * 100, 0).cast("int").cast("string").alias("share"))
    texts = {"head": head, "each": each, "advice": advice, "checked": checked}
    for key, part in texts.items():
        out = out.crossJoin(F.broadcast(part.toDF(f"{key}_text")))
    out = out.crossJoin(F.broadcast(ready))
    body = F.concat(*(F.concat(F.lit(f'{"," if k else "{"}"{key}":['), F.array_join(key, ","), F.lit("]")) for k, key in enumerate(parts)), F.lit("}"))
    advised = F.when(F.col("advice_text") == "", "").otherwise(F.concat(F.lit("\n## Indexes\n\n"), F.col("advice_text")))
    text = F.concat(F.col("head_text"), F.lit("\n## Columns\n\n"), table_of(["Column", "Kind", "Complete", "Distinct", "Issues"], F.col("each_text")), advised, F.lit("\n## Readiness: "), F.col("share"), F.lit("%\n\n"), F.col("checked_text"))
    return out.select("name", body.alias("report_json"), text.alias("report_markdown"))
