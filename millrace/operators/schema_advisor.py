"""Recommended schema of a table: types, keys, constraints, hints, DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import profile, statistics
from millrace.operators.statistics import Statistics

GEO_NAMES = ["lat", "latitude", "lng", "lon", "long", "longitude", "x_coord", "y_coord"]  # fixed values
GEO_PARTS = "latitude|longitude|lat_|lng_|_lat|_lng"
#: Spark's counterpart of a recommended type.
SPARK_TYPES = {"BOOLEAN": "boolean", "TIMESTAMPTZ": "timestamp", "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE PRECISION": "double"}


def recommended(table: DataFrame | Statistics) -> DataFrame:
    """One row for each column, in order: type, nullable, primary key, unique, check. Without an identifier an ``id`` comes first."""
    rows = profile.roles(table).withColumn("decimals", F.when(F.col("kind") == "float", F.col("decimals")))
    name, kind, role, low, high = F.lower("column"), F.col("kind"), F.col("role"), F.col("low"), F.col("high")
    geo = F.regexp_replace(name, " ", "_").isin(GEO_NAMES) | name.rlike(GEO_PARTS)
    precision = F.length(F.floor(F.abs(high)).cast("string")) + F.col("decimals")
    length = F.col("max_len")
    type_ = (
        F.when(geo, "DOUBLE PRECISION")
        .when(role == "boolean", "BOOLEAN")
        .when(role == "datetime", "TIMESTAMPTZ")
        .when((kind == "integer") & low.between(-32768, 32767) & high.between(-32768, 32767), "SMALLINT")
        .when((kind == "integer") & (low.isNull() | (low.between(-2147483648, 2147483647) & high.between(-2147483648, 2147483647))), "INTEGER")
        .when(kind == "integer", "BIGINT")
        .when((kind == "float") & (F.col("decimals") <= 4) & (precision <= 12), F.concat(F.lit("NUMERIC("), precision.cast("string"), F.lit(","), F.col("decimals").cast("string"), F.lit(")")))
        .when(kind == "float", "DOUBLE PRECISION")
        .when((kind == "text") & ((role == "free_text") | (length > 255)), "TEXT")
        .when((kind == "text") & (length <= 10), "VARCHAR(16)")
        .when((kind == "text") & (length <= 50), "VARCHAR(64)")
        .when((kind == "text") & (length <= 100), "VARCHAR(128)")
        .when(kind == "text", "VARCHAR(255)")
        .otherwise("TEXT")
    )
    may_key = (role == "id") & ~geo & (name.rlike("id|key|code") | (kind == "integer"))
    first = F.min(F.when(may_key, F.col("pos"))).over(Window.partitionBy(F.lit(1)))  # one row per column
    rows = rows.select("pos", "column", "kind", "role", "total", "distinct", "nulls", "low", geo.alias("geo"), type_.alias("type"), first.alias("key_pos"))
    key = F.coalesce(F.col("pos") == F.col("key_pos"), F.lit(False))
    # until a key is found, an identifier that can't be one isn't unique either way: it is
    unique = (F.col("role") == "id") & ~F.col("geo") & ~key
    check = F.when((F.col("role") == "measure") & F.col("kind").isin("integer", "float") & ~F.col("geo") & (F.col("low") >= 0), F.concat(F.lit('"'), "column", F.lit('" >= 0')))
    out = rows.select("pos", "column", "role", "type", ((F.col("nulls") > 0) & ~key).alias("nullable"), key.alias("primary_key"), unique.alias("is_unique"), check.alias("check"), "total", "distinct")
    none = out.agg(F.max("primary_key").alias("any")).where("NOT any").selectExpr("-1 AS pos", "'id' AS column", "'id' AS role", "'SERIAL' AS type", "false AS nullable", "true AS primary_key", "false AS is_unique", "CAST(NULL AS STRING) AS check", "CAST(0 AS BIGINT) AS total", "CAST(0 AS BIGINT) AS distinct")
    return none.unionByName(out)


def table_columns(table: DataFrame | Statistics) -> DataFrame:
    spark = F.create_map(*(F.lit(x) for kv in SPARK_TYPES.items() for x in kv))
    native = F.when(F.col("type").startswith("NUMERIC"), F.regexp_replace(F.lower("type"), "numeric", "decimal")).when(F.col("type") == "SERIAL", "bigint").otherwise(F.coalesce(F.try_element_at(spark, F.col("type")), F.lit("string")))
    return recommended(table).select("pos", "column", "role", "type", native.alias("spark_type"), "nullable", "primary_key", "is_unique", "check")


def fk_hints(table: DataFrame | Statistics) -> DataFrame:
    """column, references_table and confidence."""
    rows = recommended(table).where("pos >= 0")
    name = F.lower("column")
    stem = name
    for part in ("_id", "id_", "_key", "_code"):
        stem = F.replace(stem, F.lit(part), F.lit(""))
    named = (F.col("role") == "id") & (name != "id") & (stem != "") & (stem != name)
    few = (F.col("role") == "category") & (F.col("distinct") < 20) & (F.try_divide("total", "distinct") > 5)
    plural = lambda c: F.concat(F.rtrim(c, F.lit("s")), F.lit("s"))
    return rows.where(named | few).select("column", F.when(named, plural(stem)).otherwise(plural(name)).alias("references_table"), F.lit("id").alias("references_column"), F.when(named, 0.8).otherwise(0.5).alias("confidence"))


def normalization_hints(table: DataFrame | Statistics) -> DataFrame:
    """Categories with few values, which could be a table of their own."""
    rows = recommended(table).where("pos >= 0 AND role = 'category' AND distinct <= 20 AND total > 50 AND try_divide(total, distinct) > 10")
    return rows.select("column", F.col("distinct").alias("unique_values"), F.col("total").alias("total_rows"))


def ddl(df: DataFrame | Statistics, name: str) -> DataFrame:
    """One row: the CREATE TABLE text with suggested foreign keys as comments."""
    table = statistics.of(df)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    flags = [F.when(~F.col("nullable"), "NOT NULL"), F.when(F.col("primary_key"), "PRIMARY KEY").when(F.col("is_unique"), "UNIQUE"), F.when(F.col("check").isNotNull(), F.concat(F.lit("CHECK ("), "check", F.lit(")")))]
    line = F.concat_ws(" ", F.concat(F.lit("    "), quoted(F.col("column"))), "type", *flags)
    body = recommended(table).select("pos", line.alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), ",\n").alias("body"))
    keys = fk_hints(table).where("confidence >= 0.7").select(F.concat(F.lit(f'\n-- Suggested: ALTER TABLE "{name}" ADD FOREIGN KEY ('), quoted(F.col("column")), F.lit(") REFERENCES "), quoted(F.col("references_table")), F.lit(' ("id");')).alias("k"))
    tail = keys.agg(F.array_join(F.array_sort(F.collect_list("k")), "").alias("tail"))
    return body.crossJoin(tail).select(F.concat(F.lit(f'CREATE TABLE "{name}" (\n'), "body", F.lit("\n);"), "tail").alias("ddl"))
