"""CSV and JSON tables, samples, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.columns import columns, ref

# Fixed values
MOST_ROWS = 50_000  # of a capped read

# Texts that mean a missing value; fixed values.
NULL_TOKENS = ["", "#N/A", "#NA", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>", "-nan", "-NaN", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN"]
#: Members that usually hold the records of a document, in order of preference; fixed values.
RECORD_KEYS = ["data", "results", "records", "items", "rows", "entries"]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def load_csv(spark: SparkSession, path: str, encoding: str = "utf-8", sample_size: int | None = None) -> DataFrame:
    """A CSV table with a header and inferred types; usual texts for missing values become null."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.csv(path, header=True, encoding=encoding)
    # tokens go before types are inferred, so that they don't turn numbers into text
    plain = raw.select(*(F.when(~F.trim(ref(c)).isin(NULL_TOKENS), ref(c)).alias(c) for c in raw.columns))
    types = spark.read.csv(path, header=True, encoding=encoding, inferSchema=True, nullValue="NA").schema
    out = plain.select(*(ref(f.name).try_cast(f.dataType).alias(f.name) for f in types))
    return sample(out, sample_size) if sample_size else out


def load_json(spark: SparkSession, path: str, record_path: str | None = None, sample_size: int | None = None, lines: bool = False, records: bool = False) -> DataFrame:
    """A JSON table: one record per line (splittable), a top-level array, or records under a member.

    ``records``: without a path, a file of a single object is searched for its records
    as in ``locate``; one that holds none is a table of one record.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = spark.read.json(path, multiLine=not lines)
    if record_path:
        out = extract_records(raw, record_path)
    elif records and records_in(raw.schema) and len(raw.take(2)) == 1:
        out = extract_records(raw)
    else:
        out = raw
    return sample(out, sample_size) if sample_size else out


def is_records(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)


def records_in(schema: T.StructType) -> list[str] | None:
    """The path of the first array of records: under a usual key, in an object under one, or under any member."""
    for key in RECORD_KEYS:
        if key in schema.names:
            t = schema[key].dataType
            if is_records(t):
                return [key]
            if isinstance(t, T.StructType):
                inner = [f.name for f in t if is_records(f.dataType)]
                if inner:
                    return [key, inner[0]]
    inner = [f.name for f in schema if is_records(f.dataType)]
    return inner[:1] or None


def locate(schema: T.StructType, record_path: str | None = None) -> list[str] | None:
    """The path of the array of records in a schema; None if the rows are the records themselves."""
    if record_path:
        at: T.DataType = schema
        for part in record_path.split("."):
            if not isinstance(at, T.StructType) or part not in at.names:
                raise ValueError(f"no member {part} of {record_path}; there are {', '.join(at.names) if isinstance(at, T.StructType) else 'none'}")
            at = at[part].dataType
        if not is_records(at):
            raise ValueError(f"{record_path} holds no records")
        return record_path.split(".")
    found = records_in(schema)
    if found:
        return found
    if any(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in schema):
        raise ValueError(f"no records found; members are {', '.join(schema.names)}")
    return None


def extract_records(df: DataFrame, record_path: str | None = None) -> DataFrame:
    """One row for each record of documents that hold them under a member."""
    path = locate(df.schema, record_path)
    if path is None:
        return df
    return df.select(F.explode(F.col(".".join(f"`{p}`" for p in path))).alias("r")).select("r.*")


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested objects become columns named by their path; arrays stay."""

    def leaves(t: T.StructType, path: list[str]) -> list:
        out = []
        for f in t:
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, [*path, f.name])
            else:
                out.append(F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(sep.join([*path, f.name])))
        return out

    return df.select(*leaves(df.schema, []))


def flatten_json(df: DataFrame, column: str, sep: str = "_", schema: str | T.StructType | None = None) -> DataFrame:
    """A column of JSON text becomes columns; the schema comes from the data where none is given."""
    if schema is None:
        # the types of all rows are merged, as an aggregation
        found = df.agg(F.call_function("schema_of_variant_agg", F.try_parse_json(ref(column)))).first()[0]
        schema = found.replace("OBJECT<", "STRUCT<")
    rest = [ref(c) for c in df.columns if c != column]
    return flatten(df.select(*rest, F.from_json(ref(column), schema).alias(column)), sep)


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows where there are more, the same whatever the partitions: those with the smallest hashes of the whole row.

    A threshold that follows the number of rows leaves about twice as many as are
    wanted, and only these are put in order.
    """
    draw = F.xxhash64(*(ref(c.name) for c in columns(df)), F.lit(seed))
    total, wanted = df.count(), 2 * n + 100
    own = df
    while wanted < total:
        own = df.where(draw <= -(1 << 63) + (1 << 64) * wanted // total)
        if own.count() >= n:
            break
        own, wanted = df, 4 * wanted
    return own.orderBy(draw, *(ref(c.name) for c in columns(df, "integer", "float", "text", "boolean", "temporal"))).limit(n)


def capped(df: DataFrame, limit: int = 5_000) -> DataFrame:
    """At most ``limit`` rows (and never more than the configured number); an empty table raises."""
    if df.isEmpty():
        raise ValueError("no rows")
    return df.limit(min(limit, MOST_ROWS))


def preview(df: DataFrame, rows: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first rows (at most 50) as text, nulls empty, and the number of all rows."""
    total = df.agg(F.count("*").alias("_total"))
    first = df.orderBy(*(ref(c) for c in order_by)) if order_by else df
    shown = [F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    return first.limit(min(rows, 50)).select(*shown).crossJoin(F.broadcast(total))


def info(df: DataFrame, name: str) -> DataFrame:
    """Rows, number of columns and their names."""
    return df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("name"), "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(",".join(df.columns)).alias("columns"))


def save_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV files with headers."""
    df.write.mode(mode).csv(path, header=True)
