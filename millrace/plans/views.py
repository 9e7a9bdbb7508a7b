"""Views with missing values, duplicates and outliers over the given tables; the same text runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

VIEWS = {
    "dirty_lineitem": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_tax,
  CASE WHEN l_orderkey % 25 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate FROM lineitem""",
    "dup_orders": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 20 = 0",
    "dirty_customer": """
SELECT c_custkey, c_name,
  CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 0 THEN concat(' ', c_mktsegment)
       WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 50 = 0 THEN 'bad' ELSE CAST(c_nationkey AS VARCHAR(10)) END AS c_nation_text,
  CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS is_vip, 7 AS constant_col FROM customer""",
    "geo_customer": """
SELECT c_custkey,
  CASE WHEN c_custkey % 500 = 0 THEN 0e0 WHEN c_custkey % 333 = 0 THEN 95e0
       WHEN c_custkey % 401 = 0 THEN 60e0 ELSE 1e0 + CAST((c_custkey * 37) % 1000 AS DOUBLE) / 1000e0 END AS latitude,
  CASE WHEN c_custkey % 500 = 0 THEN 0e0 WHEN c_custkey % 401 = 0 THEN -120e0
       ELSE 103e0 + CAST((c_custkey * 53) % 1000 AS DOUBLE) / 1000e0 END AS longitude FROM customer""",
    "gap_events": """
SELECT date_trunc('hour', ts) AS ts, count(*) AS n, sum(value) AS value FROM events
  WHERE NOT (ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00')
  GROUP BY date_trunc('hour', ts)""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of its own."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])]
    text = re.sub(rf"\b({'|'.join(used)})\b", r"{\1}", VIEWS[name])
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_view(name: str, sql: str) -> str:
    """SQL over ``v``, which stands for the view or table."""
    return f"WITH v AS ({VIEWS.get(name, f'SELECT * FROM {name}')})\n{sql}"
