"""Reports against independent pandas computations, on edge frames and for any partitioning."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.columns import normal
from millrace.operators import correlation, drilldown, geo, layout_advisor, ordering, profile, quality, readiness, report, schema_advisor, stats, timeseries

ISSUES = "price double, name string, age string, score double"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(42)
    n = 1000
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "price": rng.lognormal(3, 1, n),
            "category": rng.choice(list("ABCD"), n),
            "rating": rng.uniform(1, 5, n),
            "missing_col": [None if k % 10 == 0 else float(k) for k in range(n)],
            "constant": ["same"] * n,
        }
    )
    return pdf, spark.createDataFrame(pdf)


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_profile_matches_pandas(frame):
    pdf, df = frame
    got = by_column(profile.columns_report(df.repartition(8)))
    assert got == by_column(profile.columns_report(df.coalesce(1)))
    for c in ("id", "price", "rating", "missing_col"):
        s = pdf[c].dropna()
        r = got[c]
        assert (r.nulls, r.unique_count) == (pdf[c].isna().sum(), s.nunique())
        assert math.isclose(r.mean, round(s.mean(), 4), abs_tol=1e-4) and math.isclose(r["std"], round(s.std(), 4), abs_tol=1e-4)
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        assert r.outliers == ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    assert got["missing_col"].completeness == 90.0 and got["missing_col"].nulls == 100
    assert got["price"].distribution == "right_skewed" and got["constant"].distribution == "categorical"
    assert "possible ID column (all values unique)" in got["id"].issues and "near-constant column" in got["constant"].issues


def test_moments_match_pandas(frame):
    pdf, df = frame
    for r in stats.moments(normal(df)).collect():
        assert math.isclose(r.g1, pdf[r.column].skew(), rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.g2, pdf[r.column].kurt(), rel_tol=1e-9, abs_tol=1e-9)


def test_quantiles_are_exact_for_any_partitioning(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 100, 5000), 1)
    x[:1700] = 7.5  # a value with a third of the rows
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    ps = [0, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1]
    for parts in (1, 8):
        row = stats.quantiles(stats.frequency(df.repartition(parts)), ps).first()
        assert np.allclose([row[f"q{k}"] for k in range(len(ps))], np.quantile(x, ps))


def test_edge_frames(spark):
    schema = "i int, f double, s string, b boolean, t timestamp, a array<int>, `odd name.x` double"
    empty = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(None,) * 7] * 3, schema)
    one = spark.createDataFrame([(1, 2.0, "x", True, None, [1], float("nan"))], schema)
    odd = spark.createDataFrame([(1, float("inf"), "x", True, None, [1], float("nan")), (1, float("nan"), "", False, None, None, None), (1, 3.0, " X", None, None, [], 1.0)], schema)
    for df in (empty, nulls, one, odd):
        assert profile.roles(df).count() == 7
        if df is nulls or df is one:
            continue
        assert profile.columns_report(df).count() == 7
        assert len(quality.dimensions(df).collect()) == 5
        assert readiness.checks(df).count() == 7
        assert correlation.matrix(df).count() == 3
        correlation.functional_dependencies(df).collect()
        schema_advisor.table_columns(df).collect()
        layout_advisor.recommend(df, "t").collect()
        quality.issues(df).collect()
    assert by_column(profile.columns_report(odd))["odd name.x"].nulls == 2
    assert {r.issue for r in quality.validity_issues(normal(odd)).collect()} == {"1 infinite values", "1 empty strings (not null)"}


def test_gaps_and_row_numbers_match_pandas(spark):
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    at = sorted(base + pd.to_timedelta(rng.integers(0, 5000, 2000), unit="min"))
    pdf = pd.DataFrame({"ts": at, "v": rng.normal(size=2000)}).sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf).repartition(5)
    want = pdf.ts.sort_values().diff().dropna().dt.total_seconds().value_counts().sort_index()
    got = ordering.gaps(df, F.col("ts")).groupBy("gap").agg(F.sum("n").alias("n")).orderBy("gap").collect()
    assert [(r.gap / 1e6, r.n) for r in got] == [(k, v) for k, v in want.items()]
    rows = ordering.numbered(df.select(ordering.micros(F.col("ts")).alias("us"), "v"), "us", ["v"]).orderBy("idx").collect()
    sorted_ = pdf.sort_values(["ts", "v"])
    assert [r.idx for r in rows] == list(range(2000)) and np.allclose([r.v for r in rows], sorted_.v)


def test_no_window_over_all_rows(spark, sf_dir):
    """Only tables of one row per range or column may meet in one partition."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = ordering.gaps(lineitem, F.col("l_shipdate"))._jdf.queryExecution().executedPlan().toString()
    data = [line for line in plan.split("\n") if "SinglePartition" in line]
    assert len(data) <= 3  # split points (for both uses of the ranges), and one row per range


def test_drilldown(frame):
    pdf, df = frame
    rows = drilldown.outlier_rows(df, "price", order_by=["id"]).collect()
    q1, q3 = pdf.price.quantile(0.25), pdf.price.quantile(0.75)
    out = pdf[(pdf.price < q1 - 1.5 * (q3 - q1)) | (pdf.price > q3 + 1.5 * (q3 - q1))]
    assert [int(r.id) for r in rows] == out.id.head(20).tolist()
    missing = drilldown.issue_rows(df, "missing_col", "missing", order_by=["id"]).collect()
    assert len(missing) == 50 and missing[0]["_count"] == 100
    dups = drilldown.issue_rows(df, "category", "duplicates", order_by=["id"]).collect()
    assert dups[0]["_count"] == 996 and [int(r.id) for r in dups] == pdf[pdf.category.duplicated()].id.head(50).tolist()


def test_correlation_with_nulls_and_constants(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None, 6], "b": [2.0, 4, 6, 8, 1, None], "c": [1.0] * 6, "d": [3, 1, 4, 1, 5, 9]})
    got = {(r.a, r.b): r.r for r in correlation.matrix(spark.createDataFrame(pdf)).collect()}
    want = pdf.corr().round(4)
    for (a, b), r in got.items():
        assert (r is None) == bool(pd.isna(want.loc[a, b])) and (r is None or math.isclose(r, want.loc[a, b], abs_tol=1e-4))
    assert correlation.redundant(spark.createDataFrame(pdf)).count() == 1


def test_dependencies(spark):
    rng = np.random.default_rng(5)
    city = rng.integers(0, 20, 500)
    pdf = pd.DataFrame({"city": [f"c{k}" for k in city], "state": [f"s{k // 4}" for k in city], "x": rng.normal(size=500), "gone": [None if k < 10 else "z" for k in city]})
    got = {(r.determinant, r.dependent) for r in correlation.functional_dependencies(spark.createDataFrame(pdf)).collect()}
    assert ("city", "state") in got and ("state", "city") not in got and ("city", "gone") in got


def test_time_series(spark):
    n = 400
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="D"), "v": 10 + np.sin(np.arange(n) * 2 * np.pi / 7) + np.arange(n) * 0.02})
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=2))
    row = timeseries.report(df, "ts", "v").first()
    assert (row.frequency, row.regular, row.gap_count, row.trend, row.seasonal, row.stationary) == ("daily", True, 0, "increasing", True, True)
    assert timeseries.seasonality(timeseries.ordered(df, "ts", "v")).first().period in (7, 14, 28)
    short = timeseries.report(df.limit(1), "ts", "v").first()
    assert (short.frequency, short.trend, short.seasonal) == ("insufficient_data", "flat", False)


def test_geo(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"lat": np.append(rng.normal(48, 0.01, 60), [0, 95, 60]), "lng": np.append(rng.normal(11, 0.01, 60), [0, 11, -120])})
    df = spark.createDataFrame(pdf)
    assert geo.coordinate_columns(df) == [("lat", "lng")]
    row = geo.report(df, [("lat", "lng")]).first()
    assert (row.total, row.usable, row.null_island, row.out_of_range_lat, row.outliers) == (63, 61, 1, 1, 1)
    paris_london = spark.range(1).select(geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)).alias("km")).first().km
    assert abs(paris_london - 343.6) < 1
    assert sum(r["size"] for r in geo.clusters(df, "lat", "lng").collect()) == 61


def test_readiness_and_small_tables(spark, frame):
    small = readiness.checks(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")).where("name = 'Data Size'").first()
    assert (small.passed, small.severity) == (False, "critical")
    got = {r["name"]: r.passed for r in readiness.checks(frame[1]).collect()}
    assert got == {"Missing Values": True, "Class Imbalance": True, "Constant Columns": False, "High Cardinality": True, "Feature Correlation": False, "Target Leakage": True, "Data Size": True}


def test_schema_and_layout(spark):
    n = 12_000
    pdf = pd.DataFrame({"id": range(n), "category": ["ABCDE"[k % 5] for k in range(n)], "price": np.round(np.linspace(1, 99, n), 2), "tags": ['["a"]'] * (n - 1) + ['["b"]'], "constant": [1] * n})
    df = spark.createDataFrame(pdf)
    types = {r["column"]: r for r in schema_advisor.table_columns(df).collect()}
    assert (types["id"].type, types["id"].primary_key, types["price"].type, types["category"].type) == ("SMALLINT", True, "NUMERIC(4,2)", "VARCHAR(16)")
    advice = {r["column"]: (r.index_type, r.priority) for r in layout_advisor.recommend(df, "t", order_by="id").collect()}
    assert advice["tags"] == ("GIN", "high") and advice["id"] == ("BRIN", "high") and "constant" not in advice
    assert "id" not in {r["column"] for r in layout_advisor.recommend(df, "t", exclude=("id",)).collect()}
    assert 'CREATE TABLE "t"' in schema_advisor.ddl(df, "t").first().ddl
    row = report.combined(df.limit(100), "t").first()
    assert pd.io.json.ujson_loads(row.report_json).keys() == {"score", "columns", "indexes", "checks"}
