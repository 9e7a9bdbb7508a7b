"""Queries over the given tables: one for each operator, with DuckDB SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.columns import columns, normal
from millrace.operators import cleaning, correlation, drilldown, geo, layout_advisor, neighbours, ordering, profile, quality, readiness, report, schema_advisor, stats, timeseries
from millrace.plans import oracles as o
from millrace.plans.views import table, with_view
from millrace.sources import files, folders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, view: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Register a query over a table or view; ``sql`` reads it as v."""
    QUERIES[name] = lambda spark, sf_dir: run(table(spark, sf_dir, view))
    if sql is not None:
        ORACLES[name] = with_view(view, sql) if not sql.startswith(", ") else with_view(view, "").rstrip("\n") + sql


def r4(c: str | Column) -> Column:
    return F.round(c, 4)


def named(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with pos get their column's name."""
    names = F.create_map(*(x for c in columns(df) for x in (F.lit(c.pos), F.lit(c.name))))
    return rows.withColumn("column", names[F.col("pos")])


def quantile_rows(df: DataFrame) -> DataFrame:
    df = normal(df)
    names = ["p05", "p25", "p50", "p75", "p95"]
    return named(df, stats.column_quantiles(df, [0.05, 0.25, 0.5, 0.75, 0.95])).select("column", *(r4(f"q{k}").alias(n) for k, n in enumerate(names)))


def outlier_counts(df: DataFrame, method: str) -> DataFrame:
    df = normal(df)
    bounds = stats.fences(df)
    if method == "zscore":
        bounds = bounds.withColumns({"lower": F.col("mean") - 3 * F.col("std"), "upper": F.col("mean") + 3 * F.col("std")})
    return named(df, stats.outliers(df, bounds)).select("column", "outliers")


def with_text_issues(rows: DataFrame) -> DataFrame:
    return rows.withColumn("issues", F.array_join("issues", "; "))


L, C, O = "dirty_lineitem", "dirty_customer", "dup_orders"
N = o.number(o.LINEITEM)
T = [*o.of(o.LINEITEM, "text", "temporal")]

# Sources and shape
add("s4_flatten_json", "events", lambda df: files.flatten_json(df.select("event_id", "props"), "props", schema="k BIGINT"), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM v")
add("s5_sample", "lineitem", lambda df: files.sample(df, 1000))
add("s6_capped", "lineitem", lambda df: files.capped(df).agg(F.count("*").alias("rows")), "SELECT least(count(*), 5000) AS rows FROM v")
add("s10_preview", C, lambda df: files.preview(df, 50, ["c_custkey"]), "SELECT " + ", ".join(f"coalesce({c}::VARCHAR, '') AS {c}" for c in o.CUSTOMER) + ", (SELECT count(*) FROM v) AS _total FROM v ORDER BY v.c_custkey LIMIT 50")
add("s11_info", L, lambda df: files.info(df, "lineitem"), f"SELECT 'lineitem' AS name, count(*) AS row_count, {len(o.LINEITEM)} AS column_count, '{','.join(o.LINEITEM)}' AS columns FROM v")
add("s12_report", O, lambda df: report.combined(df, "orders"))


def csv_round_trip(df: DataFrame) -> DataFrame:
    path = folders.shared(df.sparkSession, "csv")
    files.save_csv(df.select("c_custkey", "c_nation_text", "c_acctbal", "is_vip"), path)
    return files.load_csv(df.sparkSession, path)


def json_round_trip(df: DataFrame) -> DataFrame:
    path = folders.shared(df.sparkSession, "json")
    df.select("o_orderpriority", F.array(F.struct("o_orderkey", "o_totalprice")).alias("items")).write.json(path)
    return files.extract_records(files.load_json(df.sparkSession, path, lines=True))


add("s1_s9_csv_round_trip", C, csv_round_trip, "SELECT c_custkey, nullif(c_nation_text, '') AS c_nation_text, c_acctbal, is_vip FROM v")
add("s2_s3_json_records", O, json_round_trip, "SELECT o_orderkey, o_totalprice FROM v")

# Column statistics
add("a1_completeness", L, lambda df: stats.counts(normal(df)).select("column", "total", "nulls", "completeness"), o.every(o.of(o.LINEITEM), f"count(*) AS total, count(*) - count({{c}}) AS nulls, {o.COMPLETE} AS completeness"))
add("a2_distinct", L, lambda df: named(df, stats.distincts(stats.frequency(df)).join(stats.counts(df).select("pos", "filled"), "pos")).select("column", F.col("distinct").alias("unique_count"), r4(F.col("distinct") / F.col("filled")).alias("unique_ratio")), o.every(o.of(o.LINEITEM), f"count(DISTINCT {{c}}) AS unique_count, round(({o.RATIO})::DECIMAL(20, 12), 4)::DOUBLE AS unique_ratio"))
# within three standard errors of the sketch
NEAR = 3 * 1.04 / 2**6
add("a2_approximate", L, lambda df: named(df, stats.distincts(stats.frequency(df)).join(stats.sketches(df).select("pos", F.hll_sketch_estimate("distinct_sketch").alias("about")), "pos")).select("column", F.col("distinct").alias("unique_count"), (F.abs(F.col("about") - F.col("distinct")) <= NEAR * F.col("distinct")).alias("within_bound")), o.every(o.of(o.LINEITEM), "count(DISTINCT {c}) AS unique_count, true AS within_bound"))
add("a3_moments", L, lambda df: stats.moments(normal(df)).select("column", r4("mean").alias("mean"), r4("std").alias("std"), F.col("low").alias("min_value"), F.col("high").alias("max_value")), o.every(N, "round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value"))
add("a4_text_range", L, lambda df: profile.ranges(df).select("column", F.col("low_text").alias("min_text"), F.col("high_text").alias("max_text")), o.every(T, "min({c})::VARCHAR AS min_text, max({c})::VARCHAR AS max_text"))
add("a5_samples", C, lambda df: profile.samples(df, ["c_custkey"]).select("column", F.array_join("samples", "|").alias("samples")), "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", string_agg(x, '|' ORDER BY k) AS samples FROM (SELECT c_custkey AS k, {c}::VARCHAR AS x FROM v WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5)" for c in o.CUSTOMER))
add("a6_quantiles", L, quantile_rows, o.every(N, ", ".join(f"round(quantile_cont({{c}}, {p}), 4) AS {n}" for n, p in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)))))
add("a6_quantiles_two_level", L, lambda df: named(df, stats.quantiles(stats.frequency(normal(df), columns(df, "integer", "float")), [0.25, 0.5])).select("column", r4("q0").alias("p25"), r4("q1").alias("p50")), o.every(N, "round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50"))
add("a7_distribution", L, lambda df: stats.moments(normal(df)).select("column", r4("g1").alias("skew"), r4("g2").alias("kurtosis"), stats.distribution(F.col("g1"), F.col("g2"), F.col("n")).alias("distribution")), o.every(N, f"round({o.G1}, 4) AS skew, round({o.G2}, 4) AS kurtosis, {o.SHAPE} AS distribution"))
add("a8_outliers_iqr", L, lambda df: outlier_counts(df, "iqr"), o.every(N, f"(SELECT count(*) {o.FENCE} WHERE {o.IQR_OUT}) AS outliers", ""))
add("a9_outliers_zscore", L, lambda df: outlier_counts(df, "zscore"), o.every(N, f"(SELECT count(*) {o.FENCE} WHERE {o.Z_OUT}) AS outliers", ""))
add("a10_issues", C, lambda df: with_text_issues(profile.columns_report(df)).select("column", "issues"), f'SELECT "column", issues FROM ({o.profile(o.CUSTOMER)})')
add("a11_profile_columns", "lineitem", lambda df: with_text_issues(profile.columns_report(df)), o.profile(o.LINEITEM))
add("a11_profile_dirty", L, lambda df: with_text_issues(profile.columns_report(df)), o.profile(o.LINEITEM))
add("a12_top_values", C, profile.top_values, "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {c} AS value, n, rank, round(first(n) OVER (ORDER BY rank) * 100.0 / t, 1) AS dominant_pct, round(first(n) OVER (ORDER BY rank) * 100.0 / t, 1) > 50 AS is_skewed FROM (SELECT {c}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, sum(count(*)) OVER () AS t FROM v WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 8" for c in o.of(o.CUSTOMER, "text")))
MEANING = "CASE shape " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in profile.INTERPRETATIONS.items()) + " END"
add("a13_numeric_insights", L, profile.numeric_insights, f"SELECT *, {MEANING} AS interpretation FROM ({o.every(N, f'round(quantile_cont({{c}}, 0.5), 4) AS median, round(max({{c}})::DOUBLE - min({{c}})::DOUBLE, 4) AS range_value, round({o.Q1}, 4) AS p25, round({o.Q3}, 4) AS p75, {o.SHAPE} AS shape')})")
add("a14_datetime_insights", "gap_events", profile.datetime_insights, o.gaps("ts") + f" SELECT 'ts' AS \"column\", min(tt)::DATE::VARCHAR AS range_start, max(tt)::DATE::VARCHAR AS range_end, max({o.CLASS}) AS frequency, count(*) FILTER (gap > 2 * mode) AS gap_count FROM g, m")
ROLE = "CASE WHEN count(DISTINCT {c}) <= 2 AND count({c}) > 0 THEN 'boolean' "
NUMBER_ROLE = ROLE + f"WHEN {o.RATIO} > 0.95 AND count(*) > 50 THEN 'id' ELSE 'measure' END AS role"
TEXT_ROLE = ROLE + f"WHEN {o.RATIO} > 0.95 AND count(*) > 50 THEN 'id' WHEN avg(length({{c}})) > 50 OR {o.RATIO} > 0.8 THEN 'free_text' ELSE 'category' END AS role"
ROLES_C = o.every(o.number(o.CUSTOMER), NUMBER_ROLE) + "\nUNION ALL\n" + o.every(o.of(o.CUSTOMER, "text"), TEXT_ROLE)
add("a15_roles", C, lambda df: profile.roles(df).select("column", "role"), ROLES_C)
TOP = "(SELECT {c} FROM v WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
MISSING = "round((count(*) - count({c})) * 100.0 / count(*), 1)::DOUBLE || '% missing'"
OUTSIDE = f"(SELECT count(*) {o.FENCE} WHERE {o.IQR_OUT})"
NUMBER_TEXT = (
    f"CASE role WHEN 'boolean' THEN 'Binary flag, ' || round(avg(({{c}} <> 0)::INT) * 100, 1)::DOUBLE || '% true, ' || {MISSING} WHEN 'id' THEN 'Identifier column, ' || CAST(round({o.COMPLETE}) AS INTEGER) || '% complete with ' || count(DISTINCT {{c}}) || ' unique values'"
    f" ELSE upper(replace({o.SHAPE}, '_', ' ')[1]) || replace({o.SHAPE}, '_', ' ')[2:] || ' distribution (range ' || min({{c}})::DOUBLE || ' to ' || max({{c}})::DOUBLE || ')' || CASE WHEN {OUTSIDE} > 0 THEN ', ' || {OUTSIDE} || ' outliers' ELSE '' END END"
)
TEXT_TEXT = (
    f"CASE role WHEN 'boolean' THEN 'Binary flag, ' || round(avg(({{c}} <> '')::INT) * 100, 1)::DOUBLE || '% true, ' || {MISSING} WHEN 'id' THEN 'Identifier column, ' || CAST(round({o.COMPLETE}) AS INTEGER) || '% complete with ' || count(DISTINCT {{c}}) || ' unique values'"
    f" WHEN 'free_text' THEN 'Free-form text, avg ' || CAST(round(avg(length({{c}}))) AS INTEGER) || ' chars, ' || {MISSING}"
    f" ELSE count(DISTINCT {{c}}) || ' categories, ' || round((SELECT count(*) FROM v WHERE {{c}} = {TOP}) * 100.0 / count({{c}}), 1)::DOUBLE || '% are ' || chr(39) || {TOP} || chr(39) END"
)
TIME_TEXT = f"(SELECT upper(f[1]) || f[2:] || ' data spanning ' || a || ' to ' || b FROM (SELECT max({o.CLASS}) AS f, min(tt)::DATE::VARCHAR AS a, max(tt)::DATE::VARCHAR AS b FROM g, m))"


def insights_sql(cols: dict[str, str]) -> str:
    """The sentence on each column, by its role; g and m are the gaps of the temporal column."""
    role = {"integer": NUMBER_ROLE, "float": NUMBER_ROLE, "text": TEXT_ROLE, "temporal": "'datetime' AS role"}
    text = {"integer": NUMBER_TEXT, "float": NUMBER_TEXT, "text": TEXT_TEXT, "temporal": TIME_TEXT}
    return "\nUNION ALL\n".join(o.every([c], f"'{k}' AS kind, {role[k]}, count(*) AS total, count(*) - count({{c}}) AS nulls, {o.COMPLETE} AS completeness, count(DISTINCT {{c}}) AS \"distinct\", {text[k]} AS insight") for c, k in cols.items())


add("a16_insights", C, lambda df: profile.enhanced(df).select("column", "role", "insight"), f'SELECT "column", role, insight FROM ({insights_sql(o.CUSTOMER)})')
add("a16_a17_insights", C, lambda df: profile.enhanced(df).select("column", "insight", F.array_join("anomalies", "; ").alias("anomalies")))
add("a18_enhanced", O, lambda df: profile.enhanced(df).select("column", "kind", "role", "total", "nulls", "completeness", "distinct", "insight"), o.gaps("o_orderdate") + " " + insights_sql(o.ORDERS))

# Rows behind issues
FIRST6 = list(o.LINEITEM)[:6]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SHOWN = [c for c in FIRST6 if c not in ("l_quantity", "l_extendedprice")]


def brief(df: DataFrame) -> DataFrame:
    return df.drop("l_quantity", "l_extendedprice")


add("d1_outlier_rows_iqr", L, lambda df: brief(drilldown.outlier_rows(df, "l_extendedprice", order_by=ORDER)), o.outlier_rows("l_extendedprice", o.IQR_OUT, ", ".join("v." + c for c in ORDER), SHOWN))
add("d2_outlier_rows_zscore", L, lambda df: brief(drilldown.outlier_rows(df, "l_extendedprice", "zscore", 3.0, order_by=ORDER)), o.outlier_rows("l_extendedprice", o.Z_OUT, ", ".join("v." + c for c in ORDER), SHOWN))
CAST4 = ", ".join(f"{c}::VARCHAR AS {c}" for c in SHOWN)
ORDER_SQL = ", ".join("v." + c for c in ORDER)
add("d3_missing_rows", L, lambda df: brief(drilldown.issue_rows(df, "l_quantity", "missing", order_by=ORDER)), f"SELECT (SELECT count(*) FROM v WHERE l_quantity IS NULL) AS _count, {CAST4} FROM v WHERE l_quantity IS NULL ORDER BY {ORDER_SQL} LIMIT 50")
IN_FENCE = o.FENCE.replace("{c}", "l_extendedprice") + " WHERE " + o.IQR_OUT.replace("{c}", "l_extendedprice")
add("d4_outlier_issue_rows", L, lambda df: brief(drilldown.issue_rows(df, "l_extendedprice", "outliers", order_by=ORDER)), f"SELECT (SELECT count(*) {IN_FENCE}) AS _count, {CAST4} {IN_FENCE} ORDER BY {ORDER_SQL} LIMIT 50")
add("d5_duplicate_values", "orders", lambda df: drilldown.issue_rows(df, "o_custkey", "duplicates", order_by=["o_orderkey"]).select("_count", "o_orderkey", "o_custkey", "o_orderstatus"), "SELECT count(*) OVER () AS _count, o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM v) t WHERE r > 1 ORDER BY t.o_orderkey LIMIT 50")

# Quality
add("q1_completeness_issues", L, lambda df: quality.completeness_issues(normal(df)), "SELECT 'completeness' AS dimension, \"column\", round(p, 1) || '% missing' AS issue FROM (" + o.every(o.of(o.LINEITEM), "(count(*) - count({c})) * 100.0 / count(*) AS p") + ") WHERE p > 5")
LOW, UP = "({c} = lower({c}) AND lower({c}) <> upper({c}))", "({c} = upper({c}) AND lower({c}) <> upper({c}))"
TEXTS_C = o.of(o.CUSTOMER, "text")
CONSIST = (
    "SELECT 'consistency' AS dimension, \"column\", issue FROM (" + o.every(TEXTS_C, f"bool_or({LOW}) AND bool_or({UP}) AS bad, 'mixed case formatting' AS issue") + "\nUNION ALL\n"
    + o.every(TEXTS_C, "bool_or(starts_with({c}, ' ') OR ends_with({c}, ' ')), 'inconsistent whitespace'") + "\nUNION ALL\n"
    + o.every(TEXTS_C, "NOT (min(length({c})) = max(length({c})) AND count(DISTINCT {c}) > 1) AND avg(regexp_full_match({c}, '[0-9]+')::INT) > 0.5 AND bool_or(regexp_matches({c}, '[a-zA-Z]')), 'mixed numeric and text values'") + ") WHERE bad"
)
add("q2_consistency_issues", C, quality.consistency_issues, CONSIST)
add("q3_uniqueness_issues", O, quality.uniqueness_issues, "SELECT 'uniqueness' AS dimension, '' AS \"column\", (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM v GROUP BY " + ", ".join(o.ORDERS) + ")) || ' duplicate rows' AS issue UNION ALL SELECT 'uniqueness', \"column\", 'very low cardinality (' || d || ' unique values)' FROM (" + o.every(o.of(o.ORDERS, "text", "temporal"), "count(DISTINCT {c}) AS d, count(*) AS n") + ") WHERE (n - d) * 100.0 / n > 80 AND d < 5")
VALID_C = "SELECT 'validity' AS dimension, \"column\", issue FROM (" + o.every(TEXTS_C, "count(*) FILTER (trim({c}) = '') AS n, count(*) FILTER (trim({c}) = '') || ' empty strings (not null)' AS issue") + "\nUNION ALL\n" + o.every(o.number(o.CUSTOMER), "CASE WHEN avg(({c} = 0)::INT) > 0.9 AND count({c}) > 100 THEN 1 ELSE 0 END, 'mostly zeros - possibly missing data encoded as 0'") + ") WHERE n > 0"
add("q4_validity_issues", C, lambda df: quality.validity_issues(normal(df)), VALID_C)
add("q5_timeliness_issues", "gap_events", quality.timeliness_issues, o.gaps("ts") + " SELECT 'timeliness' AS dimension, 'ts' AS \"column\", count(*) FILTER (gap > 3 * (SELECT median(gap) FROM g)) || ' unusual temporal gaps detected' AS issue FROM g HAVING count(*) FILTER (gap > 3 * (SELECT median(gap) FROM g)) > 0")
CELLS = "(" + " + ".join(f"count({c})" for c in o.LINEITEM) + ")"
SCORES_L = (
    f"SELECT 'completeness' AS dimension, round({CELLS} * 100.0 / (count(*) * {len(o.LINEITEM)}), 2) AS score FROM v UNION ALL SELECT 'consistency', 100.0 UNION ALL "
    "SELECT 'uniqueness', round((sum(n) - sum(n - 1)) * 100.0 / sum(n), 2) FROM (SELECT count(*) AS n FROM v GROUP BY " + ", ".join(o.LINEITEM) + ") UNION ALL SELECT 'validity', 100.0 UNION ALL "
    "SELECT 'timeliness', 100.0 - CASE WHEN (SELECT count(*) FROM g WHERE gap > 3 * (SELECT median(gap) FROM g)) > 0 THEN 5 ELSE 0 END"
)
add("q6_dimension_scores", L, quality.dimensions, o.gaps("l_shipdate") + " " + SCORES_L)
add("q6_overall_score", L, lambda df: quality.score(df).select("overall", "rows"), o.gaps("l_shipdate") + f", s AS ({SCORES_L}) SELECT round(sum(score * CASE dimension WHEN 'completeness' THEN 0.25 WHEN 'timeliness' THEN 0.15 ELSE 0.2 END), 2) AS overall, (SELECT count(*) FROM v) AS rows FROM s")
Q7 = {"q1": "SELECT 'completeness' AS dimension, \"column\", round(p, 1) || '% missing' AS issue FROM (" + o.every(o.of(o.CUSTOMER), "(count(*) - count({c})) * 100.0 / count(*) AS p") + ") WHERE p > 5", "q2": CONSIST, "q3": "SELECT 'uniqueness' AS dimension, \"column\", 'very low cardinality (' || d || ' unique values)' AS issue FROM (" + o.every(TEXTS_C, "count(DISTINCT {c}) AS d, count({c}) AS n") + ") WHERE (n - d) * 100.0 / n > 80 AND d < 5", "q4": VALID_C, "q5": "SELECT 'timeliness' AS dimension, '' AS \"column\", 'No temporal columns found for timeliness check' AS issue"}
add("q7_suggested_fixes", C, quality.issues, ", " + ", ".join(f"{k} AS ({sql})" for k, sql in Q7.items()) + " " + " UNION ALL ".join(f"SELECT dimension, \"column\", issue FROM {k}" for k in Q7))
CELLS_C = "(" + " + ".join(f"count({c})" for c in o.CUSTOMER) + ")"
CHECKS_C = len(TEXTS_C) + len(o.number(o.CUSTOMER))
SCORES_C = (
    f"SELECT 'completeness' AS dimension, round({CELLS_C} * 100.0 / (count(*) * {len(o.CUSTOMER)}), 2) AS score FROM v UNION ALL "
    f"SELECT 'consistency', round(greatest(0, 100 - count(*)::DOUBLE / {len(TEXTS_C)} * 50), 2) FROM (SELECT * FROM q2) UNION ALL "
    "SELECT 'uniqueness', round(sum(1) * 100.0 / sum(n), 2) FROM (SELECT count(*) AS n FROM v GROUP BY " + ", ".join(o.CUSTOMER) + ") UNION ALL "
    f"SELECT 'validity', round(greatest(0, 100 - count(*)::DOUBLE / {CHECKS_C} * 30), 2) FROM (SELECT * FROM q4) UNION ALL SELECT 'timeliness', 80.0"
)
add("q6_dirty_scores", C, quality.dimensions, f", q2 AS ({CONSIST}), q4 AS ({VALID_C}) {SCORES_C}")
add("q8_detailed", L, quality.detailed)
PLACES_C = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(o.CUSTOMER)) + " ELSE -1 END"
SHARES_C = o.every(o.of(o.CUSTOMER), "(count(*) - count({c})) * 100.0::DOUBLE / count(*) AS share")
WEIGHT_C = "CASE role " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in quality.NULL_WEIGHT.items()) + " END"
Q8_SQL = (
    ", " + ", ".join(f"{k} AS ({sql})" for k, sql in Q7.items()) + f", roles AS ({ROLES_C}), scores AS ({SCORES_C}), shares AS ({SHARES_C}),"
    f" m AS (SELECT 'completeness' AS dimension, \"column\", role, round(share, 1) || '% missing' AS issue, CASE WHEN share * w > 25 THEN 'critical' WHEN share * w > 10 THEN 'warning' ELSE 'info' END AS severity, round(share * w * 0.25 / {len(o.CUSTOMER)}, 1) AS impact FROM (SELECT *, {WEIGHT_C} AS w FROM shares JOIN roles USING (\"column\")) WHERE share > 2),"
    " i AS (" + " UNION ALL ".join(f"SELECT dimension, \"column\", issue FROM {k}" for k in ("q2", "q3", "q4", "q5")) + "),"
    " x AS (SELECT * FROM m UNION ALL SELECT i.dimension, i.\"column\", coalesce(role, 'measure'), issue, 'warning', round((100 - score)::DOUBLE * 0.1, 1) FROM i JOIN scores USING (dimension) LEFT JOIN roles ON roles.\"column\" = i.\"column\"),"
    f" r AS (SELECT dimension, CAST(row_number() OVER (PARTITION BY dimension ORDER BY {PLACES_C}, issue) AS INTEGER) AS rank, \"column\", role, issue, severity, impact FROM x) SELECT * FROM r WHERE rank <= 10"
)
add("q8_dirty_detailed", C, quality.detailed, Q8_SQL)

# Correlation and dependency
add("c1_matrix", L, lambda df: correlation.matrix(df).select("a", "b", "r"), f"SELECT a, b, r FROM ({o.correlation(N)})")
PRICED = ["o_orderkey", "o_totalprice", "rest", "square"]
priced = lambda df: df.select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 1000 + F.col("o_totalprice") / 100).alias("rest"), (F.col("o_totalprice") * F.col("o_totalprice")).alias("square"))
PRICED_SQL = ", w AS (SELECT o_orderkey, o_totalprice, o_orderkey % 1000 + o_totalprice / 100 AS rest, o_totalprice * o_totalprice AS square FROM v)"
add("c2_pairs", "orders", lambda df: correlation.pairs(priced(df)), PRICED_SQL + f" SELECT a, b, r FROM ({o.correlation(PRICED).replace('FROM v', 'FROM w')}) WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, k LIMIT 20")
RELATED = "SELECT s_suppkey, s_acctbal, s_acctbal * 2 + 1 AS twice, -s_acctbal AS negated, s_nationkey FROM v"
add("c3_redundant", "supplier", lambda df: correlation.redundant(df.select("s_suppkey", "s_acctbal", (F.col("s_acctbal") * 2 + 1).alias("twice"), (-F.col("s_acctbal")).alias("negated"), "s_nationkey")), f", w AS ({RELATED}) SELECT a, b, r FROM ({o.correlation(['s_suppkey', 's_acctbal', 'twice', 'negated', 's_nationkey']).replace('FROM v', 'FROM w')}) WHERE abs(r) > 0.95")


def v_sql(a: str, b: str) -> str:
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, round(sqrt(sum(pow(coalesce(o, 0) - rx * cy / n, 2) / (rx * cy / n + 1e-10)) / (max(n) * (least(count(DISTINCT x), count(DISTINCT y)) - 1))), 4) AS v FROM "
        f"(SELECT {a} AS x, count(*)::DOUBLE AS rx FROM v WHERE {b} IS NOT NULL AND {a} IS NOT NULL GROUP BY 1) r CROSS JOIN (SELECT {b} AS y, count(*)::DOUBLE AS cy FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) c "
        f"CROSS JOIN (SELECT count(*) AS n FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL) z LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*) AS o FROM v GROUP BY 1, 2) w USING (x, y)"
    )


add("c4_cramers_v", L, correlation.cramers_v, v_sql("l_returnflag", "l_linestatus"))
FD_COLS = ["n_nationkey", "n_name", "n_regionkey", "r_name"]
FD_SQL = "\nUNION ALL\n".join(f"SELECT '{a}' AS determinant, '{b}' AS dependent, round(avg((d = 1)::INT), 3) AS confidence FROM (SELECT {a}, count(DISTINCT {b}) AS d FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}) HAVING avg((d = 1)::INT) > 0.95" for a in FD_COLS for b in FD_COLS if a != b)


def customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(*FD_COLS)


QUERIES["c5_functional_dependencies"] = lambda spark, sf_dir: correlation.functional_dependencies(customer_nations(spark, sf_dir))
ORACLES["c5_functional_dependencies"] = f"WITH w AS (SELECT {', '.join(FD_COLS)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)\n{FD_SQL}"

# Time series
E = "gap_events"
# texts that are days throughout, for nine and for seven of ten rows, with zones, and numbers
DAYS = "SELECT l_orderkey, l_shipdate, substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) AS whole, CASE WHEN l_orderkey % 10 = 0 THEN 'none yet' ELSE substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) END AS most, CASE WHEN l_orderkey % 10 < 3 THEN 'none yet' ELSE substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) END AS few, concat(substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10), 'T08:30:00Z') AS zoned, CAST(l_partkey AS VARCHAR(30)) AS number FROM lineitem"
DAY_SQL = r"regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T[0-9:]{{8}}Z)?$')"


def time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(DAYS.replace("FROM lineitem", "FROM {lineitem}").replace("VARCHAR(30)", "STRING"), lineitem=table(spark, sf_dir, "lineitem"))
    return spark.createDataFrame([(c,) for c in timeseries.time_columns(df)], "column string")


QUERIES["t1_time_columns"] = time_columns
ORACLES["t1_time_columns"] = f"WITH v AS ({DAYS})\nSELECT 'l_shipdate' AS \"column\" FROM v HAVING count(l_shipdate) > 0\nUNION ALL\n" + "\nUNION ALL\n".join(f"SELECT '{c}' FROM v HAVING avg({DAY_SQL.format(c=c)}::INT) > 0.8" for c in ("whole", "most", "few", "zoned", "number"))
add("t2_t3_rhythm", E, lambda df: timeseries.rhythm(df, "ts").select("points", "mode_seconds", "frequency", "regular", "gap_count"), o.gaps("ts") + f" SELECT count(*) AS points, max(mode)::DOUBLE AS mode_seconds, max({o.CLASS}) AS frequency, avg((gap = mode)::INT) > 0.9 AS regular, count(*) FILTER (gap > 2 * mode) AS gap_count FROM g, m")
add("t2_rhythm_lineitem", "lineitem", lambda df: timeseries.rhythm(df, "l_shipdate").select("points", "mode_seconds", "frequency", "gap_count"), o.gaps("l_shipdate") + f" SELECT count(*) AS points, max(mode)::DOUBLE AS mode_seconds, max({o.CLASS}) AS frequency, count(*) FILTER (mode > 0 AND gap > 2 * mode) AS gap_count FROM g, m")
add("t4_gap_places", E, lambda df: timeseries.gap_places(df, "ts"), o.gaps("ts") + " SELECT tt::VARCHAR AS after, gap::DOUBLE AS gap_seconds FROM g, m WHERE gap > 2 * mode ORDER BY tt LIMIT 10")
IDX = ", i AS (SELECT row_number() OVER (ORDER BY ts, value) - 1 AS idx, value::DOUBLE AS x, count(*) OVER () AS n FROM v)"
VALUES = lambda df: timeseries.ordered(df, "ts", "value")
add("t5_trend", E, lambda df: timeseries.trend(VALUES(df)), IDX + " SELECT CASE WHEN (b - a) / (abs(a) + 1e-10) > 0.1 THEN 'increasing' WHEN (b - a) / (abs(a) + 1e-10) < -0.1 THEN 'decreasing' ELSE 'flat' END AS trend FROM (SELECT avg(x) FILTER (idx < n // 2) AS a, avg(x) FILTER (idx >= n // 2) AS b FROM i)")
ACF = "SELECT lag, corr(p.x, q.x) AS r FROM (SELECT unnest([7, 12, 14, 24, 28, 30, 52, 60, 90, 365]) AS lag) l, i p, i q WHERE lag < p.n // 2 AND q.idx = p.idx + lag GROUP BY lag"
add("t6_autocorrelation", E, lambda df: timeseries.autocorrelation(VALUES(df)).select("lag", r4("r").alias("r")), IDX + f" SELECT lag, round(r, 4) AS r FROM ({ACF})")
add("t6_seasonality", E, lambda df: timeseries.seasonality(VALUES(df)).select("seasonal", "strength"), IDX + f" SELECT max(abs(r)) > 0.4 AS seasonal, round(max(abs(r)), 4) AS strength FROM ({ACF})")
add("t7_stationarity", E, lambda df: timeseries.stationarity(VALUES(df)), IDX + " SELECT round(min(s), 4) AS var_min, round(max(s), 4) AS var_max, min(s) = 0 OR max(s) / (min(s) + 1e-10) < 2 AS stationary FROM (SELECT var_pop(x) AS s FROM i WHERE idx // (n // 3) < 3 GROUP BY idx // (n // 3))")
PARTS = {"rh": ORACLES["t2_t3_rhythm"], "tr": ORACLES["t5_trend"], "se": ORACLES["t6_seasonality"], "st": ORACLES["t7_stationarity"]}
PARTS_SQL = "".join(f"{', ' if k else 'WITH '}{name} AS ({sql})" for k, (name, sql) in enumerate(PARTS.items()))
add("t8_report", E, lambda df: timeseries.report(df, "ts", "value").drop("first", "last", "period"))
ORACLES["t8_report"] = PARTS_SQL + " SELECT 'ts' AS \"column\", points, mode_seconds, frequency, regular, gap_count, trend, seasonal, stationary FROM rh, tr, se, st"
add("t8_row_numbers", "events", lambda df: ordering.numbered(df.select(ordering.micros(F.col("ts")).alias("us"), "event_id"), "us", ["event_id"]).select("event_id", "idx"), "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM v")

# Geography
G = "geo_customer"
GEO = lambda f: (lambda df: f(df, "latitude", "longitude"))
OK = "abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = 0 AND longitude = 0)"
USABLE = f", u AS (SELECT latitude, longitude FROM v WHERE {OK}), b AS (SELECT avg(latitude) AS cy, avg(longitude) AS cx, min(latitude) AS y0, max(latitude) AS y1, min(longitude) AS x0, max(longitude) AS x1, count(*) AS n FROM u), k AS (SELECT latitude, longitude, {o.haversine('latitude', 'longitude', 'cy', 'cx')} AS km FROM u, b)"
G1_NAMES = {"lat_far": "latitude * 100", "lng_near": "longitude / 2", "latitude": "latitude", "longitude": "longitude"}
G1_FITS = {c: f"(SELECT avg((abs({x}) <= {90 if c.startswith('lat') else 180})::INT) > 0.8 FROM v)" for c, x in G1_NAMES.items()}
G1_SQL = "\nUNION ALL\n".join(f"SELECT '{a}' AS lat_column, '{b}' AS lng_column WHERE {G1_FITS[a]} AND {G1_FITS[b]}" for a in ("lat_far", "latitude") for b in ("lng_near", "longitude"))


def g1_columns(df: DataFrame) -> DataFrame:
    """Names that suggest coordinates, some with values that can't be any."""
    return df.selectExpr("c_custkey", *(f"{x} AS {c}" for c, x in G1_NAMES.items()))


add("g1_coordinate_columns", G, lambda df: df.sparkSession.createDataFrame(geo.coordinate_columns(g1_columns(df)), "lat_column string, lng_column string"), G1_SQL)
add("g2_validity", G, GEO(geo.validity), f"SELECT count(*) AS total, count(*) FILTER (abs(latitude) > 90) AS out_of_range_lat, count(*) FILTER (abs(longitude) > 180) AS out_of_range_lng, count(*) FILTER (latitude = 0 AND longitude = 0) AS null_island, count(*) FILTER ({OK}) AS usable, count(*) FILTER (NOT ({OK})) AS invalid FROM v")
add("g3_haversine", G, lambda df: geo.distances(df, "latitude", "longitude").select(r4("lat").alias("lat"), r4("lng").alias("lng"), F.round("km", 6).alias("km")), USABLE + " SELECT round(latitude, 4) AS lat, round(longitude, 4) AS lng, round(km, 6) AS km FROM k")
add("g4_extent", G, lambda df: geo.extent(df, "latitude", "longitude").select(r4("center_lat").alias("center_lat"), r4("center_lng").alias("center_lng"), "min_lat", "max_lat", "min_lng", "max_lng", "n"), USABLE + " SELECT round(cy, 4) AS center_lat, round(cx, 4) AS center_lng, y0 AS min_lat, y1 AS max_lat, x0 AS min_lng, x1 AS max_lng, n FROM b")
add("g5_spread", G, GEO(geo.spread), USABLE + f" SELECT round((SELECT stddev_pop(km) FROM k), 4) AS spread_km, round((SELECT avg(km) FROM k), 4) AS mean_km, round(n / greatest({o.haversine('y0', 'cx', 'y1', 'cx')} * {o.haversine('cy', 'x0', 'cy', 'x1')}, 0.01), 4) AS density FROM b")
add("g6_outliers", G, lambda df: geo.outliers(df, "latitude", "longitude", limit=1000).select("lat", "lng", "km"), USABLE + " SELECT latitude AS lat, longitude AS lng, round(km, 4) AS km FROM k WHERE km > (SELECT avg(km) + 3 * stddev_pop(km) FROM k) ORDER BY km DESC, lat, lng LIMIT 1000")
add("g7_clusters", G, GEO(geo.clusters))
add("g8_report", G, lambda df: geo.report(df, [("latitude", "longitude")]).select("lat_column", "lng_column", "total", "usable", "invalid", r4("center_lat").alias("center_lat"), "min_lng", "spread_km", "density", "outliers"))
G8 = {"ok": "g2_validity", "box": "g4_extent", "sp": "g5_spread", "far": "g6_outliers"}
ORACLES["g8_report"] = "WITH " + ", ".join(f"{k} AS ({ORACLES[q]})" for k, q in G8.items()) + " SELECT 'latitude' AS lat_column, 'longitude' AS lng_column, ok.total, usable, invalid, center_lat, min_lng, spread_km, density, (SELECT count(*) FROM far) AS outliers FROM ok, box, sp"

# Readiness
CHECK = lambda k: (lambda df: readiness.checks(df).where(F.col("check") == k).select("name", "passed", "severity", "value"))


def check_sql(name: str, value: str, passed: str, bad: str, good: str) -> str:
    return f"SELECT '{name}' AS name, {passed} AS passed, CASE WHEN {passed} THEN {good} ELSE '{bad}' END AS severity, round(x::DOUBLE, 4) AS value FROM (SELECT {value} AS x)"


MISSING_L = "(SELECT avg(p) FROM (" + " UNION ALL ".join(f"SELECT (count(*) - count({c})) * 100.0 / count(*) AS p FROM v" for c in o.LINEITEM) + "))"
add("m1_missing", L, CHECK(1), check_sql("Missing Values", MISSING_L, "x < 5", "critical", "CASE WHEN x > 0 THEN 'warning' ELSE 'info' END"))
BALANCE = "(SELECT min(r) FROM (" + " UNION ALL ".join(f"SELECT CASE WHEN count(*) BETWEEN 2 AND 20 THEN min(n) / max(n)::DOUBLE ELSE 1 END AS r FROM (SELECT count(*) AS n FROM v WHERE {c} IS NOT NULL GROUP BY {c})" for c in TEXTS_C) + "))"
add("m2_balance", C, CHECK(2), check_sql("Class Imbalance", BALANCE, "x > 0.3", "warning", "'info'"))
CONST = "(SELECT count(*) FROM (" + " UNION ALL ".join(f"SELECT count(DISTINCT {c}) AS d FROM v" for c in o.CUSTOMER) + ") WHERE d <= 1)"
add("m3_constant", C, CHECK(3), check_sql("Constant Columns", CONST, "x = 0", "warning", "'info'"))
HIGH = "(SELECT count(*) FROM (" + " UNION ALL ".join(f"SELECT count(DISTINCT {c}) AS d, count(*) AS n FROM v" for c in TEXTS_C) + ") WHERE d > 0.5 * n AND d > 100)"
add("m4_high_cardinality", C, CHECK(4), check_sql("High Cardinality", HIGH, "x = 0", "warning", "'info'"))
add("m5_correlated", L, CHECK(5), check_sql("Feature Correlation", f"(SELECT count(*) FROM ({o.correlation(N)}) WHERE abs(r) > 0.95)", "x = 0", "warning", "'info'"))
LEAKY = "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS target, CASE WHEN o_totalprice > 100000 THEN 5 ELSE 3 END AS copy, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS other FROM orders"
LEAKY_COLUMNS = ["o_orderkey", "o_totalprice", "target", "copy", "other"]
LEAKS = "(SELECT count(*) FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d FROM v" for c in LEAKY_COLUMNS) + f") t, ({o.correlation(LEAKY_COLUMNS)}) p WHERE d = 2 AND abs(r) > 0.99 AND (c = a OR c = b))"
QUERIES["m6_leakage"] = lambda spark, sf_dir: CHECK(6)(spark.sql(LEAKY.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")))
ORACLES["m6_leakage"] = f"WITH v AS ({LEAKY})\n" + check_sql("Target Leakage", LEAKS, "x = 0", "critical", "'info'")
add("m7_size", L, CHECK(7), check_sql("Data Size", "(SELECT count(*) FROM v)", "x >= 50", "critical", "CASE WHEN x < 500 THEN 'warning' ELSE 'info' END"))
MISSING_C = "(SELECT avg(p) FROM (" + " UNION ALL ".join(f"SELECT (count(*) - count({c})) * 100.0 / count(*) AS p FROM v" for c in o.CUSTOMER) + "))"
LEAK_C = "(SELECT count(*) FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d FROM v" for c in o.number(o.CUSTOMER)) + f") t, ({o.correlation(o.number(o.CUSTOMER))}) p WHERE d = 2 AND abs(r) > 0.99 AND (c = a OR c = b))"
M8 = [(MISSING_C, "x < 5"), (BALANCE, "x > 0.3"), (CONST, "x = 0"), (HIGH, "x = 0"), (f"(SELECT count(*) FROM ({o.correlation(o.number(o.CUSTOMER))}) WHERE abs(r) > 0.95)", "x = 0"), (LEAK_C, "x = 0"), ("(SELECT count(*) FROM v)", "x >= 50")]
M8_SQL = ", m AS (" + " UNION ALL ".join(f"SELECT {k} AS k, {passed} AS passed, '{readiness.SUGGESTIONS[k]}' AS step FROM (SELECT {value} AS x)" for k, (value, passed) in enumerate(M8)) + ")"
add("m8_report", C, lambda df: readiness.report(df).select("ready", "score", F.array_join("next_steps", "; ").alias("next_steps")), M8_SQL + " SELECT bool_and(passed) AS ready, round(avg(passed::INT) * 100, 1) AS score, coalesce(string_agg(step, '; ' ORDER BY k) FILTER (NOT passed), '') AS next_steps FROM m")

# Schema advice: the rules in SQL, by kind of column
DECIMALS = "max(CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN round({{c}}, {k}) = {{c}} THEN {max(k, 1)}" for k in range(5)) + " ELSE 5 END)"
WIDTH = f"(length(CAST(floor(abs(max({{c}}))) AS BIGINT)::VARCHAR) + {DECIMALS})"
TYPE_RULES = {
    "integer": "WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'SMALLINT' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END",
    "float": f"WHEN {DECIMALS} <= 4 AND {WIDTH} <= 12 THEN 'NUMERIC(' || {WIDTH} || ',' || {DECIMALS} || ')' ELSE 'DOUBLE PRECISION' END",
    "text": f"WHEN NOT ({o.RATIO} > 0.95 AND count(*) > 50) AND (avg(length({{c}})) > 50 OR {o.RATIO} > 0.8) THEN 'TEXT' WHEN max(length({{c}})) > 255 THEN 'TEXT' WHEN max(length({{c}})) <= 10 THEN 'VARCHAR(16)' WHEN max(length({{c}})) <= 50 THEN 'VARCHAR(64)' WHEN max(length({{c}})) <= 100 THEN 'VARCHAR(128)' ELSE 'VARCHAR(255)' END",
    "temporal": "ELSE 'TIMESTAMPTZ' END",
}


def types_sql(cols: dict[str, str]) -> str:
    """pos, column, type, role and nulls of each column."""
    first = "CASE WHEN count(DISTINCT {c}) <= 2 AND count({c}) > 0 THEN 'BOOLEAN' "
    return "\nUNION ALL\n".join(
        o.every([c], f"{k} AS pos, {first}{TYPE_RULES[kind]} AS type, {ROLE}WHEN {o.RATIO} > 0.95 AND count(*) > 50 THEN 'id' ELSE 'other' END AS role, count(*) - count({{c}}) AS nulls, '{kind}' AS kind") for k, (c, kind) in enumerate(cols.items())
    )


SPARK_SQL = "CASE WHEN starts_with(type, 'NUMERIC') THEN replace(lower(type), 'numeric', 'decimal') " + " ".join(f"WHEN type = '{a}' THEN '{b}'" for a, b in schema_advisor.SPARK_TYPES.items()) + " ELSE 'string' END"
BASE_CUSTOMER = {"c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "text"}
add("r1_types", L, lambda df: schema_advisor.table_columns(df).where("pos >= 0").select("column", "type", "spark_type"), f'SELECT "column", type, {SPARK_SQL} AS spark_type FROM ({types_sql(o.LINEITEM)})')
add("r2_keys", "customer", lambda df: schema_advisor.table_columns(df).select("column", "type", "nullable", "primary_key", "is_unique"), f", t AS ({types_sql(BASE_CUSTOMER)}), k AS (SELECT min(pos) AS p FROM t WHERE role = 'id' AND (kind = 'integer' OR regexp_matches(\"column\", 'id|key|code'))) SELECT \"column\", type, nulls > 0 AND pos <> p AS nullable, pos = p AS primary_key, role = 'id' AND pos <> p AS is_unique FROM t, k")
CHECKED = o.every(o.number(o.LINEITEM), NUMBER_ROLE + ", min({c}) AS low")
add("r3_checks", L, lambda df: schema_advisor.table_columns(df).where("check IS NOT NULL").select("column", "check"), f"SELECT \"column\", '\"' || \"column\" || '\" >= 0' AS \"check\" FROM ({CHECKED}) WHERE role = 'measure' AND low >= 0")
FEW_O = o.every(o.of(o.ORDERS, "text"), TEXT_ROLE + ", count(DISTINCT {c}) AS d, count(*) AS n") + "\nUNION ALL\n" + o.every(o.number(o.ORDERS), NUMBER_ROLE + ", count(DISTINCT {c}), count(*)")
STEM = "replace(replace(replace(replace(lower(\"column\"), '_id', ''), 'id_', ''), '_key', ''), '_code', '')"
add("r4_fk_hints", O, schema_advisor.fk_hints, f"SELECT \"column\", rtrim(CASE WHEN own THEN stem ELSE lower(\"column\") END, 's') || 's' AS references_table, 'id' AS references_column, CASE WHEN own THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT *, {STEM} AS stem, role = 'id' AND lower(\"column\") <> 'id' AND {STEM} <> '' AND {STEM} <> lower(\"column\") AS own FROM ({FEW_O})) WHERE own OR (role = 'category' AND d < 20 AND n / d::DOUBLE > 5)")
ROLES_O = o.every(o.of(o.ORDERS, "text"), TEXT_ROLE + ", count(DISTINCT {c}) AS d, count(*) AS n")
add("r5_normalization", O, schema_advisor.normalization_hints, f"SELECT \"column\", d AS unique_values, n AS total_rows FROM ({ROLES_O}) WHERE role = 'category' AND d <= 20 AND n > 50 AND n / d > 10")
R6_LINE = "concat_ws(' ', '    \"' || t.\"column\" || '\"', type, CASE WHEN nulls = 0 OR pos = p THEN 'NOT NULL' END, CASE WHEN pos = p THEN 'PRIMARY KEY' WHEN t.role = 'id' THEN 'UNIQUE' END, CASE WHEN c.role = 'measure' AND low >= 0 THEN 'CHECK (\"' || t.\"column\" || '\" >= 0)' END)"
R6_SQL = f", t AS ({types_sql(o.ORDERS)}), k AS (SELECT min(pos) AS p FROM t WHERE role = 'id' AND (kind = 'integer' OR regexp_matches(\"column\", 'id|key|code'))), c AS ({o.every(o.number(o.ORDERS), NUMBER_ROLE + ', min({c}) AS low')})"
add("r6_ddl", O, lambda df: schema_advisor.ddl(df, "orders"), R6_SQL + f" SELECT 'CREATE TABLE \"orders\" (' || chr(10) || string_agg({R6_LINE}, ',' || chr(10) ORDER BY pos) || chr(10) || ');' AS ddl FROM t CROSS JOIN k LEFT JOIN c ON c.\"column\" = t.\"column\"")

# Layout advice
add("i1_cardinality", O, lambda df: layout_advisor.analyze(df).select("column", "cardinality", r4("ratio").alias("ratio"), r4("null_ratio").alias("null_ratio"), r4("avg_len").alias("avg_len")), o.every(o.number(o.ORDERS) + ["o_orderdate"], "count(DISTINCT {c}) AS cardinality, round(count(DISTINCT {c})::DOUBLE / count(*), 4) AS ratio, 0.0 AS null_ratio, NULL::DOUBLE AS avg_len") + "\nUNION ALL\n" + o.every(o.of(o.ORDERS, "text"), "count(DISTINCT {c}), round(count(DISTINCT {c})::DOUBLE / count(*), 4), 0.0, round(avg(length({c})), 4)"))
add("i2_json_columns", "events", lambda df: layout_advisor.analyze(df).where("is_json").select("column", "index_type", "priority"), "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", 'GIN' AS index_type, 'high' AS priority FROM v HAVING bool_or(starts_with({c}::VARCHAR, '[') OR starts_with({c}::VARCHAR, '{{')) AND count({c}) > 0.05 * count(*)" for c in ("event_id", "event_type", "props")))
add("i3_sortedness", "orders", lambda df: named(df, layout_advisor.sortedness(df, "o_orderkey")).select("column", r4("share_sorted").alias("share_sorted")), o.every(o.number(o.ORDERS), "round(greatest(avg((x >= p)::INT), avg((x <= p)::INT)), 4) AS share_sorted", "FROM (SELECT {c} AS x, lag({c}) OVER (ORDER BY o_orderkey) AS p FROM v) WHERE p IS NOT NULL"))
WORDS = ", ".join(f"'{w}'" for w in layout_advisor.FILTER_WORDS)


def rule_sql(cols: dict[str, str]) -> str:
    """pos, column, is_filter, index_type, priority and cardinality, without an order of rows."""
    each = "\nUNION ALL\n".join(o.every([c], f"{k} AS pos, '{kind}' AS kind, count(*) AS n, count(DISTINCT {{c}}) AS d, count(*) - count({{c}}) AS nulls, " + ("avg(length({c}))" if kind == "text" else "NULL") + " AS len") for k, (c, kind) in enumerate(cols.items()))
    filters = f"(list_has_any(string_split(lower(\"column\"), '_'), [{WORDS}]) OR regexp_matches(lower(\"column\"), '{layout_advisor.FILTER_ENDS}') OR regexp_matches(lower(\"column\"), '{layout_advisor.FILTER_STARTS}') OR (kind = 'integer' AND d > 0.9 * n) OR kind = 'temporal' OR (kind = 'text' AND d < 0.05 * n))"
    rules = [("nulls > 0.95 * n", None, "low"), ("d <= 1 OR NOT is_filter", None, "low"), ("kind = 'text' AND len > 100", "GIN", "medium"), ("d > 0.01 * n AND d > 10 AND n > 1000", "BTREE", "high"), ("d > 0.01 * n AND d > 10", "BTREE", "medium"), ("d < 0.05 * n AND d > 2", "BTREE", "low")]
    index = "CASE " + " ".join(f"WHEN {w} THEN " + (f"'{k}'" if k else "NULL") for w, k, _ in rules) + " END"
    level = "CASE " + " ".join(f"WHEN {w} THEN '{p}'" for w, _, p in rules) + " ELSE 'low' END"
    return f"SELECT pos, \"column\", is_filter, {index} AS index_type, {level} AS priority, d FROM (SELECT *, {filters} AS is_filter FROM ({each}))"


add("i4_i5_rule", L, lambda df: layout_advisor.analyze(df).select("column", "is_filter", "index_type", "priority"), f'SELECT "column", is_filter, index_type, priority FROM ({rule_sql(o.LINEITEM)})')
I6_SQL = (
    f", a AS ({rule_sql(o.ORDERS)}), s AS ({ORACLES['i3_sortedness'].split(chr(10), 1)[1].replace('FROM v', 'FROM v')}), b AS (SELECT pos, a.\"column\", d, is_filter AND d > 1 AND coalesce(share_sorted, 0) > 0.95 AND (SELECT count(*) FROM v) > 10000 AS brin, index_type, priority FROM a LEFT JOIN s ON s.\"column\" = a.\"column\")"
    ", x AS (SELECT pos, \"column\", d, CASE WHEN brin THEN 'BRIN' ELSE index_type END AS index_type, CASE WHEN brin THEN 'high' ELSE priority END AS priority FROM b)"
    " SELECT CAST(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos) AS INTEGER) AS rank, \"column\", index_type, priority,"
    " CASE index_type WHEN 'BTREE' THEN 'High cardinality (' || d || ' unique), good selectivity for filtered queries' WHEN 'BRIN' THEN 'Data is physically ordered - BRIN provides compact range filtering' ELSE 'Long text values - GIN supports full-text search' END AS reason,"
    " 'CREATE INDEX \"idx_orders_' || \"column\" || '\" ON \"orders\" USING ' || lower(index_type) || ' (\"' || \"column\" || '\");' AS sql FROM x WHERE index_type IS NOT NULL"
)
add("i6_recommend", O, lambda df: layout_advisor.recommend(df, "orders", order_by="o_orderkey"), I6_SQL)

# Cleaning
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
FILLED = lambda expr: f"SELECT {KEYS}, {expr} FROM v"
cut_q = lambda done: done[0].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
add("k1_drop", L, lambda df: cut_q(cleaning.missing(df, "drop")), f"SELECT {KEYS}, l_quantity FROM v WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL")
add("k1_drop_actions", L, lambda df: cleaning.missing(df, "drop")[1].select("column", "strategy", "rows_affected"), "SELECT 'l_quantity' AS \"column\", 'drop' AS strategy, count(*) FILTER (l_quantity IS NULL) AS rows_affected FROM v UNION ALL SELECT 'l_returnflag', 'drop', count(*) FILTER (l_quantity IS NOT NULL AND l_returnflag IS NULL) FROM v")
add("k2_mean", L, lambda df: cut_q(cleaning.missing(df, "mean")).withColumn("l_quantity", r4("l_quantity")), FILLED("round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM v)), 4) AS l_quantity"))
add("k3_median", L, lambda df: cut_q(cleaning.missing(df)), FILLED("coalesce(l_quantity, (SELECT median(l_quantity) FROM v)) AS l_quantity"))
add("k4_mode", L, lambda df: cleaning.missing(df, "mode")[0].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"), FILLED("coalesce(l_quantity, (SELECT l_quantity FROM v WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_quantity, coalesce(l_returnflag, (SELECT l_returnflag FROM v WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag"))
add("k5_ffill", C, lambda df: cleaning.missing(df, "ffill", ["c_acctbal"], order_by="c_custkey")[0].select("c_custkey", "c_acctbal"), "SELECT c_custkey, last_value(c_acctbal IGNORE NULLS) OVER (ORDER BY c_custkey) AS c_acctbal FROM v")
add("k6_constant", L, lambda df: cut_q(cleaning.missing(df, "constant", ["l_quantity"], -1)), FILLED("coalesce(l_quantity, -1) AS l_quantity"))
add("k7_knn", C, lambda df: cleaning.missing(df, "knn")[0].select("c_custkey", r4("c_acctbal").alias("c_acctbal")))
add("k8_dedup_all", O, lambda df: cleaning.duplicates(df)[0], "SELECT DISTINCT * FROM v")
add("k8_dedup_last", O, lambda df: cleaning.duplicates(df, ["o_custkey"], "last", ["o_orderkey"])[0].select("o_custkey", "o_orderkey"), "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM v GROUP BY o_custkey")
add("k8_dedup_none", O, lambda df: cleaning.duplicates(df, ["o_orderkey"], False)[0], "SELECT * FROM v WHERE o_orderkey IN (SELECT o_orderkey FROM v GROUP BY 1 HAVING count(*) = 1)")
add("k9_fuzzy", "part", lambda df: neighbours.fuzzy_duplicates(df.select("p_partkey", "p_name"), "p_name", ["p_partkey"]))
add("k10_iqr_bounds", L, lambda df: named(df, stats.fences(normal(df))).select("column", r4("lower").alias("lower"), r4("upper").alias("upper")), o.every(N, f"round({o.Q1} - 1.5 * ({o.Q3} - {o.Q1}), 4) AS lower, round({o.Q3} + 1.5 * ({o.Q3} - {o.Q1}), 4) AS upper"))
add("k11_zscore_actions", L, lambda df: cleaning.outliers(df, "zscore", "flag", threshold=3.0)[1].select("column", "rows_affected"), "SELECT * FROM (" + o.every(N, f"(SELECT count(*) {o.FENCE} WHERE {o.Z_OUT}) AS rows_affected", "") + ") WHERE rows_affected > 0")
add("k12_isolation_forest", L, lambda df: cleaning.outliers(df, "isolation_forest", "flag", ["l_extendedprice"])[1].select("column", "strategy", "rows_affected"))
cut_p = lambda done: done[0].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r4("l_extendedprice").alias("l_extendedprice"))
P = "l_extendedprice"
PF = o.FENCE.replace("{c}", P)
ROW = "v.l_orderkey, v.l_partkey, v.l_suppkey, v.l_linenumber"
add("k13_clip", L, lambda df: cut_p(cleaning.outliers(df, names=[P])), f"SELECT {ROW}, round(greatest(least({P}, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 4) AS {P} {PF}")
add("k14_remove", L, lambda df: cut_p(cleaning.outliers(df, "zscore", "remove", [P], 3.0)), f"SELECT {ROW}, round({P}, 4) AS {P} {PF} WHERE NOT {o.Z_OUT.replace('{c}', P)}")
add("k15_winsorize", L, lambda df: cut_p(cleaning.outliers(df, action="winsorize", names=[P])), f"SELECT {ROW}, round(greatest(least({P}, hi), lo), 4) AS {P} FROM v, (SELECT quantile_cont({P}, 0.05) AS lo, quantile_cont({P}, 0.95) AS hi FROM v) q")
add("k16_flag", L, lambda df: cleaning.outliers(df, action="flag", names=[P])[0].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", f"{P}_is_outlier"), f"SELECT {ROW}, {o.IQR_OUT.replace('{c}', P)}::INT AS {P}_is_outlier {PF}")
add("k17_coerce", C, lambda df: cleaning.coerce(df, {"c_nation_text": "numeric", "c_acctbal": "string"})[0].select("c_custkey", "c_nation_text"), "SELECT c_custkey, TRY_CAST(c_nation_text AS DOUBLE) AS c_nation_text FROM v")
add("k17_coerce_actions", C, lambda df: cleaning.coerce(df, {"c_nation_text": "numeric"})[1].select("column", "rows_affected"), "SELECT 'c_nation_text' AS \"column\", count(*) FILTER (TRY_CAST(c_nation_text AS DOUBLE) IS NULL AND c_nation_text IS NOT NULL) AS rows_affected FROM v")
add("k18_auto_coerce", C, lambda df: cleaning.coerce(df)[0].select("c_custkey", "c_nation_text", "c_name"), "SELECT c_custkey, TRY_CAST(c_nation_text AS DOUBLE) AS c_nation_text, c_name FROM v")
SCALED = lambda m: (lambda df: cleaning.normalize(df, "c_acctbal", m)[0].select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal")))
add("k19_standard", C, SCALED("standard"), "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM v)) / (SELECT stddev_pop(c_acctbal) FROM v), 6) AS c_acctbal FROM v")
add("k20_minmax", C, SCALED("minmax"), "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal FROM v, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM v) q")
add("k21_log", C, SCALED("log"), "SELECT c_custkey, round(ln(1 + c_acctbal - lo), 6) AS c_acctbal FROM v, (SELECT min(c_acctbal) AS lo FROM v) q")
add("k22_onehot", "orders", lambda df: cleaning.normalize(df.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "onehot")[0], "SELECT o_orderkey, " + ", ".join(f"coalesce((o_orderstatus = '{x}')::INT, 0) AS o_orderstatus_{x}" for x in "FOP") + " FROM v")
add("k23_pipeline_report", O, lambda df: cleaning.preset(df, "auto")[2].select("rows_before", "rows_after"), "SELECT count(*) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM v)) AS rows_after FROM v")
add("k24_presets", O, lambda df: stats.union([cleaning.preset(df, p)[2].select(F.lit(p).alias("preset"), "*") for p in ("conservative", "aggressive")]))
FILL = ", w AS (SELECT * REPLACE (coalesce(l_quantity, (SELECT median(l_quantity) FROM v)) AS l_quantity) FROM v)"
OUT_W = o.every(N, f"(SELECT count(*) {o.FENCE.replace('FROM v', 'FROM w')} WHERE {o.IQR_OUT}) AS n", "").replace("FROM v)", "FROM w)")
K25_SQL = " SELECT 'l_quantity' AS \"column\", 'Filled ' || count(*) || ' missing values of l_quantity by median' AS description FROM v WHERE l_quantity IS NULL"
add("k25_descriptions", L, lambda df: cleaning.described(cleaning.missing(df, "median")[1]).select("column", "description"), K25_SQL.strip())
add("k25_action_log", L, lambda df: cleaning.cleaned(df, cleaning.PRESETS["auto"])[1], FILL + f" SELECT 2 AS step, 'l_quantity' AS \"column\", 'missing_values' AS issue, 'median' AS strategy, count(*) AS rows_affected FROM v WHERE l_quantity IS NULL UNION ALL SELECT 3, \"column\", 'outliers', 'clip (iqr)', n FROM ({OUT_W}) WHERE n > 0")
