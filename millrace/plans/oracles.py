"""DuckDB SQL for the reports, one SELECT per column of a view."""

from __future__ import annotations

LINEITEM = {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "temporal"}
CUSTOMER = {"c_custkey": "integer", "c_name": "text", "c_mktsegment": "text", "c_nation_text": "text", "c_acctbal": "float", "is_vip": "integer", "constant_col": "integer"}
ORDERS = {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_totalprice": "float", "o_orderdate": "temporal", "o_orderpriority": "text"}


def of(cols: dict[str, str], *kinds: str) -> list[str]:
    return [c for c, k in cols.items() if not kinds or k in kinds]


def number(cols: dict[str, str]) -> list[str]:
    return of(cols, "integer", "float")


def every(cols: list[str], select: str, source: str = "FROM v") -> str:
    """The select list for each column, where {c} is its name."""
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {select.replace('{c}', c)} {source.replace('{c}', c)}" for c in cols)


Q1, Q3 = "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.75)"
G1 = "coalesce(CASE WHEN isfinite(skewness({c}::DOUBLE)) THEN skewness({c}::DOUBLE) END, 0)"
G2 = "coalesce(CASE WHEN isfinite(kurtosis({c}::DOUBLE)) THEN kurtosis({c}::DOUBLE) END, 0)"
SHAPE = (
    f"CASE WHEN count({{c}}) < 10 THEN 'insufficient_data' WHEN abs({G1}) < 0.5 AND abs({G2}) < 1 THEN 'normal' WHEN {G1} > 1 THEN 'right_skewed'"
    f" WHEN {G1} < -1 THEN 'left_skewed' WHEN {G2} > 3 THEN 'heavy_tailed' WHEN abs({G1}) < 0.5 THEN 'symmetric' ELSE 'moderate_skew' END"
)
COMPLETE = "round(count({c}) * 100.0 / count(*), 2)"
RATIO = "count(DISTINCT {c})::DOUBLE / count({c})"
FENCE = "FROM v, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, avg({c}) AS m, stddev_samp({c}) AS s FROM v) q"
IQR_OUT = "({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))"
Z_OUT = "(abs({c} - m) > 3 * s)"


def issues(outliers: str) -> str:
    return (
        f"concat_ws('; ', CASE WHEN {COMPLETE} < 95 THEN CAST(round(100 - {COMPLETE}, 1) AS DECIMAL(18, 1)) || '% missing values' END,"
        f" CASE WHEN {outliers} > 0 THEN {outliers} || ' outliers detected' END,"
        f" CASE WHEN {RATIO} = 1 AND count(*) > 100 THEN 'possible ID column (all values unique)' END,"
        f" CASE WHEN {RATIO} < 0.01 AND count(*) > 100 THEN 'near-constant column' END, CASE WHEN count({{c}}) = 0 THEN 'entirely null' END)"
    )


def profile(cols: dict[str, str]) -> str:
    """The whole profile, by kind of column."""
    out = []
    base = f"count(*) AS total, count(*) - count({{c}}) AS nulls, {COMPLETE} AS completeness, count(DISTINCT {{c}}) AS unique_count, round(({RATIO})::DECIMAL(20, 12), 4)::DOUBLE AS unique_ratio"
    for c in cols:
        n = f"(SELECT count(*) {FENCE} WHERE {IQR_OUT})"
        if cols[c] in ("integer", "float"):
            rest = f"round(avg({{c}}), 4) AS mean, round(stddev_samp({{c}}), 4) AS std, min({{c}})::DOUBLE AS min_value, max({{c}})::DOUBLE AS max_value, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text, {SHAPE} AS distribution, {n} AS outliers, {issues(n)} AS issues"
        else:
            rest = f"NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, min({{c}})::VARCHAR AS min_text, max({{c}})::VARCHAR AS max_text, 'categorical' AS distribution, 0 AS outliers, {issues('0')} AS issues"
        out.append(every([c], f"'{cols[c]}' AS kind, {base}, {rest}"))
    return "\nUNION ALL\n".join(out)


def outlier_rows(column: str, test: str, order: str, shown: list[str], limit: int = 20) -> str:
    fence = FENCE.replace("{c}", column)
    cols = ", ".join(f"{c}::VARCHAR AS {c}" for c in shown)
    return (
        f"SELECT {column}::DOUBLE AS _value, CASE WHEN {column} > b + 1.5 * (b - a) THEN 'above' ELSE 'below' END AS _direction, round(abs({column} - m), 4) AS _distance,"
        f" round(a - 1.5 * (b - a), 4) AS _normal_min, round(b + 1.5 * (b - a), 4) AS _normal_max, round(m, 4) AS _mean, round(a, 4) AS _q1, round(b, 4) AS _q3, {cols}"
        f" {fence} WHERE {test.replace('{c}', column)} ORDER BY {order} LIMIT {limit}"
    )


def correlation(cols: list[str]) -> str:
    from itertools import combinations

    return "\nUNION ALL\n".join(f"SELECT {k} AS k, '{a}' AS a, '{b}' AS b, round(CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END, 4) AS r FROM v" for k, (a, b) in enumerate(combinations(cols, 2)))


def gaps(ts: str) -> str:
    """x: the gaps between neighbouring times in seconds, and their mode."""
    return (
        f", g AS (SELECT {ts} AS tt, date_diff('microsecond', lag({ts}) OVER (ORDER BY {ts}), {ts}) / 1e6 AS gap FROM v WHERE {ts} IS NOT NULL),"
        " m AS (SELECT gap AS mode FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)"
    )


CLASS = "CASE WHEN mode < 7200 THEN 'hourly' WHEN mode < 172800 THEN 'daily' WHEN mode < 864000 THEN 'weekly' WHEN mode < 3888000 THEN 'monthly' ELSE 'irregular' END"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"
