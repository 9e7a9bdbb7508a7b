"""Cleaning steps. Each returns the cleaned table and a table of actions.

A step takes at most a few aggregates for its literals; the data stays lazy.
Actions: column, issue, strategy, rows_affected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.columns import columns, normal, numeric, ref
from millrace.operators import ordering, profile, stats
from millrace.sources import folders

Done = tuple[DataFrame, DataFrame]
ACTIONS = "column string, issue string, strategy string, rows_affected long"


def actions(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ACTIONS)


def nulls(df: DataFrame, names: list[str]) -> dict[str, int]:
    row = df.agg(*(F.count(F.when(ref(c).isNull(), 1)).alias(f"n{k}") for k, c in enumerate(names))).first() if names else []
    return dict(zip(names, row))


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns in their order, some of them new."""
    return df.select(*((new[c] if c in new else ref(c)).alias(c) for c in df.columns))


def mode(df: DataFrame, column: str) -> object:
    """The most frequent value, the smallest of several. Values are counted in groups, and the best of them takes no memory."""
    sizes = df.where(ref(column).isNotNull()).groupBy(ref(column).alias("v")).agg(F.count("*").alias("n"))
    row = sizes.agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("v"))).alias("best")).first()
    return row["best"]["v"] if row["best"] else None


def missing(df: DataFrame, strategy: str = "median", names: list[str] | None = None, constant: object = 0, order_by: str | None = None) -> Done:
    """Drop or fill nulls: drop, mean, median (default), mode, ffill, constant or knn."""
    df = normal(df)
    names = names or df.columns
    counts = {c: n for c, n in nulls(df, names).items() if n}
    targets = list(counts)
    kind = {c.name: c.kind for c in columns(df)}
    number = [c for c in targets if kind[c] in ("integer", "float")]
    log = lambda cs, s: actions(df.sparkSession, [(c, "missing_values", s, counts[c]) for c in cs])
    if not targets:
        return df, actions(df.sparkSession, [])
    if strategy == "drop":
        # a row is counted for the first column in which it has a null
        first = F.coalesce(*(F.when(ref(c).isNull(), F.lit(k)) for k, c in enumerate(targets)))
        per = dict(df.groupBy(first.alias("k")).count().where("k IS NOT NULL").collect())
        return df.na.drop(subset=[f"`{c}`" for c in targets]), actions(df.sparkSession, [(c, "missing_values", "drop", per.get(k, 0)) for k, c in enumerate(targets)])
    if strategy in ("mean", "median"):
        if not number:
            return df, actions(df.sparkSession, [])
        if strategy == "mean":
            values = df.agg(*(F.avg(ref(c).cast("double")).alias(f"v{k}") for k, c in enumerate(number))).first()
        else:
            own = df.select(*(ref(c) for c in number))
            q = {r[0]: r[1] for r in stats.column_quantiles(own, [0.5]).collect()}
            values = [q.get(k) for k in range(len(number))]
        return replaced(df, {c: F.coalesce(ref(c).cast("double"), F.lit(v).cast("double")) for c, v in zip(number, values)}), log(number, strategy)
    if strategy == "mode":
        values = [mode(df, c) for c in targets]
        return replaced(df, {c: F.coalesce(ref(c), F.lit(v)) for c, v in zip(targets, values) if v is not None}), log(targets, "mode")
    if strategy == "constant":
        return replaced(df, {c: F.coalesce(ref(c), F.lit(constant).cast(df.schema[c].dataType)) for c in targets}), log(targets, "constant")
    if strategy == "ffill":
        if order_by is None:
            raise ValueError("ffill needs order_by")
        key = ref(order_by).cast("long") if kind[order_by] == "integer" else ref(order_by) if kind[order_by] == "float" else ordering.micros(ref(order_by))
        order = [key, *(ref(c) for c in df.columns if c not in targets)]
        return ordering.carried(df, order, targets), log(targets, "ffill")
    if strategy == "knn":
        from millrace.operators.neighbours import knn_impute

        return knn_impute(df), log(number, "knn")
    raise ValueError(f"unknown strategy {strategy}")


def duplicates(df: DataFrame, names: list[str] | None = None, keep: str | bool = "first", order_by: list[str] | None = None) -> Done:
    """Exact duplicates on all or some columns; keep the first, the last, or no copy (False).

    The row that stays is found by an aggregation, so a frequent key meets no window.
    """
    before = df.count()
    keys = names or df.columns
    if names is None and keep:
        out = df.dropDuplicates()
    else:
        key = [ref(c).alias(f"k{k}") for k, c in enumerate(keys)]
        ks = [f"k{k}" for k in range(len(keys))]
        order = F.struct(*(ref(c) for c in (order_by or df.columns)), *(ref(c) for c in df.columns))
        rows = df.select(*key, order.alias("o"), F.struct(*(ref(c) for c in df.columns)).alias("row"))
        pick = F.max_by("row", "o") if keep == "last" else F.min_by("row", "o")
        groups = rows.groupBy(*ks).agg(pick.alias("row"), F.count("*").alias("n"))
        out = (groups if keep else groups.where("n = 1")).select(*(F.col("row")[c].alias(c) for c in df.columns))
    out = folders.stored(out, "distinct")
    gone = before - out.count()
    return out, actions(df.sparkSession, [("all" if names is None else ",".join(names), "duplicates", "exact", gone)] if gone else [])


def limits(df: DataFrame, method: str, threshold: float, names: list[str]) -> dict[str, tuple[float, float]]:
    """Lower and upper bound of each numeric column with at least 10 values and some spread."""
    own = df.select(*(ref(c) for c in names))
    rows = stats.fences(own, threshold if method == "iqr" else 1.5).where("n >= 10").collect()
    out = {}
    for r in rows:
        if method == "iqr":
            out[r["column"]] = (r["lower"], r["upper"])
        elif r["std"]:
            out[r["column"]] = (r["mean"] - threshold * r["std"], r["mean"] + threshold * r["std"])
    return out


def beyond(column: str, low: float, high: float) -> Column:
    v = ref(column).cast("double")
    return F.coalesce((v < low) | (v > high), F.lit(False))


def clipped(column: str, low: float, high: float) -> Column:
    v = ref(column).cast("double")
    return F.when(v < low, low).when(v > high, high).otherwise(v)


def outliers(df: DataFrame, method: str = "iqr", action: str = "clip", names: list[str] | None = None, threshold: float = 1.5) -> Done:
    """Clip, remove, winsorize (5th to 95th percentile) or flag outliers by iqr, zscore or isolation_forest."""
    df = normal(df)
    names = names or [c.name for c in numeric(df)]
    spark = df.sparkSession
    if method == "isolation_forest":
        from millrace.operators.forest import isolated

        if action not in ("remove", "flag"):
            raise ValueError("an isolation forest has no bounds; use remove or flag")
        tests: dict[str, Column] = {c: isolated(df, c) for c in names}
    elif method in ("iqr", "zscore"):
        bounds = limits(df, method, threshold, names)
        tests = {c: beyond(c, *b) for c, b in bounds.items()}
    else:
        raise ValueError(f"unknown method {method}")
    if not tests:
        return df, actions(spark, [])
    if action == "remove":
        # each column sees the rows that those before it left
        log, out = [], df
        for c in tests:
            if method != "isolation_forest":
                b = limits(out, method, threshold, [c]).get(c)
                test = beyond(c, *b) if b else F.lit(False)
            else:
                test = tests[c]
            n = out.where(test).count()
            if n:
                log.append((c, "outliers", f"remove ({method})", n))
                out = out.where(~test)
        return out, actions(spark, log)
    row = df.agg(*(F.count(F.when(t, 1)).alias(f"n{k}") for k, t in enumerate(tests.values()))).first()
    counts = {c: n for c, n in zip(tests, row) if n}
    if action == "clip":
        return replaced(df, {c: clipped(c, *bounds[c]) for c in counts}), actions(spark, [(c, "outliers", f"clip ({method})", n) for c, n in counts.items()])
    if action == "winsorize":
        own = df.select(*(ref(c) for c in counts))
        q = {r[0]: (r[1], r[2]) for r in stats.column_quantiles(own, [0.05, 0.95]).collect()} if counts else {}
        return replaced(df, {c: clipped(c, *q[k]) for k, c in enumerate(counts)}), actions(spark, [(c, "outliers", "winsorize", n) for c, n in counts.items()])
    if action == "flag":
        flags = {f"{c}_is_outlier": tests[c].cast("int") for c in counts}
        return df.select("*", *(t.alias(n) for n, t in flags.items())), actions(spark, [(c, "outliers", "flag_only", n) for c, n in counts.items()])
    raise ValueError(f"unknown action {action}")


def as_number(text: Column) -> Column:
    """A double if the text is a plain number."""
    return F.when(F.trim(text).rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(text).try_cast("double"))


def coerce(df: DataFrame, type_map: dict[str, str] | None = None) -> Done:
    """Convert columns as the map says (numeric, datetime, string, category or a Spark type), or text columns by their values. What fails becomes null."""
    df = normal(df)
    texts = {c.name for c in columns(df, "text")}
    if type_map is None:
        row = df.agg(*(F.try_divide(F.count(as_number(ref(c))), F.count(ref(c))).alias(f"s{k}") for k, c in enumerate(sorted(texts)))).first() if texts else []
        type_map = {c: "numeric" for c, s in zip(sorted(texts), row) if (s or 0) > 0.8}
        type_map |= {c: "datetime" for c in profile.date_like(df) if c not in type_map}
    new = {}
    for c, t in type_map.items():
        if t == "numeric":
            new[c] = as_number(ref(c)) if c in texts else ref(c).try_cast("double")
        elif t == "datetime":
            new[c] = profile.as_time(ref(c)) if c in texts else ref(c).cast("timestamp")
        elif t in ("string", "category"):
            new[c] = ref(c).cast("string")
        else:
            new[c] = ref(c).try_cast(t)
    if not new:
        return df, actions(df.sparkSession, [])
    lost = df.agg(*(F.count(F.when(ref(c).isNotNull() & v.isNull(), 1)).alias(f"n{k}") for k, (c, v) in enumerate(new.items()))).first()
    return replaced(df, new), actions(df.sparkSession, [(c, "type_mismatch", f"coerce to {type_map[c]}", n) for c, n in zip(new, lost)])


def normalize(df: DataFrame, column: str, method: str = "standard", most: int = 100) -> Done:
    """standard, minmax, log or onehot. One-hot needs at most ``most`` values; more raise an error."""
    df = normal(df)
    v = ref(column).cast("double")
    if method == "onehot":
        values = [r[0] for r in df.select(ref(column).cast("string").alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} values")
        hot = [F.coalesce((ref(column).cast("string") == x).cast("int"), F.lit(0)).alias(f"{column}_{x}") for x in values]
        out = df.select(*(ref(c) for c in df.columns if c != column), *hot)
    else:
        mean, std, low, high = df.agg(F.avg(v), F.stddev_pop(v), F.min(v), F.max(v)).first()
        if low is None:
            return df, actions(df.sparkSession, [])
        if method == "standard":
            x = (v - mean) / std if std else v * 0
        elif method == "minmax":
            x = (v - low) / (high - low) if high > low else v * 0
        elif method == "log":
            x = F.log(v) if low > 0 else F.log1p(v - low)
        else:
            raise ValueError(f"unknown method {method}")
        out = replaced(df, {column: x})
    return out, actions(df.sparkSession, [(column, "normalization", method, df.count())])


PRESETS = {
    "auto": [("types", {}), ("duplicates", {}), ("missing", {"strategy": "median"}), ("outliers", {"method": "iqr", "action": "clip"})],
    "conservative": [("duplicates", {}), ("outliers", {"method": "iqr", "action": "flag"})],
    "aggressive": [("types", {}), ("duplicates", {}), ("missing", {"strategy": "drop"}), ("outliers", {"method": "zscore", "action": "remove", "threshold": 3.0})],
}
STEPS = {"missing": missing, "duplicates": duplicates, "outliers": outliers, "types": coerce, "normalize": normalize}


def cleaned(df: DataFrame, steps: list[tuple[str, dict]]) -> Done:
    """The cleaned table, and the actions of all steps in order (with ``step``)."""
    out, log = df, []
    for k, (name, options) in enumerate(steps):
        if name not in STEPS:
            raise ValueError(f"unknown step {name}")
        out, done = STEPS[name](out, **options)
        log.append(done.select(F.lit(k).alias("step"), "*"))
    return out, stats.union(log) if log else actions(df.sparkSession, [])


def pipeline(df: DataFrame, steps: list[tuple[str, dict]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``cleaned`` returns, and a report of rows and scores before and after. The scores take several passes over both tables."""
    from millrace.operators import quality

    out, log = cleaned(df, steps)
    before, after = (quality.score(x).select("rows", "overall") for x in (df, out))
    report = before.toDF("rows_before", "score_before").crossJoin(after.toDF("rows_after", "score_after"))
    return out, log, report


def described(log: DataFrame) -> DataFrame:
    """The actions with ``description``, a sentence on each."""
    n, c = F.col("rows_affected").cast("string"), F.col("column")
    text = (
        F.when((F.col("issue") == "missing_values") & (F.col("strategy") == "drop"), F.concat(F.lit("Dropped "), n, F.lit(" rows without a value of "), c))
        .when(F.col("issue") == "missing_values", F.concat(F.lit("Filled "), n, F.lit(" missing values of "), c, F.lit(" by "), "strategy"))
        .when(F.col("issue") == "duplicates", F.concat(F.lit("Removed "), n, F.lit(" duplicate rows")))
        .when(F.col("issue") == "outliers", F.concat(F.lit("Treated "), n, F.lit(" outliers of "), c, F.lit(": "), "strategy"))
        .when(F.col("issue") == "type_mismatch", F.concat(F.lit("Converted "), c, F.lit(": "), "strategy", F.lit(", "), n, F.lit(" values lost")))
        .otherwise(F.concat(F.lit("Normalized "), c, F.lit(" by "), "strategy"))
    )
    return log.withColumn("description", text)


def summary(log: DataFrame, report: DataFrame) -> DataFrame:
    """One row with ``summary``: rows and scores before and after, the number of actions, and a line for each, in their order."""
    tenth = lambda c: F.round(c, 1).cast("decimal(18,1)").cast("string")
    lines = described(log).agg(F.count("*").alias("actions"), F.transform(F.array_sort(F.collect_list(F.struct("step", "column", "description"))), lambda x: F.concat(F.lit("\n- "), x["description"])).alias("lines"))
    text = F.concat(
        F.lit("Rows: "), F.col("rows_before").cast("string"), F.lit(" before, "), F.col("rows_after").cast("string"), F.lit(" after\nQuality: "), tenth("score_before"), F.lit(" before, "), tenth("score_after"),
        F.lit(" after\nActions: "), F.col("actions").cast("string"), F.array_join("lines", ""),
    )
    return report.crossJoin(F.broadcast(lines)).select(text.alias("summary"))


def preset(df: DataFrame, name: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    return pipeline(df, PRESETS[name])
