"""Cleaning steps, sources and sinks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import cleaning, neighbours
from millrace.sources import files, jdbc


@pytest.fixture(scope="module")
def issues(spark):
    rows = [(10.0, "a", "1", 1.0), (None, "b", "2", 2.0), (12.0, "c", "bad", 3.0), (11.0, "d", "4", 4.0), (10000.0, "e", "5", 5.0), (None, "f", "6", 6.0), (13.0, "g", "7", 7.0), (9.0, "h", "8", 8.0), (10.0, "i", "9", 9.0), (12.0, "j", "10", 10.0)]
    return spark.createDataFrame(rows, "price double, name string, age string, score double")


def column(df, c, order="score"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]


def test_missing(issues):
    assert cleaning.missing(issues, "drop")[0].count() == 8
    filled, log = cleaning.missing(issues)
    pdf = issues.toPandas()
    assert column(filled, "price") == pdf.sort_values("score").price.fillna(pdf.price.median()).tolist()
    assert [tuple(r) for r in log.collect()] == [("price", "missing_values", "median", 2)]
    assert column(cleaning.missing(issues, "constant", constant=-1)[0], "price").count(-1.0) == 2
    assert column(cleaning.missing(issues, "mode")[0], "price")[1] == 10.0
    assert column(cleaning.missing(issues.repartition(3).withColumn("k", F.col("score").cast("int")), "ffill", ["price"], order_by="k")[0], "price") == pdf.price.ffill().tolist()
    with pytest.raises(ValueError):
        cleaning.missing(issues, "magic")
    assert cleaning.missing(cleaning.missing(issues)[0])[1].count() == 0


def test_knn_takes_the_nearest_donors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    x[rng.random((60, 3)) < 0.15] = np.nan
    x[np.isnan(x).all(axis=1)] = 0
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).reset_index().astype(object).where(lambda d: d.notna(), None).astype({"index": int}), "index long, a double, b double, c double")
    got = cleaning.missing(df.select("a", "b", "c", F.col("index").cast("string").alias("k")), "knn")[0].toPandas()
    got = got.assign(k=got.k.astype(int)).sort_values("k")[list("abc")].to_numpy()
    for i, j in zip(*np.where(np.isnan(x))):
        far = []
        for r in range(60):
            both = ~np.isnan(x[i]) & ~np.isnan(x[r])
            if not np.isnan(x[r, j]) and both.any():
                far.append((np.sqrt(3 / both.sum() * ((x[i] - x[r])[both] ** 2).sum()), x[r, j]))
        assert np.isclose(got[i, j], np.mean([v for _, v in sorted(far)[:5]]))


def test_knn_has_no_bound_on_donors(spark, monkeypatch):
    """Of 60,000 rows the nearest are found for every row to fill, over several blocks and partitions."""
    from millrace.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 40, raising=False)
    df = spark.range(60_000).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 600 != 300, F.col("id").cast("double")).alias("b"))
    got = neighbours.knn_impute(df.repartition(6), 4).where("a % 600 = 300").collect()
    assert len(got) == 100 and all(r.b == r.a for r in got)


def test_verdicts_on_columns_rest_on_all_rows(spark):
    """Dates, JSON and coordinates are judged by all values, wherever they stand."""
    from millrace.operators import geo, layout_advisor, profile

    day = "CAST(date_add(DATE'2024-01-01', CAST(id AS INT)) AS STRING)"
    df = spark.range(0, 1000, 1, 1).selectExpr(
        f"IF(id < 200, {day}, 'word ' || id) AS early", f"IF(id < 100, 'no date 1', {day}) AS late", "IF(id = 999, '{}', 'x') AS j", "IF(id < 50, NULL, 45.0D) AS lat", "IF(id < 50, NULL, IF(id = 60, 999.0D, 120.0D)) AS lng"
    )
    assert profile.date_like(df) == ["late"] and layout_advisor.json_like(df) == ["j"] and geo.coordinate_columns(df) == [("lat", "lng")]
    cleaned, _ = cleaning.coerce(df)
    assert dict(cleaned.dtypes)["early"] == "string" and cleaned.where("early IS NULL").isEmpty() and dict(cleaned.dtypes)["late"] == "timestamp"


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (1, "z"), (None, None), (None, None)], "a int, b string")
    assert cleaning.duplicates(df)[0].count() == 4
    assert [r.b for r in cleaning.duplicates(df, ["a"], "first", ["b"])[0].orderBy("a").collect()] == [None, "x", "y"]
    assert [r.b for r in cleaning.duplicates(df, ["a"], "last", ["b"])[0].orderBy("a").collect()] == [None, "z", "y"]
    assert [r.a for r in cleaning.duplicates(df, ["a"], False)[0].collect()] == [2]


def test_outliers(spark):
    df = spark.createDataFrame([(float(k),) for k in range(100)] + [(10000.0,), (None,)], "val double")
    clipped, log = cleaning.outliers(df)
    assert clipped.agg(F.max("val")).first()[0] < 200 and log.first().rows_affected == 1
    assert cleaning.outliers(df, action="remove")[0].count() == 101
    assert cleaning.outliers(df, "zscore", "remove", threshold=3.0)[0].count() == 101
    assert cleaning.outliers(df, action="flag")[0].where("val_is_outlier = 1").count() == 1
    assert cleaning.outliers(df, action="winsorize")[0].agg(F.max("val")).first()[0] == 95.0
    forest = cleaning.outliers(df.na.drop(), "isolation_forest", "flag")[0]
    assert forest.where("val = 10000 AND val_is_outlier = 1").count() == 1 and 1 <= forest.where("val_is_outlier = 1").count() <= 6
    with pytest.raises(ValueError):
        cleaning.outliers(df, "isolation_forest", "clip")
    assert cleaning.outliers(spark.createDataFrame([(1.0,)] * 5, "val double"))[1].count() == 0


def test_types(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-05"), ("2", "bad", "2024-02-05"), ("1d", "3", "2024/03/05"), ("4", "4", None), ("5", None, "1001")] + [("7", "8", "2024-01-01")] * 20, "num string, val string, day string")
    auto = cleaning.coerce(df)[0]
    assert dict(auto.dtypes) == {"num": "double", "val": "double", "day": "timestamp"}
    assert auto.where("num IS NULL").count() == 1 and auto.where("day IS NULL").count() == 2
    out, log = cleaning.coerce(df.select("val"), {"val": "numeric"})
    assert log.first().rows_affected == 2
    assert cleaning.coerce(df, {"val": "string"})[0].where("val IS NULL").count() == 1


def test_normalize(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None), (5.0, "a")], "v double, c string")
    v = lambda m: [r.v for r in cleaning.normalize(df, "v", m)[0].collect()]
    assert np.allclose([x for x in v("standard") if x is not None], [-1.22474487, 0, 1.22474487]) and v("minmax") == [0.0, 0.5, None, 1.0]
    assert np.allclose([x for x in v("log") if x is not None], np.log([1, 3, 5]))
    assert cleaning.normalize(df, "c", "onehot")[0].columns == ["v", "c_a", "c_b"] and [tuple(r)[1:] for r in cleaning.normalize(df, "c", "onehot")[0].collect()][2] == (0, 0)
    with pytest.raises(ValueError):
        cleaning.normalize(df, "c", "onehot", most=1)
    constant = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v for r in cleaning.normalize(constant, "v")[0].collect()] == [0.0, 0.0]


def test_pipeline(spark, issues):
    twice = issues.union(issues)
    out, log, report = cleaning.preset(twice)
    row = report.first()
    assert (row.rows_before, row.rows_after) == (20, 10) and row.score_after > row.score_before
    assert [r.step for r in log.orderBy("step").collect()] == sorted(r.step for r in log.collect()) and log.count() >= 3
    with pytest.raises(ValueError):
        cleaning.pipeline(issues, [("magic", {})])


def test_actions_need_no_scores(spark, sf_dir, monkeypatch):
    from millrace.operators import quality
    from millrace.plans import reports

    monkeypatch.setattr(quality, "score", lambda table: pytest.fail("scores are no part of the actions"))
    assert sorted((r.step, r.column) for r in reports.QUERIES["k25_action_log"](spark, sf_dir).collect()) == [(2, "l_quantity"), (3, "l_extendedprice")]


def greedy(texts, threshold, window):
    kept = []
    for j, t in enumerate(texts):
        if not any(neighbours.similarity(texts[i], t) >= threshold for i in kept if j - i < window):
            kept.append(j)
    return kept


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for k, y in enumerate(b):
        out.append(row[k] + 1 if x == y else max(row[k + 1], out[k]))
    return out


def test_fuzzy_duplicates_follow_the_greedy_order(spark):
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        assert neighbours.similarity(a, b) == (100 if not a + b else round(200 * lcs(a, b) / (len(a) + len(b))))
    texts = ["".join(rng.choices("abcd", k=8)) for _ in range(20)]
    rows = [(k, rng.choice(texts) if rng.random() < 0.5 else rng.choice(texts)[:7] + "x") for k in range(120)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    got = sorted(r.k for r in neighbours.fuzzy_duplicates(df, "t", ["k"], 85, 10).collect())
    assert got == greedy([t for _, t in rows], 85, 10)


def test_csv_and_json(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n1,x\nNA,y\n3,n/a\n")
    df = files.load_csv(spark, str(path))
    assert df.schema["a"].dataType.simpleString() == "int" and [tuple(r) for r in df.collect()] == [(1, "x"), (None, "y"), (3, None)]
    assert files.load_csv(spark, str(path), sample_size=2).count() == 2
    with pytest.raises(FileNotFoundError):
        files.load_csv(spark, str(tmp_path / "none.csv"))
    one = tmp_path / "a.json"
    one.write_text('{"meta": 1, "results": {"items": [{"x": 1, "y": {"z": 2}}, {"x": 3}]}}')
    assert [tuple(r) for r in files.flatten(files.extract_records(files.load_json(spark, str(one)))).collect()] == [(1, 2), (3, None)]
    assert files.load_json(spark, str(one), "results.items").count() == 2
    one.write_text('[{"x": 1}, {"x": 2}]')
    assert files.extract_records(files.load_json(spark, str(one))).count() == 2
    one.write_text('{"n": [1, 2]}')
    with pytest.raises(ValueError, match="members are n"):
        files.extract_records(files.load_json(spark, str(one)))


def test_json_records_are_located(spark, tmp_path):
    one = tmp_path / "b.json"
    read = lambda: files.load_json(spark, str(one), records=True)
    one.write_text('{"meta": 1, "results": {"items": [{"x": 1, "y": {"z": 2}}, {"x": 3}]}}')
    assert [tuple(r) for r in files.flatten(read()).collect()] == [(1, 2), (3, None)]
    one.write_text('{"found": [{"x": 1}], "rows": [{"x": 2}, {"x": 3}]}')  # a usual key comes before others
    assert sorted(r.x for r in read().collect()) == [2, 3]
    one.write_text('[{"x": 1, "parts": [{"y": 1}, {"y": 2}]}, {"x": 2, "parts": []}]')  # records themselves, though they hold arrays
    assert sorted(r.x for r in read().collect()) == [1, 2]
    one.write_text('{"a": {"b": 1}}')
    assert read().count() == 1
    one.write_text('{"x": 1}')
    assert read().count() == 1


def test_sample_is_independent_of_partitions(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    a, b = (sorted(r.id for r in files.sample(df.repartition(p), 50).collect()) for p in (1, 8))
    assert a == b and len(a) == 50 and files.sample(df, 5000).count() == 1000
    with pytest.raises(ValueError):
        files.capped(df.limit(0))
    flat = files.flatten_json(spark.createDataFrame([(1, '{"k": 1, "m": {"n": "a"}}'), (2, None)], "id int, p string"), "p")
    assert flat.columns == ["id", "p_k", "p_m_n"] and [tuple(r) for r in flat.orderBy("id").collect()] == [(1, 1, "a"), (2, None, None)]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(100).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V"))
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    assert jdbc.save_table(df, "T", url, **options) == 100
    assert jdbc.save_table(df, "T", url, if_exists="append", **options) == 100
    back = jdbc.load_table(spark, "T", url, partition_column="K", bounds=(0, 100), partitions=4, **options)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 200 and jdbc.load_table(spark, "T", url, limit=5, **options).count() == 5
    with pytest.raises(ValueError):
        jdbc.load_table(spark, "T; DROP TABLE T", url)
