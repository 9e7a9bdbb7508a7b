"""Order, quantiles, moments, statistics, times and neighbours, against plain pandas and numpy."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.columns import numeric
from millrace.operators import cleaning, correlation, forest, layout_advisor, moments, neighbours, ordering, profile, quality, report, statistics, stats, times, timeseries, topk
from millrace.sources import files


# Order


@pytest.fixture(params=[7, 1 << 20])
def ranges(request, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", request.param)
    return request.param


def test_numbers_split_equal_keys(spark, ranges):
    """Equal keys lie in several ranges, and rows that are equal throughout do too."""
    pdf = pd.DataFrame({"k": [5] * 60 + [1] * 20 + [9] * 20, "v": [*range(60), *range(20), *[3] * 20]}).sample(frac=1, random_state=2)
    df = spark.createDataFrame(pdf).repartition(3)
    rows = ordering.numbered(df, "k", ["v"]).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(100)) and [(r.k, r.v) for r in rows] == list(pdf.sort_values(["k", "v"]).itertuples(index=False, name=None))
    if ranges == 7:
        placed = ordering.in_ranges(df, [F.col("k"), F.col("v")]).groupBy("range").count().collect()
        assert len(placed) > 8 and max(r["count"] for r in placed) < 40


def test_gaps_with_equal_times(spark, ranges):
    rng = np.random.default_rng(4)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, 300), unit="h")
    df = spark.createDataFrame(pd.DataFrame({"ts": at})).repartition(4)
    want = pd.Series(at).sort_values().diff().dropna().dt.total_seconds().value_counts().sort_index()
    got = ordering.gaps(df, F.col("ts")).groupBy("gap").agg(F.sum("n").alias("n")).orderBy("gap").collect()
    assert [(r.gap / 1e6, r.n) for r in got] == [(k, v) for k, v in want.items()]
    assert ordering.gaps(df.limit(0), F.col("ts")).count() == 0 and ordering.gaps(df.limit(1), F.col("ts")).count() == 0


def test_forward_fill_of_several_columns(spark, ranges):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.permutation(200), "range": rng.normal(size=200), "row": [f"x{i}" for i in range(200)], "c0": rng.normal(size=200)})
    pdf.loc[rng.random(200) < 0.8, "range"] = None
    pdf.loc[rng.random(200) < 0.9, "row"] = None
    pdf = pdf.astype(object).where(pdf.notna(), None).astype({"k": int})
    df = spark.createDataFrame(pdf, "k long, range double, row string, c0 double").repartition(5)
    got = cleaning.missing(df, "ffill", ["range", "row"], order_by="k")[0].orderBy("k").toPandas()
    want = pdf.sort_values("k").reset_index(drop=True)
    assert got["row"].fillna("").tolist() == want["row"].ffill().fillna("").tolist()
    assert np.allclose(got["range"].astype(float), want["range"].ffill().astype(float), equal_nan=True) and np.allclose(got["c0"], want["c0"].astype(float))


def test_steps_across_borders(spark, ranges):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.permutation(150), "a": rng.integers(0, 5, 150).astype(float), "b": np.arange(150.0)})
    pdf.loc[::11, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, a double, b double").repartition(4)
    ordered = pdf.sort_values("k")
    for r in layout_advisor.sortedness(df, "k").collect():
        x = ordered.iloc[:, r.pos].to_numpy()
        pairs = [(p, q) for p, q in zip(x, x[1:]) if p == p and q == q]
        assert r.share_sorted == max(sum(q >= p for p, q in pairs), sum(q <= p for p, q in pairs)) / len(pairs)


@pytest.mark.parametrize("block", [400, 1 << 16])
def test_autocorrelation_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(timeseries, "BLOCK", block)
    rng = np.random.default_rng(7)
    v = np.sin(np.arange(1500) / 7 * np.pi) * 1e3 + rng.normal(size=1500) + 1e6
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(1500), "v": v})).select(F.timestamp_seconds("t").alias("t"), "v").repartition(3)
    got = {r.lag: r.r for r in timeseries.autocorrelation(timeseries.ordered(df, "t", "v")).collect()}
    assert set(got) == set(timeseries.LAGS) and all(np.isclose(got[n], np.corrcoef(v[:-n], v[n:])[0, 1], atol=1e-9) for n in got)
    flat = timeseries.autocorrelation(timeseries.ordered(df.withColumn("v", F.lit(0.1)), "t", "v")).collect()
    assert all(r.r is None for r in flat)


# Quantiles and moments


@pytest.mark.parametrize(("sketch", "aside", "gather"), [(4096, 0.003, 20_000), (64, 0.01, 50)])
def test_quantiles_through_brackets(spark, monkeypatch, sketch, aside, gather):
    """Exact however coarse the sketch is: brackets that miss are widened, and large ones are sketched again."""
    monkeypatch.setattr(stats, "SKETCH", sketch)
    monkeypatch.setattr(stats, "ASIDE", aside)
    monkeypatch.setattr(stats, "GATHER", gather)
    rng = np.random.default_rng(8)
    n = 5000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n)), "d": 5.0, "e": np.nan, "f": rng.integers(-(10**6), 10**6, n)})
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, e double, f long").repartition(5)
    ps = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r.pos: list(r)[1:] for r in stats.column_quantiles(df, ps).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    for pos in got:
        assert np.allclose(got[pos], pdf.iloc[:, pos].quantile(ps), rtol=1e-12)


def test_quantiles_of_few_values(spark):
    df = spark.createDataFrame([(1.5,), (None,), (3.0,)], "x double")
    assert stats.column_quantiles(df, [0.5]).first().q0 == 2.25
    assert stats.column_quantiles(df.where("x > 2"), [0.1, 0.9]).first().asDict() == {"pos": 0, "q0": 3.0, "q1": 3.0}
    assert stats.column_quantiles(df.limit(0), [0.5]).count() == 0 and stats.column_quantiles(df.select(F.lit("a").alias("t")), [0.5]).count() == 0


def test_quantiles_of_frequencies_over_ranges(spark, ranges):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 60, 400)
    freq = stats.frequency(spark.createDataFrame(pd.DataFrame({"v": v, "w": v[::-1] * 2.0})))
    for r in stats.quantiles(freq, [0.25, 0.5]).collect():
        assert [r.q0, r.q1] == (pd.Series(v).quantile([0.25, 0.5]) * (r.pos + 1)).tolist()


def test_moments_and_pairs_from_one_scan(spark):
    rng = np.random.default_rng(10)
    n = 3000
    x = rng.normal(size=(n, 12)) * 10.0 ** np.arange(-4, 8) + 10.0 ** np.arange(4, -8, -1)
    x[:, 3] = 0.1
    x[:, 5] = x[:, 4] * 2 + 1
    x[rng.random((n, 12)) < 0.2] = np.nan
    x[:, 11] = np.nan
    pdf = pd.DataFrame(x, columns=[f"x{j}" for j in range(12)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"x{j} double" for j in range(12))).repartition(7)
    for r in stats.moments(df).collect():
        own = pdf.iloc[:, r.pos].dropna()
        if not len(own):
            assert r.n == 0 and r["mean"] is None
            continue
        want = [len(own), own.mean(), own.std(), own.min(), own.max()]
        assert np.allclose([r.n, r["mean"], r["std"], r.low, r.high], want, rtol=1e-7, atol=1e-9)
        assert np.allclose([r.g1, r.g2], [0, 0] if r.pos == 3 else [own.skew(), own.kurt()], atol=1e-4)
    want = pdf.corr()
    got = {(r.pos_a, r.pos_b): r.r for r in correlation.matrix(df).collect()}
    assert len(got) == 66
    for (a, b), r in got.items():
        assert r is None if {a, b} & {3, 11} else np.isclose(r, want.iloc[a, b], atol=6e-5)
    plan = moments.pairs(df, numeric(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


# Statistics from one scan


def test_statistics_read_the_table_once(spark, sf_dir):
    """Reports of the profile don't read the table again; those of quality read it once more, for duplicates."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s = statistics.Statistics(df)
    for made in (profile.columns_report(s), profile.roles(s), profile.top_values(s), layout_advisor.analyze(s), quality.consistency_issues(s), quality.validity_issues(s)):
        assert "customer.parquet" not in made._jdf.queryExecution().optimizedPlan().toString().replace(sf_dir, "") and not any("customer" in f for f in made.inputFiles())
    assert quality.score(s).first().overall == quality.score(df).first().overall


def test_statistics_of_odd_tables(spark):
    rows = [(None, None, None, True, [1]), (1.0, " A", "2024-01-05T10:00:00Z", False, [1]), (float("nan"), "b", "2024-01-06T10:00:00+02:00", True, None), (float("inf"), "", "2024-01-07 10:00", None, [2])]
    df = spark.createDataFrame(rows, "a double, b string, c string, d boolean, e array<int>")
    s = statistics.Statistics(df)
    got = {r["column"]: r for r in s.columns.collect()}
    assert [got[c].nulls for c in "abcde"] == [2, 1, 1, 1, 1] and got["a"].infinite == 1 and got["b"].empty == 1 and got["b"].spaced and got["d"].truth == 2 / 3
    assert s.dated == ["c"] and s.temporal == ["c"] and s.times("c").count() == 3
    assert quality.score(df.limit(0)).first().rows == 0 and profile.columns_report(df.limit(0)).count() == 5


def test_approximate_counts_merge(spark):
    days = [spark.range(k * 4000, k * 4000 + 6000).select("id", (F.col("id") % 10).alias("few"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("half")) for k in range(3)]
    merged = {r["column"]: r for r in stats.merged_sketches(stats.union([stats.sketches(d) for d in days])).collect()}
    for c, n in (("id", 14_000), ("few", 10), ("half", 7_000)):
        assert abs(merged[c].distinct - n) <= 3 * 1.04 / 2**6 * n
    assert merged["id"].total == 18_000 and merged["half"].filled == 9_000


# Times


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-05", "2024-01-05 00:00:00"), ("2024/1/5", "2024-01-05 00:00:00"), ("2024-01", "2024-01-01 00:00:00"), ("20240105", "2024-01-05 00:00:00"), ("01/05/2024", "2024-01-05 00:00:00"),
        ("25/12/2024", "2024-12-25 00:00:00"), ("05.01.2024", "2024-01-05 00:00:00"), ("5 January 2024", "2024-01-05 00:00:00"), ("Jan 5, 2024", "2024-01-05 00:00:00"), ("5-SEP-2024", "2024-09-05 00:00:00"),
        ("2024-01-05 10:15", "2024-01-05 10:15:00"), ("2024-01-05T10:15:30Z", "2024-01-05 10:15:30"), ("2024-01-05T10:15:30.25+05:30", "2024-01-05 04:45:30.25"), ("2024-01-05 10:15:30,123", "2024-01-05 10:15:30.123"),
        ("1/5/2024 3:15 PM", "2024-01-05 15:15:00"), ("1/5/2024 12:15:01 am", "2024-01-05 00:15:01"), ("20240105T101530Z", "2024-01-05 10:15:30"), (" 2024-01-05 ", "2024-01-05 00:00:00"),
        ("2024-02-30", None), ("2024-13-01", None), ("2024-01-05 25:00", None), ("1001", None), ("12345678", None), ("1.5", None), ("20240105.5", None), ("word 12", None), ("", None), (None, None), ("2024-01-05 and more", None), ("x" * 100 + "2024-01-05", None),
    ],
)
def test_time_shapes(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(times.as_time(F.col("t")).cast("string")).first()[0]
    assert got == want


def test_coercion_reads_iso_times(spark):
    rows = [(f"2024-03-{d:02d}T06:00:00Z", f"{d}") for d in range(1, 29)] + [("never", "x")]
    out, log = cleaning.coerce(spark.createDataFrame(rows, "at string, n string"))
    assert dict(out.dtypes) == {"at": "timestamp", "n": "double"} and {r["column"]: r.rows_affected for r in log.collect()} == {"at": 1, "n": 1}
    assert out.agg(F.min("at")).first()[0] == datetime(2024, 3, 1, 6)


# Neighbours


def brute_knn(x, k):
    """Means of the k nearest donors of each missing value, columns without any the mean."""
    out, n = x.copy(), x.shape[1]
    for i in np.flatnonzero(np.isnan(x).any(axis=1)):
        both = (~np.isnan(x) & ~np.isnan(x[i])).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(both > 0, n * np.nansum((x - x[i]) ** 2, axis=1) / both, np.inf)
        for j in np.flatnonzero(np.isnan(x[i])):
            may = np.flatnonzero(~np.isnan(x[:, j]) & np.isfinite(far))
            first = may[np.argsort(far[may], kind="stable")[:k]]
            out[i, j] = x[first, j].mean() if len(first) else np.nanmean(x[:, j])
    return out


def imputed(spark, x, k=5, parts=6):
    names = [f"x{j}" for j in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names).astype(object)
    pdf = pdf.where(pdf.notna(), None)
    pdf["uid"] = [f"r{i}" for i in range(len(x))]
    df = spark.createDataFrame(pdf, ", ".join(f"{n} double" for n in names) + ", uid string").repartition(parts)
    got = neighbours.knn_impute(df, k).toPandas()
    return got.assign(o=got.uid.str[1:].astype(int)).sort_values("o")[names].to_numpy(float)


def test_knn_join_over_many_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(100_000, 3)) * [1, 5, 0.2]
    holes = rng.choice(100_000, 400, replace=False)
    x[holes, rng.integers(0, 3, 400)] = np.nan
    got = imputed(spark, x)
    assert np.allclose(got, brute_knn(x, 5))


@pytest.mark.parametrize(("pivots", "patterns", "blocks"), [(1024, 16, (8192, 2048)), (5, 1, (40, 7)), (30, 3, (10, 5))])
def test_knn_join_with_any_pattern_of_nulls(spark, monkeypatch, pivots, patterns, blocks):
    for name, value in zip(("PIVOTS", "PATTERNS", "DONORS", "HOLES"), (pivots, patterns, *blocks)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(pivots)
    x = rng.normal(size=(600, 4))
    x[rng.random((600, 4)) < 0.35] = np.nan
    x[:200] = np.nan_to_num(x[200], nan=0.3)  # a third of the rows are equal
    x[200:205] = np.nan
    assert np.allclose(imputed(spark, x), brute_knn(x, 5))


def test_knn_looks_at_few_cells(spark):
    """Cells that are too far away to matter are skipped."""
    rng = np.random.default_rng(12)
    x = np.repeat(np.arange(64)[:, None] * 1000.0, 2, axis=1) + rng.normal(size=(64, 2))
    boxes = pd.DataFrame({"cell": np.arange(64), "rows": 50, **{f"{p}{j}": x[:, j] + s for j in range(2) for p, s in (("lo", -1), ("hi", 1))}, "n0": 50, "n1": 50})
    cells = neighbours.Cells(boxes, 2, [3])
    rows, cell = cells.targets(np.array([[5000.0, np.nan], [np.nan, 63_000.0]]), 5)
    assert rows.tolist() == [0, 1] and cell.tolist() == [5, 63]


def sequential(texts, threshold, window):
    kept = []
    for j, t in enumerate(texts):
        if not any(j - i < window and neighbours.similarity(texts[i], t) >= threshold for i in kept):
            kept.append(j)
    return kept


@pytest.mark.parametrize("size", [5, 8192])
def test_fuzzy_duplicates_over_ranges(spark, monkeypatch, size):
    """Chains that cross many ranges end as a sequential pass ends them."""
    monkeypatch.setattr(neighbours, "SETTLED", size)
    rng = random.Random(13)
    texts = ["aaaaaaaaaa"]
    for _ in range(150):
        t = list(rng.choice(texts[-4:]))
        t[rng.randrange(len(t))] = rng.choice("abcd")
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    got = sorted(r.k for r in neighbours.fuzzy_duplicates(df, "t", ["k"], 85, 5).collect())
    assert got == sequential(texts, 85, 5)


@pytest.mark.parametrize(("span", "threshold"), [(3, 60), (50, 85), (50, 0)])
def test_similar_pairs_are_found_at_once(monkeypatch, span, threshold):
    """Blocks find the pairs that single comparisons find; short texts need none of these."""
    rng = random.Random(span + threshold)
    monkeypatch.setattr(neighbours, "MET", 1000)
    compared, one = [], neighbours.similarity
    monkeypatch.setattr(neighbours, "similarity", lambda a, b: compared.append((a, b)) or one(a, b))
    for longest in (8, 64, 130):
        texts = ["".join(rng.choices("abé😀", k=rng.randint(0, longest))) for _ in range(40)]
        texts += rng.choices(texts, k=20) + ["", ""]
        got = sorted(zip(*(x.tolist() for x in neighbours.similar(texts, span, threshold))))
        assert got == [(i, j) for i in range(len(texts)) for j in range(i + 1, min(len(texts), i + span + 1)) if one(texts[i], texts[j]) >= threshold]
        assert all(max(len(a), len(b)) > 64 for a, b in compared)
    assert [len(x) for x in neighbours.similar([], span, threshold)] == [len(x) for x in neighbours.similar(["a"], span, threshold)] == [0, 0]


def test_fuzzy_duplicates_over_blocks(spark, monkeypatch):
    """Pairs across the borders of blocks count once, and equal empty texts are duplicates."""
    monkeypatch.setattr(neighbours, "COMPARED", 7)
    rng = random.Random(16)
    texts = [rng.choice(["", "large ring", "large rings", "hot bolt", "blue ring", "x" * 70, "x" * 71]) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    got = sorted(r.k for r in neighbours.fuzzy_duplicates(df, "t", ["k"], 85, 5).collect())
    assert got == sequential(texts, 85, 5)


def test_forest_flags_what_lies_apart(spark):
    rng = np.random.default_rng(14)
    v = np.concatenate([rng.normal(size=3000), [50.0, -40.0, 60.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(5)
    flagged = [r.v for r in df.where(forest.isolated(df, "v")).collect()]
    assert {50.0, -40.0, 60.0} <= set(flagged) and len(flagged) <= 0.05 * len(v) and min(map(abs, flagged)) > 1
    again = df.repartition(2)
    assert again.where(forest.isolated(again.withColumn("v", F.lit(1.0)), "v")).count() == 0


def test_samples_have_their_size(spark):
    df = spark.range(50_000).select("id", (F.col("id") % 7).alias("few"))
    a, b = (sorted(r.id for r in files.sample(df.repartition(p), 500).collect()) for p in (3, 8))
    assert a == b and len(a) == 500 and files.sample(df.limit(20), 500).count() == 20


def test_first_rows_of_groups(spark):
    rng = np.random.default_rng(15)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "n": rng.integers(0, 20, 500), "v": [f"v{i}" for i in range(500)]})
    got = topk.firsts(spark.createDataFrame(pdf).repartition(6), "g", {"n": False, "v": True}, 4).orderBy("g", "rank").toPandas()
    want = pdf.sort_values(["g", "n", "v"], ascending=[True, False, True]).groupby("g").head(4)
    assert got.v.tolist() == want.v.tolist()


# Texts


def test_report_and_summary(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = report.combined(df, "customer").first().report_markdown
    assert text.startswith("# Report: customer\n") and "| c_custkey | integer | 100.0% |" in text and "| completeness | 100.0 |" in text and "## Readiness: " in text and text.count("\n- ") == 7
    dirty = df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal"))).union(df.limit(5))
    _, log, done = cleaning.pipeline(dirty, [("missing", {}), ("duplicates", {})])
    lines = cleaning.summary(log, done).first().summary.split("\n")
    assert lines[0] == f"Rows: {df.count() + 5} before, {done.first().rows_after} after" and lines[3].startswith("- Filled ") and "Actions: " in lines[2]
