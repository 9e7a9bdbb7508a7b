"""The base tables that all reports share: counts, moments, frequencies, exact quantiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.columns import Col, columns, numeric, per_column, ref
from millrace.operators import ordering
from millrace.operators.moments import doubles, singles
from millrace.sources import folders

#: Size of the sketches that bracket a rank, and the share of the values that a bracket takes on each side of it.
SKETCH, ASIDE = 4096, 0.003
#: Values strictly inside a bracket that are brought together to be put in order.
GATHER = 20_000


def counts(df: DataFrame) -> DataFrame:
    """pos, column, kind, total, nulls, filled, completeness (percent, 0 for an empty table)."""
    base = per_column(df, columns(df), {"total": lambda c: F.count("*"), "filled": lambda c: F.count(ref(c.name))})
    share = F.coalesce(F.try_divide(F.col("filled") * 100.0, F.col("total")), F.lit(0.0))
    return base.select("pos", "column", "kind", "total", (F.col("total") - F.col("filled")).alias("nulls"), "filled", F.round(share, 2).alias("completeness"))


def moments(df: DataFrame) -> DataFrame:
    """pos, column, kind, n, mean, std (sample), low, high, g1 and g2 (bias-corrected skewness and excess kurtosis) of numeric columns."""

    cols = numeric(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "pos int, column string, kind string, n long, mean double, std double, low double, high double, g1 double, g2 double")
    names = df.sparkSession.createDataFrame([(c.pos, c.name, c.kind) for c in cols], "pos int, column string, kind string")
    base = names.join(singles(df, cols), "pos", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g1, g2, std = corrected(F.col("n").cast("double"), F.greatest("m2", F.lit(0.0)), F.col("m3"), F.col("m4"))
    return base.select("pos", "column", "kind", "n", "mean", std.alias("std"), "low", "high", g1.alias("g1"), g2.alias("g2"))


def corrected(n: Column, m2: Column, m3: Column, m4: Column) -> tuple[Column, Column, Column]:
    """Bias-corrected skewness and excess kurtosis (0 for a constant column), and sample deviation, from sums of powers around the mean."""
    s, k = F.sqrt(n) * m3 / F.pow(m2, F.lit(1.5)), n * m4 / (m2 * m2) - 3
    g1 = F.when(n > 2, F.when(m2 > 0, s * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0))
    g2 = F.when(n > 3, F.when(m2 > 0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)).otherwise(0.0))
    return g1, g2, F.when(n > 1, F.sqrt(m2 / (n - 1)))


def frequency(df: DataFrame, cols: list[Col] | None = None, nulls: bool = False) -> DataFrame:
    """pos, num (numeric columns), whole (integers, and micros of times), text (all but numbers) and n: how often each value occurs.

    Nulls are left out, or (``nulls``) counted in rows that aren't ``there``.

    All columns share one shuffle; equal values combine before it.
    """
    cols = columns(df) if cols is None else cols
    if not cols:
        return df.limit(0).select(F.lit(0).alias("pos"), F.lit(0.0).alias("num"), F.lit(0).cast("long").alias("whole"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"), *([F.lit(True).alias("there")] if nulls else []))

    def cell(c: Col) -> Column:
        v = ref(c.name)
        parts = {"num": v.cast("double") if c.kind in ("integer", "float") else None, "whole": v.cast("long") if c.kind == "integer" else ordering.micros(v) if c.kind == "temporal" else None, "text": v.cast("string") if c.kind not in ("integer", "float", "other") else F.to_json(F.struct(v)) if c.kind == "other" else None}
        kinds = {"num": "double", "whole": "long", "text": "string"}
        return F.struct(F.lit(c.pos).alias("pos"), v.isNotNull().alias("there"), *((F.lit(None).cast(kinds[k]) if p is None else p).alias(k) for k, p in parts.items()))

    cells = df.select(F.explode(F.array(*map(cell, cols))).alias("x")).select("x.*")
    keys = ["pos", "num", "whole", "text"]
    return cells.groupBy(*keys, "there").agg(F.count("*").alias("n")) if nulls else cells.where("there").groupBy(*keys).agg(F.count("*").alias("n"))


def distincts(freq: DataFrame) -> DataFrame:
    """pos, distinct, most, least (counts of the most and least frequent value)."""
    return freq.groupBy("pos").agg(F.count("*").alias("distinct"), F.max("n").alias("most"), F.min("n").alias("least"))


def quantiles(freq: DataFrame, ps: list[float]) -> DataFrame:
    """pos and q0, q1, ...: exact quantiles with linear interpolation over a frequency table.

    Values are sorted in ranges. Sums of the ranges tell where each rank lies; only
    those ranges are looked at value by value.
    """
    values = freq.where("num IS NOT NULL").select("pos", "num", "n")
    dealt = folders.stored(ordering.in_ranges(values, [F.col("pos"), F.col("num")]).select("row.*", F.col("range").alias("bucket")), "ranges")
    sums = dealt.groupBy("pos", "bucket").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("pos", "bucket", (F.sum("n").over(over) - F.col("n")).alias("begin"), F.sum("n").over(over).alias("end"), F.sum("n").over(Window.partitionBy("pos")).alias("all"))
    place = [(F.lit(p) * (F.col("all") - 1)).alias("h") for p in ps]
    ranks = F.array(*(F.struct(F.lit(k).alias("q"), h.alias("h")) for k, h in enumerate(place)))
    wanted = sums.select("pos", "bucket", "begin", "end", F.explode(ranks).alias("r")).select("pos", "bucket", "begin", "end", "r.q", "r.h")
    inside = lambda r: (F.col("begin") <= r) & (r < F.col("end"))
    wanted = wanted.where(inside(F.floor("h")) | inside(F.ceil("h")))
    order = Window.partitionBy("pos", "bucket").orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = dealt.join(F.broadcast(wanted.select("pos", "bucket").distinct()), ["pos", "bucket"]).withColumn("upto", F.sum("n").over(order))
    both = near.join(F.broadcast(wanted), ["pos", "bucket"])
    first, last = F.col("begin") + F.col("upto") - F.col("n"), F.col("begin") + F.col("upto")
    holds = lambda r: F.when((first <= r) & (r < last), F.col("num"))
    picked = both.groupBy("pos", "q").agg(F.max(holds(F.floor("h"))).alias("lo"), F.max(holds(F.ceil("h"))).alias("hi"), F.max("h").alias("h"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))
    return picked.groupBy("pos").agg(*(F.max(F.when(F.col("q") == k, value)).alias(f"q{k}") for k in range(len(ps))))


def sketches(df: DataFrame, lg: int = 12) -> DataFrame:
    """pos, column, total, filled and distinct_sketch (binary) of each column: an approximate profile that merges over partitions, tables and days.

    The error of a distinct count is about 1.04 divided by the root of 2 to ``lg``.
    """
    hashed = lambda c: F.when(ref(c.name).isNotNull(), F.xxhash64(ref(c.name)))
    cols = columns(df)
    return per_column(df, cols, {"total": lambda c: F.count("*"), "filled": lambda c: F.count(ref(c.name)), "distinct_sketch": lambda c: F.hll_sketch_agg(hashed(c), F.lit(lg))})


def merged_sketches(tables: DataFrame) -> DataFrame:
    """column, total, filled and distinct (approximate) of sketches that were put together by ``unionByName``."""
    return tables.groupBy("column").agg(F.sum("total").alias("total"), F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch", F.lit(True))).alias("distinct"))


class Rank:
    """The search for the values at two neighbouring ranks of a column: a bracket, and what is known of the values in it."""

    def __init__(self, col: Col, place: float) -> None:
        self.col, self.place = col, place
        self.ranks = sorted({floor(place), ceil(place)})
        self.low = self.high = 0.0
        self.aside, self.below, self.inside = ASIDE, 0, 0  # around the rank; values below what was sketched, and in it
        self.found: dict[int, float] = {}

    def around(self) -> Column:
        """The shares of what was sketched between which the ranks should lie."""
        share = lambda r: min(1.0, max(0.0, (r - self.below) / max(self.inside - 1, 1)))
        return F.array(F.lit(max(0.0, share(self.ranks[0]) - self.aside)), F.lit(min(1.0, share(self.ranks[-1]) + self.aside)))

    def counted(self, below: int, at_low: int, between: int, at_high: int) -> str:
        """What to do next, from the numbers of values in the bracket: nothing, gather, sketch what is inside, or widen."""
        if self.ranks[0] < below or self.ranks[-1] >= below + at_low + between + at_high:
            return "widen"
        for r in self.ranks:
            if r < below + at_low:
                self.found[r] = self.low
            elif r >= below + at_low + between:
                self.found[r] = self.high
        if len(self.found) == len(self.ranks):
            return "done"
        self.start = below + at_low
        if between <= GATHER:
            return "gather"
        self.below, self.inside = below + at_low, between
        return "sketch"

    def value(self) -> float:
        first, last = self.found[self.ranks[0]], self.found[self.ranks[-1]]
        return first if first == last else first + (last - first) * (self.place - self.ranks[0])


def ends_counted(df: DataFrame, ends: dict[Col, list[float]]) -> dict[tuple[int, float], tuple[int, int]]:
    """For each column (its number) and value: how many values lie below it, and how many up to it. A batch is sorted once for all of them."""
    cols = [c for c in ends if ends[c]]
    points = [np.array(ends[c]) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under, upto = [np.zeros(len(p), np.int64) for p in points], [np.zeros(len(p), np.int64) for p in points]
        for batch in batches:
            for j, p in enumerate(points):
                x = np.sort(batch.column(j).drop_null().to_numpy())
                under[j] += np.searchsorted(x, p, side="left")
                upto[j] += np.searchsorted(x, p, side="right")
        sizes = [len(p) for p in points]
        names = np.repeat(np.arange(len(points)), sizes)
        yield pa.RecordBatch.from_pydict({"j": pa.array(names, pa.int32()), "k": pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32()), "under": np.concatenate(under), "upto": np.concatenate(upto)})

    parts = doubles(df, cols).mapInArrow(run, "j int, k int, under long, upto long").groupBy("j", "k").agg(F.sum("under"), F.sum("upto")).collect()  # a row for each end
    return {(cols[j].pos, ends[cols[j]][k]): (under, upto) for j, k, under, upto in parts}


def values_between(df: DataFrame, ranges: list[tuple[Col, float, float]]) -> DataFrame:
    """i, v and n: how often each value occurs strictly inside the i-th range of a column."""
    cols = sorted({c for c, _, _ in ranges}, key=lambda c: c.pos)
    wanted = [(cols.index(c), low, high) for c, low, high in ranges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns_ = [c.drop_null().to_numpy() for c in batch.columns]
            found = [columns_[j][(columns_[j] > low) & (columns_[j] < high)] for j, low, high in wanted]
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int32()), "v": np.concatenate(found)})

    return doubles(df, cols).mapInArrow(run, "i int, v double").groupBy("i", "v").agg(F.count("*").alias("n"))


def column_quantiles(df: DataFrame, ps: list[float]) -> DataFrame:
    """pos and q0, q1, ... of the numeric columns, exactly, with linear interpolation.

    Mergeable sketches bracket each rank. One scan counts what lies below, on and
    between the ends of all brackets; where more than ``GATHER`` values are in between,
    these are sketched, and the next bracket is a small share of this one. What remains
    is brought together and put in order. A bracket that misses its rank is widened.
    The plan is the same at any size: three scans, and two more each time the table
    grows a hundredfold.
    """
    cols = numeric(df)
    schema = ", ".join(["pos int", *(f"q{k} double" for k in range(len(ps)))])
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    v = lambda c: ref(c.name).cast("double")
    sizes = df.agg(*(F.count(ref(c.name)) for c in cols), *(F.kll_sketch_agg_double(v(c), F.lit(SKETCH)).alias(f"s{c.pos}") for c in cols))
    known = folders.stored(sizes.toDF(*(f"n{c.pos}" for c in cols), *(f"s{c.pos}" for c in cols)), "sketches")
    total = known.first()
    ranks = {(c.pos, k): Rank(c, p * (total[f"n{c.pos}"] - 1)) for c in cols for k, p in enumerate(ps) if total[f"n{c.pos}"]}
    for (pos, _), r in ranks.items():
        r.inside = total[f"n{pos}"]
    sketched, of, live, gather = known, {key: f"s{key[0]}" for key in ranks}, list(ranks), []
    while live:
        ends = sketched.select(*(F.kll_sketch_get_quantile_double(of[key], ranks[key].around()) for key in live)).first()
        for key, (low, high) in zip(live, ends):
            ranks[key].low, ranks[key].high = low, high
        told = ends_counted(df, {c: sorted({e for key in live if key[0] == c.pos for e in (ranks[key].low, ranks[key].high)}) for c in cols})
        going, source = [], {}
        for key in live:
            r = ranks[key]
            (under_low, upto_low), (under_high, upto_high) = told[key[0], r.low], told[key[0], r.high]
            single = r.low == r.high
            todo = r.counted(under_low, upto_low - under_low, 0 if single else under_high - upto_low, 0 if single else upto_high - under_high)
            if todo == "gather":
                gather.append(key)
            elif todo in ("sketch", "widen"):
                going.append(key)
                source[key] = todo
                r.aside = ASIDE if todo == "sketch" else 4 * r.aside
        inner = {key: f"i{i}" for i, key in enumerate(going) if source[key] == "sketch"}
        if inner:
            x = lambda key: v(ranks[key].col)
            found = folders.stored(df.agg(*(F.kll_sketch_agg_double(F.when((x(key) > ranks[key].low) & (x(key) < ranks[key].high), x(key)), F.lit(SKETCH)).alias(n) for key, n in inner.items())), "inside")
            kept = {of[key] for key in going if key not in inner}
            sketched = found.crossJoin(F.broadcast(sketched.select(*(F.col(c).alias(f"old_{c}") for c in kept)))) if kept else found
            of = {key: inner.get(key) or f"old_{of[key]}" for key in going}
        live = going
    if gather:
        inside = values_between(df, [(ranks[key].col, ranks[key].low, ranks[key].high) for key in gather])
        upto: dict[int, int] = {}
        for i, value, n in sorted(tuple(x) for x in inside.collect()):  # at most GATHER for each rank
            r = ranks[gather[i]]
            begin = upto.get(i, r.start)
            r.found |= {k: value for k in r.ranks if begin <= k < begin + n}
            upto[i] = begin + n
    rows = [(c.pos, *(ranks[c.pos, k].value() for k in range(len(ps)))) for c in cols if (c.pos, 0) in ranks]
    return df.sparkSession.createDataFrame(rows, schema)


def fences(df: DataFrame, threshold: float = 1.5) -> DataFrame:
    """pos, column, n, mean, std, quartiles, lower and upper of numeric columns."""
    m = moments(df).join(column_quantiles(df, [0.25, 0.5, 0.75]), "pos", "left")
    spread = F.col("q2") - F.col("q0")
    return m.select("pos", "column", "kind", "n", "mean", "std", "low", "high", "g1", "g2", F.col("q0").alias("p25"), F.col("q1").alias("median"), F.col("q2").alias("p75"), (F.col("q0") - threshold * spread).alias("lower"), (F.col("q2") + threshold * spread).alias("upper"))


def distribution(g1: Column, g2: Column, n: Column) -> Column:
    """Shape of a numeric column by its corrected moments."""
    return (
        F.when(n < 10, "insufficient_data")
        .when((F.abs(g1) < 0.5) & (F.abs(g2) < 1), "normal")
        .when(g1 > 1, "right_skewed")
        .when(g1 < -1, "left_skewed")
        .when(g2 > 3, "heavy_tailed")
        .when(F.abs(g1) < 0.5, "symmetric")
        .otherwise("moderate_skew")
    )


def outliers(df: DataFrame, bounds: DataFrame, least: int = 4) -> DataFrame:
    """pos and outliers: values outside lower and upper, none below ``least`` values; one more pass over the rows."""
    known = {r["pos"]: (r["lower"], r["upper"]) for r in bounds.where(F.col("n") >= least).select("pos", "lower", "upper").collect() if r["lower"] is not None}
    cols = [c for c in numeric(df) if c.pos in known]

    def beyond(c: Col) -> Column:
        v, (low, high) = ref(c.name).cast("double"), known[c.pos]
        return F.count(F.when((v < low) | (v > high), 1))

    return per_column(df, cols, {"outliers": beyond}).select("pos", F.col("outliers").cast("long").alias("outliers"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
