"""Correlations, associations and functional dependencies."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.columns import columns, normal, numeric, ref
from millrace.operators import moments, stats

# Fixed values
NOTABLE = 0.3  # correlation of a pair that is listed
REDUNDANT = 0.95  # correlation of columns of which one is enough
SURE = 0.95  # share of determinants with one value


def matrix(df: DataFrame) -> DataFrame:
    """a, b and r (4 digits; null where one is constant) of each pair of numeric columns over the rows that have both: one scan."""
    df = normal(df)
    cols = numeric(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "pos_a int, pos_b int, a string, b string, r double")
    names = df.sparkSession.createDataFrame([(a.pos, b.pos, a.name, b.name) for a, b in combinations(cols, 2)], "pos_a int, pos_b int, a string, b string")
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")))
    return names.join(moments.pairs(df, cols), ["pos_a", "pos_b"], "left").select("pos_a", "pos_b", "a", "b", F.round(r, 4).alias("r"))


def pairs(df: DataFrame, limit: int = 20) -> DataFrame:
    """The strongest notable pairs."""
    strong = matrix(df).where(F.abs("r") > NOTABLE)
    return strong.orderBy(F.desc(F.abs("r")), "pos_a", "pos_b").limit(limit).select("a", "b", "r")


def redundant(df: DataFrame) -> DataFrame:
    return matrix(df).where(F.abs("r") > REDUNDANT).select("a", "b", "r")


def cramers_v(df: DataFrame, most: int = 50, least_rows: int = 10) -> DataFrame:
    """a, b and v of each pair of text columns with at most ``most`` values: one shuffle for all pairs.

    Only cells that occur are counted; all others have the statistic of their
    expected value, which the marginals give. Marginals have at most ``most`` rows.
    """
    df = normal(df)
    freq = stats.distincts(stats.frequency(df, columns(df, "text"))).where(F.col("distinct") <= most).select("pos")
    few = {r[0] for r in freq.collect()}
    cols = [c for c in columns(df, "text") if c.pos in few]
    empty = df.sparkSession.createDataFrame([], "a string, b string, v double")
    if len(cols) < 2:
        return empty
    cells = [F.struct(F.lit(a.name).alias("a"), F.lit(b.name).alias("b"), ref(a.name).alias("x"), ref(b.name).alias("y")) for a, b in combinations(cols, 2)]
    seen = df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    rows = seen.groupBy("a", "b", "x").agg(F.sum("o").alias("rx"))
    cols_ = seen.groupBy("a", "b", "y").agg(F.sum("o").alias("cy"))
    size = seen.groupBy("a", "b").agg(F.sum("o").alias("n"))
    grid = rows.join(cols_, ["a", "b"]).join(size, ["a", "b"]).join(seen, ["a", "b", "x", "y"], "left")
    e = F.col("rx") * F.col("cy") / F.col("n")
    chi = grid.groupBy("a", "b").agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, F.lit(2)) / (e + 1e-10)).alias("chi"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"), F.max("n").alias("n"))
    v = F.coalesce(F.try_divide(F.col("chi"), F.col("n") * (F.least("nx", "ny") - 1)), F.lit(0.0))
    return chi.where(F.col("n") >= least_rows).select("a", "b", F.round(F.sqrt(v), 4).alias("v"))


def associations(df: DataFrame, limit: int = 20) -> DataFrame:
    return cramers_v(df).where(F.col("v") > NOTABLE).orderBy(F.desc("v"), "a", "b").limit(limit)


def functional_dependencies(df: DataFrame, most: int = 200, limit: int = 20) -> DataFrame:
    """determinant, dependent and confidence: the share of determinant values with one dependent value.

    A group has one value if its least and greatest agree, so no set of values is kept.
    """
    df = normal(df)
    sizes = stats.distincts(stats.frequency(df)).where(F.col("distinct").between(2, most)).select("pos")
    few = {r[0] for r in sizes.collect()}
    usable = columns(df, "integer", "float", "text", "boolean", "temporal")
    det = [c for c in usable if c.pos in few]
    if not det:
        return df.sparkSession.createDataFrame([], "determinant string, dependent string, confidence double")
    keys = F.explode(F.array(*(F.struct(F.lit(c.pos).alias("pos"), ref(c.name).cast("string").alias("value")) for c in det)))
    cells = df.select(keys.alias("k"), *(ref(c.name).alias(f"d{c.pos}") for c in usable)).where("k.value IS NOT NULL")
    groups = cells.groupBy("k.pos", "k.value").agg(*(f(f"d{c.pos}").alias(f"{n}{c.pos}") for c in usable for n, f in (("lo", F.min), ("hi", F.max))))
    # the comparison is null for a group whose dependent is null throughout, which doesn't count
    shares = groups.groupBy("pos").agg(*(F.avg((F.col(f"lo{c.pos}") == F.col(f"hi{c.pos}")).cast("double")).alias(f"s{c.pos}") for c in usable))
    names = F.create_map(*(x for c in det for x in (F.lit(c.pos), F.lit(c.name))))
    rows = F.explode(F.array(*(F.struct(F.lit(c.pos).alias("to"), F.lit(c.name).alias("dependent"), F.col(f"s{c.pos}").alias("confidence")) for c in usable)))
    out = shares.select("pos", rows.alias("r")).where((F.col("r.to") != F.col("pos")) & (F.col("r.confidence") > SURE))
    ranked = out.withColumn("rank", F.row_number().over(Window.orderBy("pos", "r.to"))).where(F.col("rank") <= limit)  # one row per pair of columns
    return ranked.select(names[F.col("pos")].alias("determinant"), "r.dependent", F.round("r.confidence", 3).alias("confidence"))
