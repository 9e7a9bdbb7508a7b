"""Isolation forest on a single column.

On one column a tree is a step function. Trees are grown from bounded samples
of the column by their seeds; their average path lengths form a table of
thresholds by which every row is scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.columns import ref
from millrace.sources import folders

TREES = 100
SAMPLE = 256
POOL = 4 * TREES * SAMPLE


def expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def leaves(values: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list[float], list[float]]:
    """One random tree over the values as a step function: cuts in ascending order, and path lengths between them (one more)."""
    cuts: list[float] = []
    lengths: list[float] = []
    stack: list[tuple[np.ndarray, int] | float] = [(np.sort(values), 0)]
    while stack:
        top = stack.pop()
        if isinstance(top, float):
            cuts.append(top)
            continue
        own, depth = top
        if depth >= limit or len(own) <= 1 or own[0] == own[-1]:
            lengths.append(depth + expected(len(own)))
            continue
        cut = float(rng.uniform(own[0], own[-1]))
        k = np.searchsorted(own, cut)
        stack += [(own[k:], depth + 1), cut, (own[:k], depth + 1)]
    return cuts, lengths


def forest(df: DataFrame, v: Column, seed: int) -> DataFrame:
    """tree, cuts and lengths: a tree in each group, over ``SAMPLE`` values of its own.

    A threshold on a hash of the row leaves a pool of about ``POOL`` rows, and a second one
    deals each tree about twice its values, so that no task sees more.
    """
    total = df.count()
    draw = lambda *x: F.xxhash64("uid", "v", F.lit(seed), *x)
    at_most = lambda wanted, all_: (1 << 63) - 1 if wanted >= all_ else -(1 << 63) + (1 << 64) * wanted // all_
    rows = df.select(v.alias("v"), F.monotonically_increasing_id().alias("uid"))
    pool = folders.stored(rows.where(draw() <= at_most(POOL, total)), "pool")
    size = pool.count()
    trees = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: draw(t) <= at_most(2 * SAMPLE + 100, size))
    dealt = pool.select("v", "uid", F.explode(trees).alias("tree")).withColumn("draw", draw("tree"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        own = part.sort_values("draw").head(SAMPLE)["v"].to_numpy(float)
        tree = int(part["tree"].iloc[0])
        cuts, lengths = leaves(own, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(own), 2)))))
        return pd.DataFrame({"tree": [tree], "size": [len(own)], "cuts": [cuts], "lengths": [lengths]})

    return dealt.groupBy("tree").applyInPandas(grow, "tree int, size int, cuts array<double>, lengths array<double>")


def isolated(df: DataFrame, column: str, contamination: float = 0.05, seed: int = 42) -> Column:
    """Whether a row is among the ``contamination`` share that the forest isolates first; nulls count as 0.

    Trees are grown in tasks, on at most ``SAMPLE`` values each. Their mean is a step
    function with at most ``TREES`` times ``SAMPLE`` steps, which comes to the driver; every row is scored
    by its step, and the threshold comes from the scores of all rows.
    """
    v = F.coalesce(ref(column).cast("double"), F.lit(0.0))
    rows = df.select(v.alias("v"))
    trees = forest(df, v, seed).collect()
    cuts = np.unique(np.concatenate([np.array(t["cuts"]) for t in trees])) if trees else np.zeros(0)
    if not len(cuts):
        return F.lit(False)
    inside = np.append(cuts, np.inf)  # a step ends before its cut
    path = np.mean([np.array(t["lengths"])[np.searchsorted(np.array(t["cuts"]), inside, side="left")] for t in trees], axis=0)
    score = np.round(2.0 ** (-path / expected(max(t["size"] for t in trees))), 12)
    edges = [float("-inf"), *cuts.tolist(), float("inf")]
    dealt = Bucketizer(splits=edges, inputCol="v", outputCol="b").transform(rows).groupBy("b").count().collect()
    n = np.zeros(len(score))
    for b, count in dealt:
        n[int(b)] = count
    # the share of rows with a higher score may be at most the contamination
    order = np.argsort(-score, kind="stable")
    first = np.flatnonzero(np.cumsum(n[order]) > contamination * n.sum())[0]
    odd = score > score[order[first]]
    begins = np.flatnonzero(odd & ~np.append(False, odd[:-1]))
    ends = np.flatnonzero(odd & ~np.append(odd[1:], False))
    test = F.lit(False)
    for a, b in zip(begins, ends):
        test = test | ((v >= edges[a]) & (v < edges[b + 1]))
    return test
