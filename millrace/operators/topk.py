"""The first rows of each group, with k rows kept in each task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def firsts(rows: DataFrame, group: str, order: dict[str, bool], k: int) -> DataFrame:
    """The k first rows of each group, with ``rank``. order: columns without nulls, and whether they ascend.

    A task keeps k rows for each of its groups, whatever it reads; groups are columns
    of a table or the like, so there are few.
    """
    keys, ascending = [group, *order], [True, *order.values()]

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:
            both = part if best is None else pd.concat([best, part])
            best = both.sort_values(keys, ascending=ascending, kind="stable").groupby(group, sort=False).head(k)
        if best is not None:
            yield best

    near = rows.mapInPandas(keep, rows.schema)
    over = Window.partitionBy(group).orderBy(*(F.asc(c) if up else F.desc(c) for c, up in order.items()))
    return near.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
