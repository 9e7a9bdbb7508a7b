"""k-nearest-neighbour imputation over numeric columns, and fuzzy duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.columns import columns, numeric, ref

PIVOTS = 1024  # most pivots; there are about as many as the root of the donors
PATTERNS = 16  # patterns of known columns that have cells of their own
DONORS, HOLES = 8192, 2048  # of a cell that meet in one task at a time
SQUARE = 1 << 20  # distances that are held at a time
SETTLED = 8192  # rows of a range in which fuzzy duplicates are settled
COMPARED, BLOCKS = 1024, 16  # rows of a block whose texts are compared, and blocks of a task
BAGS = 64  # counters of a text's characters; as many code points fit a word of bits
MET, PAIRS = 1 << 18, 1 << 14  # pairs of places, and different pairs of texts, that are looked at at a time
SLACK = 1 - 1e-9  # bounds are lowered by rounding errors


class Cells:
    """Cells of the donors: their box, how many donors they have, and which columns these know."""

    def __init__(self, stats: pd.DataFrame, columns: int, patterns: list[int]) -> None:
        self.cell = stats["cell"].to_numpy()
        self.rows = stats["rows"].to_numpy(float)
        self.low = stats[[f"lo{j}" for j in range(columns)]].to_numpy(float)
        self.high = stats[[f"hi{j}" for j in range(columns)]].to_numpy(float)
        pattern = self.cell // PIVOTS
        self.mixed = pattern == len(patterns)
        masks = np.array([*patterns, (1 << columns) - 1], object)[pattern]
        self.known = np.array([[m >> j & 1 == 1 for j in range(columns)] for m in masks], bool).reshape(len(stats), columns)
        self.filled = stats[[f"n{j}" for j in range(columns)]].to_numpy(float)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance (squared, scaled) of each row to donors of each cell that share a column with it.

        A cell of one pattern is bounded by its box in the shared columns. In a mixed
        cell any shared columns may be all there are: the closest and the farthest column bound it.
        """
        n = x.shape[1]
        least, most, both = (np.zeros((len(x), len(self.cell))) for _ in range(3))
        nearest, farthest = np.full(least.shape, np.inf), np.zeros(least.shape)
        with np.errstate(invalid="ignore"):
            for j in range(n):
                v = x[:, j, None]
                shared = ~np.isnan(v) & self.known[:, j] & (self.filled[:, j] > 0)
                near = np.where(shared, np.maximum(np.maximum(self.low[:, j] - v, v - self.high[:, j]), 0.0) ** 2, 0.0)
                far = np.where(shared, np.maximum(np.abs(v - self.low[:, j]), np.abs(v - self.high[:, j])) ** 2, 0.0)
                least += near
                most += far
                both += shared
                nearest = np.where(shared, np.minimum(nearest, near), nearest)
                farthest = np.maximum(farthest, far)
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.where(self.mixed, nearest * n, least * n / both)
            high = np.where(self.mixed, farthest * n, most * n / both)
        return np.where(both > 0, low * SLACK, np.inf), np.where(both > 0, high / SLACK, np.inf)

    def targets(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row and the place of a cell that may hold one of its k nearest donors of a column it lacks.

        Cells by their largest distance tell within which radius k donors surely are.
        Donors of a mixed cell needn't share a column, so they don't count there.
        """
        least, most = self.bounds(x)
        wanted = np.zeros(least.shape, bool)
        for j in range(x.shape[1]):
            rows = np.flatnonzero(np.isnan(x[:, j]))
            have = np.flatnonzero(self.filled[:, j] > 0)
            if not len(rows) or not len(have):
                continue
            own = most[np.ix_(rows, have)]
            sure = np.where(self.mixed[have], 0.0, self.filled[have, j])
            order = np.argsort(own, axis=1, kind="stable")
            upto = np.cumsum(sure[order], axis=1)
            place = np.argmax(upto >= k, axis=1)
            radius = np.where(upto[:, -1] >= k, np.take_along_axis(own, np.take_along_axis(order, place[:, None], 1), 1)[:, 0], np.inf)
            near = least[np.ix_(rows, have)]
            wanted[np.ix_(rows, have)] |= (near <= radius[:, None]) & np.isfinite(near)
        return np.nonzero(wanted)


def nearest(holes: np.ndarray, donors: np.ndarray, ties: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each column: rows that lack it, places of their k nearest donors, and the squared distances (infinite where no column is shared).

    ``donors`` are in the order of ``ties``.
    """
    square, both = np.zeros((len(holes), len(donors))), np.zeros((len(holes), len(donors)))
    for j in range(holes.shape[1]):
        gap = holes[:, j, None] - donors[None, :, j]
        known = ~np.isnan(gap)
        square += np.where(known, gap * gap, 0.0)
        both += known
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(both > 0, square * holes.shape[1] / both, np.inf)
    for j in range(holes.shape[1]):
        gap, may = np.flatnonzero(np.isnan(holes[:, j])), np.flatnonzero(~np.isnan(donors[:, j]))
        if len(gap) and len(may):
            own = far[np.ix_(gap, may)]
            if own.shape[1] > k:
                # the k smallest with all that equal the last of them, so that ties are decided by their order
                limit = np.partition(own, k - 1, axis=1)[:, k - 1 : k]
                own = np.where(own <= limit, own, np.inf)
            first = np.argsort(own, axis=1, kind="stable")[:, :k]
            yield j, gap, may[first], np.take_along_axis(own, first, 1)


def knn_impute(df: DataFrame, k: int = 5) -> DataFrame:
    """Fill the nulls of every numeric column with the mean of its k nearest donors that have a value.

    Distances are Euclidean over the columns both rows have, scaled by how many
    there are; ties go by a hash of the donor. All rows with a value are donors.
    Rows that share no column with any donor get the mean of the column.

    An exact join by pivots: donors are dealt to their nearest pivot, apart for each
    of the ``PATTERNS`` most frequent patterns of known columns. The box of a cell
    bounds the distance of its donors from both sides in whatever columns a row has.
    Within some radius a row surely has k donors, and only cells that reach into it
    are looked at. Cells meet their rows in blocks of at most ``DONORS`` and
    ``HOLES``, which bounds memory however many rows a cell has. Equal donors are one
    row, with at most k copies. Blocks return k donors for each row at most, and a
    limit of k runs before and after the shuffle that brings them together.

    The driver sees the boxes: a row for each of at most ``PIVOTS`` times ``PATTERNS`` + 1 cells.
    """
    from millrace.sources import folders

    cols = [c.name for c in numeric(df)]
    if len(cols) < 2:
        return df
    spark, n = df.sparkSession, len(cols)
    folders.ensure(spark)
    names = [f"v{j}" for j in range(n)]
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(ref(c) for c in df.columns)).alias("row")).checkpoint()
    numbers = rows.select("uid", *(F.col("row")[c].cast("double").alias(v) for c, v in zip(cols, names)))
    holes = numbers.where(" OR ".join(f"{v} IS NULL" for v in names)).where(F.coalesce(*names).isNotNull())
    mask: Column = sum((F.when(F.col(v).isNotNull(), F.lit(1 << j)).otherwise(0) for j, v in enumerate(names)), F.lit(0)).cast("long")
    donors = numbers.where(F.coalesce(*names).isNotNull()).groupBy(*names).agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    donors = donors.select(F.xxhash64(*names, F.lit(42)).alias("tie"), mask.alias("mask"), "copies", *names).checkpoint()
    total = donors.count()
    if not total or holes.isEmpty():
        return filled_with(df, rows, cols, names, None, numbers)
    # pivots: donors with the smallest of other hashes; a threshold leaves about twice as many to choose from
    most = max(1, min(PIVOTS, isqrt(total)))
    draw = F.xxhash64("tie", F.lit(7))
    limit = (1 << 63) - 1 if total <= 2 * most else -(1 << 63) + (1 << 64) * 2 * most // total
    pivots = donors.where(draw <= limit).orderBy(draw).limit(most).toPandas()[names].to_numpy(float)
    frequent = donors.groupBy("mask").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), "mask").limit(PATTERNS)
    patterns = [r[0] for r in frequent.collect()]
    given = spark.sparkContext.broadcast((pivots, patterns))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cell of each donor: its pattern and its nearest pivot in the columns both have."""
        at, known = given.value
        for part in parts:
            x, cell = part[names].to_numpy(float), np.zeros(len(part), np.int64)
            step = max(1, SQUARE // len(at))
            for a in range(0, len(x), step):
                far = np.zeros((len(x[a : a + step]), len(at)))
                for j in range(x.shape[1]):
                    gap = x[a : a + step, j, None] - at[None, :, j]
                    far += np.where(np.isnan(gap), 0.0, gap * gap)
                cell[a : a + step] = far.argmin(axis=1)
            pattern = part["mask"].map({m: p for p, m in enumerate(known)}).fillna(len(known)).to_numpy(np.int64)
            yield part.assign(cell=pattern * PIVOTS + cell).drop(columns="mask")

    doubles = ", ".join(f"{v} double" for v in names)
    dealt = donors.mapInPandas(deal, f"tie long, copies int, {doubles}, cell long").checkpoint()
    boxes = [f(v).alias(f"{p}{j}") for j, v in enumerate(names) for p, f in (("lo", F.min), ("hi", F.max))]
    filled = [F.sum(F.when(F.col(v).isNotNull(), F.col("copies")).otherwise(0)).alias(f"n{j}") for j, v in enumerate(names)]
    boxed = dealt.groupBy("cell").agg(F.count("*").alias("rows"), *boxes, *filled).toPandas()
    table = spark.sparkContext.broadcast(Cells(boxed, n, patterns))

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = table.value
        step = max(1, SQUARE // len(cells.cell))
        for part in parts:
            x = part[names].to_numpy(float)
            for a in range(0, len(x), step):
                own, cell = cells.targets(x[a : a + step], k)
                yield part.iloc[a + own].assign(cell=cells.cell[cell])

    routed = holes.mapInPandas(route, f"uid long, {doubles}, cell long").checkpoint()
    met = routed.groupBy("cell").agg(F.count("*").alias("holes"))
    sizes = spark.createDataFrame(boxed[["cell", "rows"]])
    plan = sizes.join(met, "cell").select("cell", F.ceil(F.col("rows") / DONORS).cast("int").alias("dparts"), F.ceil(F.col("holes") / HOLES).cast("int").alias("hparts"))
    plan = F.broadcast(plan)  # a row for each cell
    each = lambda parts, name: F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias(name)
    part = lambda key, parts, name: F.pmod(F.xxhash64(key, F.lit(1)), F.col(parts)).cast("int").alias(name)
    left = routed.join(plan, "cell").select("cell", part("uid", "hparts", "hp"), each("dparts", "dp"), "uid", *names)
    right = dealt.join(plan, "cell").select("cell", each("hparts", "hp"), part("tie", "dparts", "dp"), "tie", "copies", *names)

    def local(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.sort_values("tie", kind="stable")
        x, y, uid = own[names].to_numpy(float), others[names].to_numpy(float), own["uid"].to_numpy()
        tie, copies = others["tie"].to_numpy(), others["copies"].to_numpy()
        out = []
        step = max(1, SQUARE // max(1, len(y)))
        for a in range(0, len(x) if len(y) else 0, step):
            for j, gap, place, far in nearest(x[a : a + step], y, tie, k):
                keep = np.isfinite(far)
                near = place[keep]
                out.append(pd.DataFrame({"uid": np.repeat(uid[a + gap], keep.sum(axis=1)), "j": j, "far": far[keep], "tie": tie[near], "value": y[near, j], "copies": copies[near]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("uid", "j", "far", "tie", "value", "copies")})

    keys = ("cell", "hp", "dp")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(local, "uid long, j int, far double, tie long, value double, copies int")
    one = near.select("uid", "j", "far", "tie", "value", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    order = Window.partitionBy("uid", "j").orderBy("far", "tie", "value", "copy")
    best = one.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    means = best.groupBy("uid").agg(*(F.avg(F.when(F.col("j") == j, F.col("value"))).alias(v) for j, v in enumerate(names)))
    return filled_with(df, rows, cols, names, means, numbers)


def filled_with(df: DataFrame, rows: DataFrame, cols: list[str], names: list[str], means: DataFrame | None, numbers: DataFrame) -> DataFrame:
    """The rows with their own values, else those of their neighbours, else the mean of the column."""
    whole = numbers.agg(*(F.avg(v).alias(f"m{j}") for j, v in enumerate(names)))
    out = rows.crossJoin(F.broadcast(whole))
    near = means.select("uid", *(F.col(v).alias(f"own{j}") for j, v in enumerate(names))) if means is not None else None
    out = out.join(near, "uid", "left") if near is not None else out
    at = {c: j for j, c in enumerate(cols)}
    pick = lambda c: F.coalesce(F.col("row")[c].cast("double"), *([F.col(f"own{at[c]}")] if near is not None else []), F.col(f"m{at[c]}"))
    return out.select(*((pick(c) if c in at else F.col("row")[c]).alias(c) for c in df.columns))


def settled(edges: pd.DataFrame, gone: set[int]) -> list[int]:
    """Rows that go, in the order of rows: those similar to an earlier one that stays. gone: rows before these that went."""
    out = set(gone)
    for j, i in zip(edges["j"].tolist(), edges["i"].tolist()):
        if i not in out:
            out.add(j)
    return sorted(out - gone)


def fuzzy_duplicates(df: DataFrame, column: str, order_by: list[str], threshold: int = 85, window: int = 100) -> DataFrame:
    """Drop rows whose text is similar to that of a kept row among the ``window`` - 1 before them.

    Rows are numbered in the given order. Blocks of at least ``COMPARED`` rows get the ``window`` - 1 rows
    before them as well, and a block finds its similar pairs at once (``similar``), so that only these leave it.
    The greedy order is settled in ranges of at least ``SETTLED`` rows, all at once, as if
    no row before a range had gone. A range that has rows similar to some of the last
    ``window`` - 1 rows before it is settled anew when what went of these has changed. So there are as
    many rounds as ranges that a chain of such changes crosses, not as links.
    """
    from millrace.operators import ordering
    from millrace.sources import folders

    span = window - 1
    size = max(SETTLED, span)
    key = ref(order_by[0]).cast("long")
    usable = [c.name for c in columns(df, "integer", "float", "text", "boolean", "temporal")]
    order = [*order_by[1:], *usable]
    rows = df.where(ref(column).isNotNull()).select(key.alias("key"), *(ref(c).alias(f"o{k}") for k, c in enumerate(order)), F.struct(*(ref(c) for c in df.columns)).alias("whole"))
    numbered = folders.stored(ordering.numbered(rows, "key", [f"o{k}" for k in range(len(order))]).select("idx", "whole"), "numbered")
    block = max(COMPARED, span)
    own = F.floor(F.col("idx") / block)
    blocks = F.when(F.col("idx") % block >= block - span, F.array(own, own + 1)).otherwise(F.array(own))
    texts = numbered.select("idx", F.col("whole")[column].cast("string").alias("t"), F.explode(blocks).alias("block"))
    tasks = max(1, min(ordering.MOST_RANGES, numbered.count() // (block * BLOCKS)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        idx = rows["idx"].to_numpy()
        i, j = similar(rows["t"].tolist(), span, threshold)
        later = idx[j] >= rows["block"].iloc[0] * block
        return pd.DataFrame({"range": idx[j[later]] // size, "i": idx[i[later]], "j": idx[j[later]]})

    # a number of tasks is given, since few bytes are much work here
    edges = folders.stored(texts.repartition(tasks, "block").groupBy("block").applyInPandas(compare, "range long, i long, j long"), "edges")

    def settle(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"range": [], "j": []})
        went = settled(own.sort_values(["j", "i"]), set(before["j"].tolist()))
        return pd.DataFrame({"range": own["range"].iloc[0], "j": went})

    def rounds(some: DataFrame, known: DataFrame) -> DataFrame:
        return some.groupBy("range").cogroup(known.groupBy("range")).applyInPandas(settle, "range long, j long")

    def ends(gone: DataFrame) -> DataFrame:
        """For each range, what went of the rows before it that can be similar to its own."""
        return gone.where(F.col("j") % size >= size - span).select((F.col("range") + 1).alias("range"), "j")

    nothing = df.sparkSession.createDataFrame([], "range long, j long")
    used, gone = nothing, folders.stored(rounds(edges, nothing), "gone")
    while True:
        now = folders.stored(ends(gone).join(edges.select("range").distinct(), "range", "left_semi"), "ends")
        changed = folders.stored(now.subtract(used).union(used.subtract(now)).select("range").distinct(), "changed")
        if changed.isEmpty():
            break
        anew = rounds(edges.join(changed, "range", "left_semi"), now.join(changed, "range", "left_semi"))
        used, gone = now, folders.stored(gone.join(changed, "range", "left_anti").unionByName(anew), "gone")
    stays = numbered.join(gone.select(F.col("j").alias("idx")), "idx", "left_anti").select(*(F.col("whole")[c].alias(c) for c in df.columns))
    return stays.unionByName(df.where(ref(column).isNull()))


def similarity(a: str, b: str) -> int:
    """100 times twice the longest common subsequence over both lengths, by bit-parallel rows."""
    if not a and not b:
        return 100
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        x = row & where.get(c, 0)
        row = ((row + x) | (row - x)) & full
    common = len(a) - row.bit_count()
    return round(200 * common / (len(a) + len(b)))


def similar(texts: list[str], span: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places i < j, at most ``span`` apart, whose texts have a ``similarity`` of at least ``threshold``.

    Equal pairs of texts are compared once. Lengths, then numbers of characters (dealt to ``BAGS``
    counters) bound the common subsequence; where the bound is too low, it isn't searched.
    """
    distinct = list(dict.fromkeys(texts))
    of_text = {t: k for k, t in enumerate(distinct)}
    code = np.array([of_text[t] for t in texts], np.int64)
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in distinct]
    length = np.array([len(p) for p in points], np.int64)
    bags = np.array([np.bincount(p % BAGS, minlength=BAGS) for p in points], np.int32).reshape(-1, BAGS)
    short = length <= BAGS

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether these pairs of distinct texts are similar."""

        def reached(common: np.ndarray, some: np.ndarray) -> np.ndarray:
            both = (length[a[some]] + length[b[some]]).astype(float)
            return np.rint(np.where(both > 0, 200 * common / np.maximum(both, 1), 100.0)) >= threshold

        near = reached(np.minimum(length[a], length[b]), np.arange(len(a)))
        for part in cut(np.flatnonzero(near)):
            near[part] = reached(np.minimum(bags[a[part]], bags[b[part]]).sum(axis=1), part)
        left = near & (a != b)
        for part in cut(np.flatnonzero(left & short[a] & short[b])):
            near[part] = reached(common_parts(padded(points, a[part], -1), padded(points, b[part], -2)), part)
        for k in np.flatnonzero(left & ~(short[a] & short[b])):
            near[k] = similarity(distinct[a[k]], distinct[b[k]]) >= threshold
        return near

    found = [np.zeros((2, 0), np.int64)]
    most, width = min(span, len(texts) - 1), max(1, MET // max(1, len(texts)))
    for first in range(1, most + 1, width):
        step = np.arange(first, min(first + width, most + 1))
        i = np.repeat(np.arange(len(texts)), len(step))
        j = i + np.tile(step, len(texts))
        i, j = i[j < len(texts)], j[j < len(texts)]
        keys, pair = np.unique(np.minimum(code[i], code[j]) * len(distinct) + np.maximum(code[i], code[j]), return_inverse=True)
        own = alike(*np.divmod(keys, len(distinct)))[pair]
        found.append(np.stack([i[own], j[own]]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def cut(places: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(places), PAIRS):
        yield places[k : k + PAIRS]


def padded(points: list[np.ndarray], some: np.ndarray, filler: int) -> np.ndarray:
    """Code points of the texts by place (a row) and text (a column), as far as the longest goes."""
    own, place = np.unique(some, return_inverse=True)
    out = np.full((max((len(points[k]) for k in own), default=0), len(own)), filler, np.int32)
    for c, k in enumerate(own):
        out[: len(points[k]), c] = points[k]
    return out[:, place]


def common_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the columns, as in ``similarity``, all pairs at once; a has at most 64 rows."""
    row = np.full(a.shape[1], ~np.uint64(0))
    for y in b:
        hit = np.zeros_like(row)
        for p, x in enumerate(a):
            hit |= (x == y).astype(np.uint64) << np.uint64(p)
        hit &= row
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row).astype(np.int64)
