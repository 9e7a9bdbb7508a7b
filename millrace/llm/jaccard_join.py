"""N-gram Jaccard join with set-relation skipping.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches 4/5, exactly. The join is a prefix-filter join on Spark: tokens are
ordered from rare to frequent, and linked sets share a token among the first
fifth of either. Two relations between sets keep it small:

* Index level: an inverted list is split into blocks by the sets' sizes, the
  places of the token in them and their components. Blocks meet as wholes first:
  the largest remainder behind the token and the smallest size in two blocks
  bound what their sets can share, so blocks too far down the list are skipped,
  and so are blocks of one component. Only entries of blocks that remain meet.
* Answer level: equal sets are one set. Then each set is compared with a highly
  similar leader, the one with the most frequent tokens among sets with the same
  minimum hash. Sets linked with their leader share its component, and lists
  whose sets are all of one component are dropped: their answers follow from the
  leader's. Only pairs of sets of different components are formed, so many copies
  and a single other set in a list meet once for each copy.

Pairs pass a bound by parity bitmaps (the number of bits that differ is at most
the number of tokens that differ), which rejects no link, and the rest are
verified on whole sets. Links and their components follow.

The order of tokens comes from counts of all shingles of the corpus, in a sketch
of ``BUCKETS`` counters that has the same size for any corpus. Any order is
exact; a good one is quick. Tokens are known by 64-bit hashes and sets by 128-bit
ones.

Defined results: a text without words, or null, has an empty set and links with
nothing, not even its copies. The component of a document is named by the
smallest non-null id in it; rows with equal ids are separate documents; rows that
are equal altogether are one set and link; sets at exactly 4/5 link. An empty table
gives an empty one; a text of any length is one set. Other columns are ignored,
whatever their names are. ``docs`` must read the same rows in the same order each
time, as files do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm import textrows as tr
from millrace.llm.graph import components

SHINGLE = 5
BUCKETS = 1 << 20
BLOCK = 1 << 13
HASHES = 6  # minimum hashes by which a leader is looked for
LEAST_BITS = 256
PLACES = 40  # blocks of places in a whole set; entries lie in its first fifth
PER_LEADER = 256  # sets compared with a leader in one group
SHINGLES = 1 << 22  # of all sets in such a group
FACTOR = np.uint64(0x9E3779B97F4A7C15)

# 100 * both >= 80 * either is 9 * both >= 4 * (n + m): at least 4 n / 5 of a set
# are shared, and 8 n / 9 of the smaller one.


def probe_prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


#: Tokens of a set that meet sets of its size or larger ones.
INDEX_PREFIX = "n - (8 * n + 8) div 9 + 1"


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in a row; and the bounds of the texts."""
    w = tr.words(texts, tr.SPACE, tr.LOWER)
    codes, distinct = w.coded()
    h = tr.word_hashes(codes, distinct)
    n = np.diff(w.first)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * FACTOR + h[k : len(h) - size + 1 + k]
    rolled = tr.mixed(rolled)
    out, sizes = [], np.zeros(len(n), np.int64)
    for k in range(len(n)):
        a, b = w.first[k], w.first[k + 1]
        if n[k] >= size:
            own = np.unique(rolled[a : b - size + 1])
        elif n[k]:
            whole = np.uint64(n[k])
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * FACTOR + x
            own = tr.mixed(np.array([whole]))
        else:
            continue
        out.append(own)
        sizes[k] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(sizes))


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def bits_of(n: int) -> int:
    return max(LEAST_BITS, 1 << max(0, 2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each bit."""
    bits = bits_of(len(tokens))
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ, a lower bound for the tokens that do. The larger map is folded to the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # bit t of the half is the parity of bits t and t + half
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def texts_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))


def frequencies(rows: DataFrame) -> np.ndarray:
    """Counts of all shingles (once per row) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in tr.slices(batch, "text"):
                total += np.bincount(bucket_of(shingle_sets(part.column("text"))[0]), minlength=BUCKETS)
        yield shared.in_blocks(total, BLOCK)

    got = shared.joined_blocks(shared.summed(rows.select("text").mapInArrow(run, "block int, data binary"), "i8"), "i8")
    return np.zeros(BUCKETS, np.int64) if got is None else got


def described(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """uid, id, n, hash (of the set; null: empty), bits, mins, common (how frequent its tokens are) and prefix (tokens from rare to frequent)."""
    given = rows.sparkSession.sparkContext.broadcast(counts)
    seeds = tr.mixed(np.arange(1, HASHES + 1, dtype=np.uint64))
    names = ["uid", "id", "n", "hash", "bits", "mins", "common", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = given.value
        for batch in batches:
            for part in tr.slices(batch, "text"):
                tokens, bounds = shingle_sets(part.column("text"))
                n = np.diff(bounds)
                count = counts[bucket_of(tokens)]
                some = np.flatnonzero(n)
                if len(some):
                    mins = np.stack([np.minimum.reduceat(tr.mixed(tokens ^ s), bounds[:-1][some]) for s in seeds], axis=1)
                    common = np.add.reduceat(np.log1p(count), bounds[:-1][some]) / n[some]
                hashes, bits, prefix = [], [], []
                for k in some:
                    own, c = tokens[bounds[k] : bounds[k + 1]], count[bounds[k] : bounds[k + 1]]
                    hashes.append(xxhash.xxh3_128_digest(own.tobytes()))
                    bits.append(bitmap(own))
                    prefix.append(own[np.lexsort((own, c))[: probe_prefix(len(own))]].view(np.int64))
                place = np.full(len(n), -1, np.int64)
                place[some] = np.arange(len(some))
                at = pa.array(place, mask=place < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in prefix])), pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
                low = pa.FixedSizeListArray.from_arrays(pa.array(mins.view(np.int64).ravel() if len(some) else np.zeros(0, np.int64)), HASHES).cast(pa.list_(pa.int64()))
                columns = [pa.array(hashes, pa.binary()), pa.array(bits, pa.binary()), low, pa.array(common if len(some) else np.zeros(0)), lists]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("id"), pa.array(n), *(x.take(at) for x in columns)], names=names)

    kinds = f"uid long, id {rows.schema['id'].dataType.simpleString()}, n long, hash binary, bits binary, mins array<long>, common double, prefix array<long>"
    return rows.mapInArrow(run, kinds)


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y, nx, ny and far (bits that differ) of the pairs that may link by their bitmaps."""
    mine = sets.select("key", "n", "bits")
    both = pairs.join(mine.withColumnsRenamed({"key": "x", "n": "nx", "bits": "bx"}), "x").join(mine.withColumnsRenamed({"key": "y", "n": "ny", "bits": "by"}), "y")
    both = both.where("4 * greatest(nx, ny) <= 5 * least(nx, ny)").select("x", "y", "nx", "ny", "bx", "by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.fromiter((differing(p, q) for p, q in zip(b.column("bx").to_pylist(), b.column("by").to_pylist())), np.int64, b.num_rows)
            most = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "y", "nx", "ny")), pa.array(far)], names=["x", "y", "nx", "ny", "far"])
            yield out.filter(pa.array(9 * far <= most))

    return both.mapInArrow(run, "x long, y long, nx long, ny long, far long")


def leaders(sets: DataFrame) -> DataFrame:
    """x, y and nx: a set, the most similar of its leaders, if any, and its size."""
    each = sets.select("key", "common", F.posexplode("mins").alias("k", "h"))
    best = each.groupBy("k", "h").agg(F.max(F.struct("common", "key")).alias("best"), F.count("*").alias("c")).where("c > 1").select("k", "h", F.col("best.key").alias("y"))
    pairs = each.join(best, ["k", "h"]).where("key <> y").select(F.col("key").alias("x"), "y").distinct()
    return near(pairs, sets).groupBy("x", "nx").agg(F.min(F.struct("far", "y")).alias("best")).select("x", F.col("best.y").alias("y"), "nx")


def whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and tokens (bytes) of the rows whose uid is a ``key`` of wanted; others are ruled out by a Bloom filter first.

    The filter has 16 bits for each wanted set and 8 MB at most; what it lets
    through beyond that falls in the join.
    """
    spark = rows.sparkSession
    bits = 1 << min(26, max(16, (16 * wanted.count()).bit_length()))
    width = 8 * BLOCK  # bits in a block

    def slot(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(bits))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("slot").to_numpy()
            for block in np.unique(at // width).tolist():
                own = on.setdefault(block, np.zeros(width, bool))
                own[at[at // width == block] % width] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(on), pa.int32()), pa.array([np.packbits(x).tobytes() for x in on.values()], pa.binary())], names=["block", "data"])

    slots = wanted.select(slot("key").alias("slot"))
    marked = np.zeros(bits, bool)
    for r in slots.repartition((slots["slot"] / width).cast("long")).mapInArrow(marks, "block int, data binary").collect():
        own = np.unpackbits(np.frombuffer(r["data"], np.uint8)).astype(bool)
        marked[r["block"] * width : r["block"] * width + width] |= own[: bits - r["block"] * width]
    given = spark.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(given.value[batch.column("slot").to_numpy()]))
            for part in tr.slices(batch, "text"):
                tokens, bounds = shingle_sets(part.column("text"))
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * 8), pa.py_buffer(tokens)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("uid"), data], names=["key", "tokens"])

    return rows.select("uid", "text", slot("uid").alias("slot")).mapInArrow(run, "key long, tokens binary").join(wanted, "key")


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y, nx) whose sets link. Sets travel to the group of their y, which is split by the number and size of its pairs."""
    wanted = shared.stored(pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct(), "wanted")
    tokens = whole_sets(rows, wanted)
    sizes = pairs.groupBy("y").agg(F.greatest(F.ceil(F.count("*") / PER_LEADER), F.ceil(F.sum("nx") / SHINGLES)).alias("parts"))
    left = pairs.join(sizes, "y").select(F.col("x").alias("key"), "y", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"), F.lit(1).alias("side"))
    right = sizes.select(F.col("y").alias("key"), "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
    dealt = left.union(right).join(tokens, "key").repartition("y", "part").sortWithinPartitions("y", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for key, y, side, data in zip(b.column("key").to_pylist(), b.column("y").to_pylist(), b.column("side").to_pylist(), b.column("tokens")):
                got = np.frombuffer(data.as_buffer(), np.uint64)
                if side == 0:
                    leader, own = y, got.copy()
                elif leader == y:
                    both = len(np.intersect1d(own, got, assume_unique=True))
                    if 9 * both >= 4 * (len(own) + len(got)):
                        found.append((key, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.select("key", "y", "side", "tokens").mapInArrow(run, "a long, b long")


def mixed_lists(entries: DataFrame) -> DataFrame:
    """Entries (token, label, ...) of the tokens with entries of more than one label."""
    tokens = entries.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("token")
    return entries.join(shared.stored(tokens, "tokens"), "token")


def size_block(n: Column) -> Column:
    """Sizes that can link lie in the same or in neighbouring blocks."""
    return F.floor(F.log(n) / F.log(F.lit(1.3)))


def blocks(lists: DataFrame) -> DataFrame:
    """A row for each block of a list: its least and largest set, and the largest remainder behind its token."""
    own = lists.groupBy("token", "block", "place", "label")
    return own.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))


def named(df: DataFrame, side: str, *, keep: tuple[str, ...] = ("token",)) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keep else f"{c}_{side}") for c in df.columns))


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of sets with different labels that the index can't rule out."""
    entries = sets.select("key", "n", "label", F.posexplode("prefix").alias("pos", "token"))
    lists = shared.stored(mixed_lists(entries).withColumns({"block": size_block(F.col("n")), "place": F.expr(f"{PLACES} * pos div n")}), "lists")
    small = lists.where(F.col("pos") < F.expr(INDEX_PREFIX))
    reach = named(blocks(lists), "y").withColumn("block_x", F.explode(F.array(F.col("block_y"), F.col("block_y") - 1)))
    can_meet = (
        "label_x <> label_y AND least_x <= most_y AND 4 * least_y <= 5 * most_x"
        " AND 9 * least(rest_x, rest_y) >= 4 * (least_x + greatest(least_x, least_y))"
    )
    meet = named(blocks(small), "x").join(reach, ["token", "block_x"]).where(can_meet)
    meet = meet.select("token", *(f"{c}_{side}" for side in "xy" for c in ("block", "place", "label")))
    may = (
        "(n_x < n_y OR (n_x = n_y AND key_x < key_y)) AND 4 * n_y <= 5 * n_x"
        " AND 9 * least(n_x - pos_x, n_y - pos_y) >= 4 * (n_x + n_y)"
    )
    for side, entry in (("x", small), ("y", lists)):
        meet = meet.join(named(entry, side), ["token", *(f"{c}_{side}" for c in ("block", "place", "label"))])
    return meet.where(may).select(F.col("key_x").alias("x"), F.col("key_y").alias("y")).distinct()


def links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, uid (place in the files), label (of the component), n_shingles and component (its smallest id) of each row."""
    rows = texts_of(docs, id_column, text_column)
    told = shared.stored(described(rows, frequencies(rows)), "sets")
    sets = told.where("hash IS NOT NULL").groupBy("hash").agg(
        F.min("id").alias("id"), F.min("uid").alias("key"), *(F.first(c).alias(c) for c in ("n", "bits", "mins", "common", "prefix"))
    )
    sets = shared.stored(sets, "distinct")
    starred = shared.stored(verified(rows, shared.stored(leaders(sets), "leaders")), "stars")
    labels = components(starred)
    labelled = sets.join(labels.withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    crossed = shared.stored(verified(rows, shared.stored(near(candidates(labelled), sets).select("x", "y", "nx"), "pairs")), "links")
    final = components(starred.union(crossed)).withColumnRenamed("v", "key")
    members = sets.select("key", "hash", "id").join(final, "key", "left").select("hash", "id", F.coalesce("label", "key").alias("label"))
    smallest = members.groupBy("label").agg(F.min("id").alias("component"))
    by_hash = members.select("hash", "label").join(smallest, "label").select("hash", "label", "component")
    out = told.select("uid", "id", "n", "hash").join(by_hash, "hash", "left")
    return out.select("id", "uid", "label", F.col("n").alias("n_shingles"), F.when(F.col("hash").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def joined(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, n_shingles and component_id of each row."""
    return links(docs, id_column, text_column).select(F.col("id").alias(id_column), "n_shingles", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that stand first in their component (by id, then place); rows without words stay."""
    told = links(docs, id_column, text_column)
    first = told.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "uid")).alias("first"))
    stays = first.select(F.col("first.uid").alias("uid")).union(told.where("n_shingles = 0").select("uid"))
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid"))
    return rows.join(stays, "uid", "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns))
