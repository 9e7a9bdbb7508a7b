"""Ranked lexical search: the k best documents of each item of a query set, exactly.

A document is a vector of impacts, one for each term; an item is a vector of term
weights; a score is their inner product in whole numbers. Impact vectors are put in
order of their length and cut into buckets:

* a bucket whose longest vector times the item's length stays below the item's k-th
  best score so far can't hold a better one (Cauchy-Schwarz), nor can any later one;
* inside a bucket the item's heaviest coordinates are looked at until the length of
  the others can't reach that score alone. Only documents with one of these
  coordinates are met; their partial score, plus the product of the lengths of what
  is left on both sides, bounds the whole, and those below go;
* survivors are scored over all coordinates in 64-bit integers.

The first threshold of an item is its k-th best score among the longest vectors,
about a ``SEEDS``-th of all; each task raises its own as it goes. Bounds are kept
a little above their value, so rounding loses nothing.

Items are dealt into blocks of about ``BLOCK`` terms (one longer item is a block of
its own), and each block is broadcast and meets all documents. Only coordinates of the
block's terms are kept, as one row for each document. Tasks hold a bucket of at
most ``ROWS`` documents or about ``ENTRIES`` coordinates. From tasks come at most k
rows for each item, which Spark cuts again before the last shuffle.

Defined results: null and empty texts have no terms and are in no ranking; items
without terms, and documents that score 0, have no rows; an empty table gives an
empty one. Texts of any length are read as a whole. Equal scores go by ascending
id, null ids last; repeated rows and repeated items are ranked one by one. Ids of
documents are whole numbers, those of items of any type. Other columns are
ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import shared, textrows

BLOCK = 500_000  # terms of a block of items
SEEDS = 64
ROWS, ENTRIES = 4096, 1 << 20  # of a bucket
ABOVE = 1 + 1e-9  # what bounds are raised by

VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item long, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """item, term and n: the terms of each item, with repeats counted. items: item, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textrows.slices(batch, "text"):
                found = textrows.words(part.column("text"), textrows.PUNCT, textrows.LOWER)
                owner = pa.array(part.column("item").to_numpy()[found.text_of()])
                yield pa.RecordBatch.from_arrays([owner, found.data.cast(pa.binary())], names=["item", "term"])

    return items.select("item", F.col("text").cast("string").alias("text")).mapInArrow(run, "item long, term binary").groupBy("item", "term").agg(F.count("*").alias("n"))


def in_vocabulary(distinct: pa.Array, hashes: np.ndarray, terms: pa.Array) -> np.ndarray:
    """The place of each word among the terms, which are in the order of their hashes; -1 for others."""
    if not len(hashes):
        return np.full(len(distinct), -1)
    own = textrows.word_hashes(np.arange(len(distinct)), distinct)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    may = np.flatnonzero(hashes[at] == own)
    same = pc.equal(terms.take(pa.array(at[may])).cast(pa.large_binary()), distinct.take(pa.array(may)).cast(pa.large_binary()))
    out = np.full(len(distinct), -1)
    out[may] = np.where(same.to_numpy(zero_copy_only=False), at[may], -1)
    return out


def vectors(docs: DataFrame, known) -> DataFrame:
    """doc_id, n (terms with repeats), and the terms of the vocabulary with how often they occur. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, terms = known.value
        for batch in batches:
            for part in textrows.slices(batch, "text"):
                found = textrows.words(part.column("text"), textrows.PUNCT, textrows.LOWER)
                codes, distinct = found.coded()
                term = in_vocabulary(distinct, hashes, terms)[codes] if len(codes) else codes
                inside = term >= 0
                pairs, tf = np.unique(found.text_of()[inside] * len(hashes) + term[inside], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * max(len(hashes), 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % max(len(hashes), 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(found.first)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, VECTORS)


def impacts(rows: DataFrame, count: int, length: int) -> DataFrame:
    """doc_id, norm, terms and impacts of documents with a term of the vocabulary; count: documents with terms, length: all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = textrows.text_offsets(batch.column("terms"))
            sizes = np.diff(ends)
            tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
            m = 75 + 25 * batch.column("n").to_numpy().astype(np.int64) * count // length
            own = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))
            total = np.zeros(len(own) + 1)
            np.cumsum(own.astype(float) ** 2, out=total[1:])
            first = ends - ends[0]
            norm = np.sqrt(total[first[1:]] - total[first[:-1]])
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), x) for x in (batch.column("terms").flatten(), pa.array(own.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norm), *lists], names=["doc_id", "norm", "terms", "impacts"])

    return rows.where(F.size("terms") > 0).mapInArrow(run, "doc_id long, norm double, terms array<int>, impacts array<int>")


class Best:
    """The k best documents of an item: score, id and whether the id is known."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least = k, least
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        keep = score >= max(self.least, 1)
        joined = tuple(np.concatenate([a, b[keep]]) for a, b in zip(self.rows, (score, doc, known)))
        first = np.lexsort((joined[1], ~joined[2], -joined[0]))[: self.k]
        self.rows = tuple(x[first] for x in joined)
        if len(first) == self.k:
            self.least = max(self.least, int(self.rows[0][-1]))


class Bucket:
    """Impact vectors of a bucket, by document and by term."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.doc = batch.column("doc_id").fill_null(0).to_numpy()
        self.known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        self.norm = batch.column("norm").to_numpy() * ABOVE
        ends = textrows.text_offsets(batch.column("terms"))
        self.first = ends - ends[0]
        self.term = batch.column("terms").flatten().to_numpy()
        self.impact = batch.column("impacts").flatten().to_numpy().astype(np.int64)
        self.by_term = np.argsort(self.term, kind="stable")
        self.of = np.repeat(np.arange(len(self.doc)), np.diff(self.first))[self.by_term]
        self.sorted_terms = self.term[self.by_term]
        self.sorted_impacts = self.impact[self.by_term]

    def search(self, item: Item, weight: np.ndarray, best: Best) -> None:
        """Bring ``best`` up to date. weight: zeros for all terms, and so again afterwards."""
        top = self.norm.max()
        need = best.least
        # the fewest heavy coordinates without which a document can't reach the threshold
        focus = int(np.argmax(item.rest * top < need)) if item.rest[-1] * top < need else len(item.terms)
        low = np.searchsorted(self.sorted_terms, item.terms[:focus])
        high = np.searchsorted(self.sorted_terms, item.terms[:focus], side="right")
        score, square = np.zeros(len(self.doc)), np.zeros(len(self.doc))
        for a, b, w in zip(low.tolist(), high.tolist(), item.weights[:focus].tolist()):
            at, x = self.of[a:b], self.sorted_impacts[a:b].astype(float)
            score[at] += w * x
            square[at] += x * x
        left = item.rest[focus] * np.sqrt(np.maximum(self.norm**2 - square, 0))
        live = np.flatnonzero((square > 0) & ((score + left) * ABOVE >= need))
        if not len(live):
            return
        weight[item.terms] = item.weights
        sizes = self.first[live + 1] - self.first[live]
        ends = np.cumsum(sizes)
        entry = np.arange(ends[-1]) + np.repeat(self.first[live] - (ends - sizes), sizes)
        total = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(weight[self.term[entry]] * self.impact[entry], out=total[1:])
        weight[item.terms] = 0
        best.add(total[ends] - total[ends - sizes], self.doc[live], self.known[live])


class Item:
    """An item's terms by falling weight; ``rest``: the length of what follows each place."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(-weights, kind="stable")
        self.terms, self.weights = terms[order], weights[order]
        self.rest = np.sqrt(np.append(np.cumsum(self.weights[::-1].astype(float) ** 2)[::-1], 0.0)) * ABOVE


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        ends = textrows.text_offsets(batch.column("terms"))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, min(start + ROWS, int(np.searchsorted(ends, ends[start] + ENTRIES, side="right")) - 1))
            yield Bucket(batch.slice(start, stop - start))
            start = stop


def searcher(given, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best documents of a task for each item. given: items, first, terms, weights, thresholds and the size of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, terms, weights, least, size = given.value
        live = [(Item(terms[a:b], weights[a:b]), Best(k, x), name) for name, a, b, x in zip(names.tolist(), first[:-1].tolist(), first[1:].tolist(), least.tolist())]
        done, weight = [], np.zeros(size, np.int64)
        for bucket in buckets(batches):
            top = bucket.norm.max()
            hopeless = [x for x in live if x[0].rest[0] * top < x[1].least]
            if hopeless:  # vectors only get shorter
                done += hopeless
                live = [x for x in live if x[0].rest[0] * top >= x[1].least]
            for item, best, _ in live:
                bucket.search(item, weight, best)
        for _, best, name in done + live:
            score, doc, known = best.rows
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), name)), pa.array(doc, mask=~known), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score and rank for a block of items."""
    spark = docs.sparkSession
    entries = item_terms(items).toPandas()
    words, place = np.unique(entries["term"].to_numpy(object), return_inverse=True) if len(entries) else (np.zeros(0, object), np.zeros(0, np.int64))
    distinct = pa.array(words.tolist(), pa.binary())
    hashes = textrows.word_hashes(np.arange(len(words)), distinct)
    order = np.argsort(hashes, kind="stable")
    moved = np.empty(len(order), np.int64)
    moved[order] = np.arange(len(order))
    terms = moved[place]
    known = spark.sparkContext.broadcast((hashes[order], distinct.take(pa.array(order))))
    rows = shared.stored(vectors(docs, known), "vectors")
    count, length = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not length or not len(words):
        return spark.createDataFrame([], FOUND + ", rank int")
    df = np.zeros(len(words), np.int64)
    holding = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toPandas()  # a row for each term of the block
    df[holding["t"].to_numpy()] = holding["n"].to_numpy()
    w = np.floor(1000 * np.log((2.0 * count + 2) / (2.0 * df + 1))).astype(np.int64)
    by_item = np.argsort(entries["item"].to_numpy(), kind="stable")
    names, first = np.unique(entries["item"].to_numpy()[by_item], return_index=True)
    own = terms[by_item]
    query = (names, np.append(first, len(by_item)), own, w[own] * entries["n"].to_numpy()[by_item])
    # the longest vectors first; the id of a row splits equal lengths
    table = impacts(rows, count, length).withColumn("uid", F.monotonically_increasing_id())
    ordered = shared.stored(table.repartitionByRange(F.desc("norm"), "uid").sortWithinPartitions(F.desc("norm")), "impacts")
    cut = ordered.agg(F.percentile_approx("norm", 1 - 1 / SEEDS, 1000)).first()[0]

    def found(part: DataFrame, least: np.ndarray) -> DataFrame:
        given = spark.sparkContext.broadcast((*query, least, len(words)))
        return part.select("doc_id", "norm", "terms", "impacts").sortWithinPartitions(F.desc("norm")).mapInArrow(searcher(given, k), FOUND)

    none = np.zeros(len(names), np.int64)
    if cut is None:
        return spark.createDataFrame([], FOUND + ", rank int")
    seeds = shared.stored(firsts(found(ordered.where(F.col("norm") >= cut), none), k).drop("rank"), "seeds")
    reached = seeds.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).toPandas()  # a row for each item of the block
    least = none.copy()
    least[np.searchsorted(names, reached["item"].to_numpy())] = reached["least"].to_numpy()
    return firsts(seeds.union(found(ordered.where(F.col("norm") < cut), least)), k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item."""
    named = shared.stored(items.select(F.monotonically_increasing_id().alias("item"), items[item_id].alias("item_id"), items[text].cast("string").alias("text")), "items")
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # a term is followed by at least one other character, so that half of the characters bounds the terms
    room = named.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0))).first()[0]
    blocks = max(1, -(-int(room) // block))
    parts = [block_search(rows, named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    return found.join(named.select("item", "item_id"), "item").select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")
