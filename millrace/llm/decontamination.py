"""Benchmark decontamination with an FM-index over each shard of training text.

The documents of a batch slice form a shard. Its index is the Burrows-Wheeler
transform of the words, stored as a wavelet matrix, with sampled suffix
positions. Every distinct test phrase (a window of consecutive item words) is
searched backward; occurrences are located from the samples and united into
removal spans.

Words are runs of letters, digits and bytes from 0x80, lower-cased in A-Z. A
shard numbers its own words; a phrase with a word that the shard lacks doesn't
occur there.

Documents stay where they are: no shuffle, and one pass. Spark derives the
distinct phrases and their items and writes them to the shared folder in blocks
of at most ``BLOCK_PHRASES`` rows. A task builds the index of a shard once and
searches it for all blocks. Of a block, only phrases are searched whose rarest pair
of neighbouring words occurs in the shard, so that the cost of a search follows the
shard and hardly the benchmark. A task holds ``HELD`` blocks at most and reads further
ones again for each group of ``GROUP`` shards; where all blocks are held, it has the
index of one shard at a time.

Defined results: a null or empty text has no words and no hit; an item without
words has no phrase; an item that is shorter than a window is one phrase of its
own. An empty table gives an empty one, an empty benchmark no hits. A text of any
length is one shard at least, whose index takes some 100 bytes a word. Repeated
items count under each of their ids, an item with a null id is searched and listed
under no id. Phrases that overlap or touch are one span. Rows with equal ids are
treated one by one, equal texts get equal hits; other columns are carried along,
whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import shared
from millrace.llm import textrows as tr
from millrace.llm.suffixes import Suffixes

WINDOW = 10
BLOCK_PHRASES = 250_000  # phrases (with an item each) in a block
HELD = 4  # blocks that a Python worker remembers
GROUP = 2  # shards that are searched for a block together if not all blocks are held
SAMPLE = 16  # one suffix position is kept out of so many
SHARD_BYTES = 1 << 20


class WaveletMatrix:
    """Rank over a sequence of symbols: how often does one occur before a place."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []  # at each level: ones before each place
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            cum = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=cum[1:])
            self.ones.append(cum)
            self.zeros.append(len(symbols) - int(cum[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(symbol), np.int64)
        end = place.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin = np.where(one, zeros + b, begin - b)
            end = np.where(one, zeros + e, end - e)
        return end - begin

    def at(self, place: np.ndarray) -> np.ndarray:
        out, place = np.zeros(len(place), np.int64), place.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[place + 1] - ones[place]
            out = 2 * out + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return out


class FMIndex:
    """Index of several texts of symbols from 1 to ``top``; ``first`` bounds the texts."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, top: int):
        sizes = np.diff(first)
        texts = len(sizes)
        n = len(symbols) + texts
        # an end mark after each text; the marks are all different and come before the symbols
        place = np.arange(len(symbols)) + np.repeat(np.arange(texts), sizes)
        line = np.empty(n, np.int64)
        marks = first[1:] + np.arange(texts)
        line[marks] = np.arange(texts)
        line[place] = symbols + texts
        suffixes = Suffixes(np.zeros(n, np.int64), line, np.full(n, n), ordered=True)
        order = suffixes.order
        plain = np.zeros(n, np.int64)
        plain[place] = symbols
        self.last = WaveletMatrix(plain[order - 1], top)  # order 0 takes the last mark
        self.less = np.zeros(top + 2, np.int64)  # symbols, marks included, below each
        np.cumsum(np.bincount(plain, minlength=top + 1), out=self.less[1:])
        inner = np.arange(n) - np.repeat(np.append(0, marks[:-1] + 1), sizes + 1) if texts else np.zeros(0, np.int64)
        chosen = inner[order] % SAMPLE == 0  # text starts are, so that no walk leaves its text
        self.chosen = chosen
        self.before = np.cumsum(chosen) - chosen
        self.position = order[chosen]
        self.text_of = np.repeat(np.arange(texts), sizes + 1)
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of ranks of the phrases that occur. Phrases are right-aligned rows of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[high[live] > low[live]]
            now = live[lengths[live] >= back]
            if not len(now):
                break
            c = phrases[now, -back]
            low[now] = self.less[c] + self.last.rank(c, low[now])
            high[now] = self.less[c] + self.last.rank(c, high[now])
        found = np.flatnonzero((high > low) & (lengths > 0))
        return found, low[found], high[found]

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Positions of the suffixes of these ranks, among the words of all texts."""
        out = np.empty(len(ranks), np.int64)
        todo, steps, ranks = np.arange(len(ranks)), 0, ranks.copy()
        while len(todo):
            done = self.chosen[ranks]
            out[todo[done]] = self.position[self.before[ranks[done]]] + steps
            todo, ranks = todo[~done], ranks[~done]
            c = self.last.at(ranks)
            ranks = self.less[c] + self.last.rank(c, ranks)
            steps += 1
        return out - self.text_of[out]


@dataclass
class Phrases:
    """Distinct phrases of a block, and the items of each."""

    vocabulary: pa.Array
    rows: np.ndarray  # right-aligned places in the vocabulary, -1 before
    lengths: np.ndarray
    begin: np.ndarray  # items of phrase p: items[begin[p]:begin[p + 1]]
    items: np.ndarray  # places in ids
    ids: list[str | None]
    pairs: np.ndarray  # codes of the pairs of neighbouring words that are the rarest of a phrase in the block, sorted
    at: np.ndarray  # phrases of the k-th pair: of[at[k]:at[k + 1]]
    of: np.ndarray

    def code(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Codes of pairs of places in the vocabulary; a phrase of one word has a pair with the place behind the last one."""
        return first * (len(self.vocabulary) + 1) + second

    def with_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Phrases whose rarest pair is one of these, in order; every other phrase holds a pair that isn't."""
        k = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        there = np.zeros(len(self.pairs), bool)
        there[k[self.pairs[k] == pairs]] = True
        k = np.flatnonzero(there)
        return np.sort(self.of[ranges(self.at[k], self.at[k + 1] - self.at[k])])


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each pair of a begin and a size."""
    return np.repeat(begin - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())


def phrase_rows(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """phrase (words, joined by spaces) and item: the windows of each item, or the whole of a shorter one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(benchmark[text_column].cast("string"), upper, upper.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    own = benchmark.select(benchmark[item_column].cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window, F.lit(0)) + 1)
    phrases = F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))
    return own.select("item", F.explode(phrases).alias("phrase")).select("phrase", "item").distinct()


def blocks(rows: DataFrame) -> list[str]:
    """Files of at most ``BLOCK_PHRASES`` rows of ``phrase_rows`` each, in the shared folder."""
    rows = shared.stored(rows, "phrases")
    path = shared.fresh(rows.sparkSession, "blocks")
    n = rows.count()
    rows.coalesce(max(1, -(-n // BLOCK_PHRASES))).write.option("maxRecordsPerFile", BLOCK_PHRASES).parquet(path)
    return sorted(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles()) if n else []


def phrases_of(block: pa.Table, window: int) -> Phrases:
    coded = block.column("phrase").combine_chunks().dictionary_encode()
    lists = pc.split_pattern(coded.dictionary, " ")
    words = lists.flatten().dictionary_encode()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.append(0, np.cumsum(lengths))
    rows = np.full((len(lengths), window), -1, np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    rows[of, window - lengths[of] + np.arange(first[-1]) - first[of]] = words.indices.to_numpy()
    phrase = coded.indices.to_numpy()
    items = block.column("item").combine_chunks().dictionary_encode("encode")
    vocabulary = words.dictionary.cast(pa.large_string()).cast(pa.large_binary())
    none = len(vocabulary)
    padded = np.where(rows < 0, none, rows)
    padded = np.concatenate([np.full((len(rows), 1), none), padded], axis=1)
    codes = padded[:, :-1] * (none + 1) + padded[:, 1:]
    _, which, often = np.unique(codes, return_inverse=True, return_counts=True)
    often = often[which].reshape(codes.shape)
    often[padded[:, :-1] == none] = codes.size + 1  # taken where there is no pair of words
    often[padded[:, 1:] == none] = codes.size + 2  # never taken
    pairs, which = np.unique(codes[np.arange(len(rows)), often.argmin(axis=1)], return_inverse=True)
    at = np.append(0, np.cumsum(np.bincount(which, minlength=len(pairs))))
    return Phrases(vocabulary, rows, lengths, np.append(0, np.cumsum(np.bincount(phrase, minlength=len(lengths)))), items.indices.to_numpy()[np.argsort(phrase, kind="stable")].astype(np.int64), items.dictionary.to_pylist(), pairs, at, np.argsort(which, kind="stable"))


_held: dict[str, Phrases] = {}


def block_at(path: str, window: int) -> Phrases:
    """A block from the shared folder; a worker remembers the first ``HELD`` of a benchmark and forgets those of the one before."""
    if path in _held:
        return _held[path]
    folder = path.rpartition("/")[0]
    for other in [p for p in _held if p.rpartition("/")[0] != folder]:
        del _held[other]
    from pyarrow import fs, parquet

    store, own = fs.FileSystem.from_uri(shared.plain_uri(path))
    got = phrases_of(parquet.read_table(own, filesystem=store, partitioning=None), window)
    if len(_held) < HELD:
        _held[path] = got
    return got


class Shard:
    """Texts with their index: inside tells which words are hit, found the (text, item) pairs."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.words = tr.words(texts, tr.PUNCT, tr.LOWER)
        self.codes, self.vocabulary = self.words.coded()
        codes = self.codes
        self.index = FMIndex(codes + 1, self.words.first, max(1, len(self.vocabulary))) if len(codes) else None
        self.inside = np.zeros(len(codes), bool)
        self.found: list[tuple[np.ndarray, np.ndarray, list[str | None]]] = []

    def search(self, phrases: Phrases) -> None:
        if self.index is None or not len(phrases.rows):
            return
        place = pc.index_in(self.vocabulary, value_set=phrases.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.flatnonzero(place >= 0)
        known = place[self.codes]
        both = (known[:-1] >= 0) & (known[1:] >= 0)
        pairs = phrases.code(known[:-1][both], known[1:][both])  # across texts as well, which does no harm
        some = phrases.with_pairs(np.append(pairs, phrases.code(np.full(len(own), len(phrases.vocabulary)), place[own])))
        symbol = np.ones(len(phrases.vocabulary) + 1, np.int64)  # the last one stands for no word
        symbol[:-1] = 0  # a word that the shard lacks
        symbol[place[own]] = own + 1
        symbols = symbol[phrases.rows[some]]
        whole = symbols.all(axis=1)
        some, symbols = some[whole], symbols[whole]
        hit, low, high = self.index.search(symbols, phrases.lengths[some])
        hit = some[hit]
        size = high - low
        which = np.repeat(hit, size)
        at = self.index.locate(ranges(low, size))
        first = self.words.first
        self.inside |= tr.covered(first, at, phrases.lengths[which])
        text = np.searchsorted(first, at, side="right") - 1
        pair = np.unique(text * len(phrases.begin) + which)
        text, which = pair // len(phrases.begin), pair % len(phrases.begin)
        size = np.diff(phrases.begin)[which]
        item = phrases.items[ranges(phrases.begin[which], size)]
        pair = np.unique(np.repeat(text, size) * len(phrases.ids) + item)
        self.found.append((pair // len(phrases.ids), pair % len(phrases.ids), phrases.ids))

    def measures(self) -> pa.RecordBatch:
        """A row of ``ADDED`` for each text: spans in code points, items with an occurring phrase."""
        w, n = self.words, len(self.texts)
        cum, offsets = tr.code_points(self.texts)
        base = cum[offsets[:-1]]
        begin, end, bounds = runs(self.inside, w.first)
        of = np.repeat(np.arange(n), np.diff(bounds))
        flat = pa.StructArray.from_arrays([pa.array(cum[w.start[begin]] - base[of]), pa.array(cum[w.end[end - 1]] - base[of])], fields=list(SPAN))
        items: list[list[str]] = [[] for _ in range(n)]
        for texts, own, ids in self.found:
            for t, k in zip(texts.tolist(), own.tolist()):
                if ids[k] is not None:
                    items[t].append(ids[k])
        out = [np.diff(w.first), tr.per_text(w.first, self.inside), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], schema=ADDED)


def runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (in words) of each run of flagged words in a text, and the bounds by text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | edge[:-1]))
    end = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, first)


def measured(parts: list[pa.RecordBatch], text_column: str, paths: list[str], window: int) -> list[pa.RecordBatch]:
    """``measures`` of some parts, searched for the blocks at these paths. Their indexes are gone when it returns."""
    shards = [Shard(p.column(text_column)) for p in parts]
    for path in paths:
        phrases = block_at(path, window)
        for shard in shards:
            shard.search(phrases)
    return [shard.measures() for shard in shards]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ADDED = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])


ADDED_SQL = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def free_name(names: list[str], name: str) -> str:
    while name.lower() in (x.lower() for x in names):
        name += "_"
    return name


def with_hits(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", window: int = WINDOW, added: str = "hits") -> DataFrame:
    """The rows with all their columns and a struct of ``ADDED`` in a last one, named ``added`` (with ``_`` behind if there is such a column).

    ``spans``: what to remove, in code points, united; ``items``: ids of the
    items with an occurring phrase, in no order, a null id left out.
    """
    added = free_name(docs.columns, added)
    paths = blocks(phrase_rows(benchmark, item_column, "text", window))
    group = 1 if len(paths) <= HELD else GROUP
    schema = T.StructType([*docs.schema, T.StructField(added, T.StructType.fromDDL(f"x {ADDED_SQL}")["x"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = tr.slices(batch, text_column, SHARD_BYTES)
            while own := list(islice(parts, group)):
                for part, m in zip(own, measured(own, text_column, paths, window)):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(m.columns, fields=list(ADDED))], names=[*part.schema.names, added])

    done = docs.mapInArrow(run, schema)
    return done.withColumn(added, F.col(added).withField("items", F.array_distinct(F.col(added)["items"])))


def hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", window: int = WINDOW) -> DataFrame:
    """Id, n_words, n_hit, spans and items of each row."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    found = with_hits(rows, benchmark, "text", item_column, window)
    return found.select(F.col("id").alias(id_column), "hits.*")


def cut(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows without their removal spans, with all their columns; each span becomes a line end."""
    added = free_name(docs.columns, "hits")
    found = with_hits(docs, benchmark, text_column, item_column, window, added)
    spans = F.col(added)["spans"]
    text = F.col(text_column)
    # pieces between the spans: from the end of one to the start of the next
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    rest = F.when(F.size(spans) > 0, F.array_join(pieces, "\n")).otherwise(text)
    return found.withColumn(text_column, rest).drop(added)
