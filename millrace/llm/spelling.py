"""Spelling variants: words one edit apart, found in a reduced alphabet.

Letters are hashed to a few symbols. Words meet by their reduced forms: the
one-edit neighbourhood of a reduced word is generated in full and joined with the
reduced vocabulary, and every candidate is verified on the original strings. Two
words one edit apart have reduced forms at most one edit apart, so no pair is lost:

* a deletion in the longer word is a deletion in its reduced form; insertions are
  the deletions of the other word and are generated there;
* a replacement replaces a symbol, and is generated at the smaller of both reduced
  forms, or leaves the reduced form as it is.

So each pair is met once. A reduced form that more than ``BUCKET`` words share is
hot: there, neighbours meet by reduced form and original string, the latter with a
gap at the place of the edit, so that only words one edit apart meet at all. A
frequent reduced form therefore makes no pairs of unlike words. Words longer than
``LONG`` meet by hashes of all their edits, which take O(1) each, and are verified
as well.

A word's form is its near word of the largest count; forms have at least twice the
count of the word, so chains of forms are short, and roots are found by jumping
to the root of the root.

Work: one pass over the texts, whose words are counted before the shuffle; after
that everything is joins over the vocabulary.

Defined results: a null text has no words, an empty table gives an empty one; a
null id counts as an empty one where words are drawn to be damaged. Repeated rows
count each time. Runs of any length are words. Ties between near words go to the
smallest in code-point order. Other columns are ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = "01234567"  # of the reduced alphabet
GAP = "?"
DAMAGED = 97  # one word in so many loses a character
MIN_LENGTH, MIN_COUNT = 5, 3
BUCKET = 32  # words of one reduced form that meet as they are
LONG = 48  # longest word whose edits are written out
BASE = np.uint64(6364136223846793005)
INVERSE = np.uint64(pow(6364136223846793005, -1, 1 << 64))


def occurrences(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """word of each occurrence; one word in ``DAMAGED``, drawn by document and word, loses a code point."""
    runs = docs.select(F.coalesce(docs[id_column].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(docs[text_column].cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    drawn = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return drawn.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: the distinct words that are long and frequent enough."""
    long = occurrences(docs, id_column, text_column).where(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def reduced(word: Column) -> Column:
    """The word in the reduced alphabet: letters are dealt to symbols by a hash."""
    hashed = "".join(SYMBOLS[(ord(c) * 2654435761 >> 16) % len(SYMBOLS)] for c in LETTERS)
    return F.translate(word, LETTERS, hashed)


def cut_at(text: Column, k: Column, new: Column) -> Column:
    """The text with its k-th character (from 1) replaced."""
    return F.concat(F.substring(text, F.lit(1), k - 1), new, F.substring(text, k + 1, F.length(text)))


def neighbourhood(words: DataFrame) -> DataFrame:
    """word, edit (delete, replace or same), at and key: reduced forms at most one edit from the word's own.

    Replaced forms are generated where they are larger than the own one, and deletions
    with the same result at the first of their places.
    """
    own = F.col("key")
    places = F.sequence(F.lit(1), F.length(own))
    letter = lambda k: F.substring(own, k, F.lit(1))

    def made(edit: str, at: Column, key: Column) -> Column:
        return F.struct(F.lit(edit).alias("edit"), at.cast("int").alias("at"), key.alias("key"))

    deleted = F.transform(F.filter(places, lambda k: (k == 1) | (letter(k) != letter(k - 1))), lambda k: made("delete", k, cut_at(own, k, F.lit(""))))
    symbols = F.array(*map(F.lit, SYMBOLS))
    replaced = F.flatten(F.transform(places, lambda k: F.transform(F.filter(symbols, lambda s: s > letter(k)), lambda s: made("replace", k, cut_at(own, k, s)))))
    same = F.array(made("same", F.lit(0), own))
    return words.select("word", F.explode(F.concat(deleted, replaced, same)).alias("x")).select("word", "x.*")


def gapped(word: Column) -> Column:
    """The word with a gap at each of its places."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: cut_at(word, k, F.lit(GAP)))


def shortened(word: Column) -> Column:
    """The distinct results of deleting one character."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: cut_at(word, k, F.lit(""))))


def hashed_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, length and hash of each long word, of its deletions, and of it with a gap at each place: a polynomial modulo 2^64, so that each costs O(1)."""
    for batch in batches:
        for row, word in zip(batch.column("id").to_pylist(), batch.column("word")):
            x = np.frombuffer(word.as_py().encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            powers = np.full(len(x), BASE, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            terms = x * powers
            upto = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(terms, out=upto[1:])
            gone = np.unique(upto[:-1] + (upto[-1] - upto[1:]) * INVERSE)
            for kind, length, found in (("whole", len(x), upto[-1:]), ("shorter", len(x) - 1, gone), ("gap", len(x), upto[-1] - terms + np.uint64(1 << 21) * powers)):
                for a in range(0, len(found), 1 << 16):
                    part = found[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row)), pa.array([kind] * len(part)), pa.array(np.full(len(part), length)), pa.array(part.view(np.int64))], names=["id", "kind", "length", "hash"])


def long_pairs(words: DataFrame) -> DataFrame:
    """Near pairs of words longer than ``LONG``: candidates by hashes of all their edits, verified on the words."""
    edits = words.select("id", "word").mapInArrow(hashed_edits, "id long, kind string, length long, hash long")
    of = lambda kind, name: edits.where(F.col("kind") == kind).select("length", "hash", F.col("id").alias(name))
    gaps = of("gap", "x").join(of("gap", "y"), ["length", "hash"]).where("x < y")
    met = gaps.select("x", "y").union(of("shorter", "x").join(of("whole", "y"), ["length", "hash"]).select("x", "y")).distinct()
    a, b = words.select(F.col("id").alias("x"), F.col("word").alias("a")), words.select(F.col("id").alias("y"), F.col("word").alias("b"))
    return met.join(a, "x").join(b, "y").where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_pairs(vocab: DataFrame, bucket: int = BUCKET, long: int = LONG) -> DataFrame:
    """a and b: words of the vocabulary that differ by exactly one inserted, deleted or replaced code point, each pair once."""
    words = shared.stored(vocab.select(F.monotonically_increasing_id().alias("id"), "word"), "words")
    size = F.length("word")
    short = shared.stored(words.where(size <= long).select("word", reduced(F.col("word")).alias("key")), "reduced")
    sizes = short.groupBy("key").agg(F.count("*").alias("size"))
    hot = shared.stored(sizes.where(F.col("size") > bucket).select("key"), "hot")
    around = neighbourhood(short)
    cold = short.join(hot, "key", "left_anti").select("key", F.col("word").alias("other"))
    met = around.join(cold, "key").where((F.col("edit") != "same") | (F.col("word") < F.col("other")))
    few = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "other")
    # in hot buckets: by the original string too, with a gap where the edit is
    w = F.col("word")
    edits = shared.stored(around.join(hot, "key"), "edits")
    whole = short.join(hot, "key").select("key", F.col("word").alias("other"))
    gaps = whole.select("key", "other", F.explode(gapped(F.col("other"))).alias("with_gap"))
    shorter = edits.where("edit = 'delete'").select("word", "key", F.explode(shortened(w)).alias("other")).join(whole, ["key", "other"]).select("word", "other")
    swapped = edits.where("edit = 'replace'").select("word", "key", cut_at(w, F.col("at"), F.lit(GAP)).alias("with_gap")).join(gaps, ["key", "with_gap"]).select("word", "other")
    alike = gaps.withColumnRenamed("other", "word").join(gaps, ["key", "with_gap"]).where("word < other").select("word", "other")
    return few.union(shorter).union(swapped).union(alike).toDF("a", "b").union(long_pairs(words.where(size > long))).union(border_pairs(words, long))


def border_pairs(words: DataFrame, long: int) -> DataFrame:
    """Near pairs of words with ``long`` characters and one more."""
    at = F.length("word")
    more = words.where(at == long + 1).select(F.col("word").alias("a"), F.explode(shortened(F.col("word"))).alias("b"))
    return more.join(words.where(at == long).select(F.col("word").alias("b")), "b").select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form (word, form): the last word that following the forms leads to."""
    now = shared.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = shared.stored(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket: int = BUCKET, long: int = LONG) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word."""
    vocab = shared.stored(vocabulary(docs, id_column, text_column), "vocabulary")
    pairs = shared.stored(near_pairs(vocab, bucket, long), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counts = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = both.join(counts, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("near_n"), F.col("best.form").alias("near"))
    has = F.col("near_n") >= 2 * F.col("n")
    rows = shared.stored(rows.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    up = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
