"""Quality rules with suffix-array repetition.

Of each text, a suffix array over its words and the longest common prefixes of
neighbours give the maximal repeated substrings. Their spans are united; a text
is rejected if they cover too large a share of its words or if one repeat is
too long. Simple rules on counts come before; the method's own thresholds lie
below them, so it rejects texts that those leave.

Work is local to each text: no shuffle, and memory follows a slice of a batch.

Defined results: a null or empty text has no words, all counts are 0 and it is
rejected (fewer than ``min_words``). Rows with equal ids are judged one by one;
a null id stays null, equal texts get equal verdicts. A share that equals its
limit passes. An empty table gives an empty one; a text of any length is judged as
a whole, in memory of some 200 bytes a word. Other columns are ignored by ``rules`` and carried along
by ``keep``, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import textrows as tr
from millrace.llm.suffixes import Suffixes

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules.

    min_words: fewer are rejected. window, max_window_share: share of words in
    windows of so many words found twice. min_repeat: words of the shortest
    repeated substring that counts. max_covered: share of words inside such
    substrings, below ``max_window_share``. max_longest, max_longest_share: the
    longest repeat is too long if it has more words than ``max_longest`` and than
    this share of the text (0: whatever the text's length is).
    """

    min_words: int = 10
    window: int = 5
    max_window_share: float = 0.20
    min_repeat: int = 8
    max_covered: float = 0.12
    max_longest: int = 50
    max_longest_share: float = 0.0


MEASURES = pa.schema(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("n_covered_words", pa.int64()),
        ("longest_repeat", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
    ]
)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measures(texts: pa.Array, limits: Limits = Limits()) -> pa.RecordBatch:
    """A row of ``MEASURES`` for each text."""
    w = tr.words(texts)
    n = np.diff(w.first)
    codes, _ = w.coded()
    of = w.text_of()
    repeat = Suffixes(of, codes, np.repeat(w.first[1:], n)).longest()
    buf, offsets = tr.text_bytes(texts)
    heads = tr.per_text(offsets, ((buf & 0xC0) != 0x80) & (tr.SPACE[buf] == 0))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    at = np.flatnonzero(repeat >= limits.window)
    twice = tr.per_text(w.first, tr.covered(w.first, at, np.full(len(at), limits.window)))
    at = np.flatnonzero(repeat >= limits.min_repeat)
    inside = tr.per_text(w.first, tr.covered(w.first, at, repeat[at]))
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, of, repeat)
    dup = np.fromiter((duplicate_lines(t or "") for t in texts.to_pylist()), np.int64, len(n))
    failed = (n < limits.min_words) | (100 * twice > round(100 * limits.max_window_share) * n)
    bad = (inside > limits.max_covered * n) | ((longest > limits.max_longest) & (longest > limits.max_longest_share * n))
    out = [n, heads, tr.per_text(offsets, symbol[buf]), dup, twice, inside, longest, failed, ~failed & ~bad]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, MEASURES.types)], schema=MEASURES)


def rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The id and ``MEASURES`` of each row."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tr.slices(batch, "text"):
                m = measures(part.column("text"), limits)
                yield pa.RecordBatch.from_arrays([part.column("id"), *m.columns], names=["id", *MEASURES.names])

    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {kinds}")
    return out.withColumnRenamed("id", id_column)


def keep(docs: DataFrame, text_column: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows whose text passes, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tr.slices(batch, text_column):
                yield part.filter(measures(part.column(text_column), limits).column("kept"))

    return docs.mapInArrow(run, docs.schema)
