"""Token counts by a count-only Viterbi over a unigram vocabulary.

A text is cut into units before each space (which becomes the space mark of the
vocabulary). An Aho-Corasick automaton enumerates the pieces that occur in a
unit; the best segmentation is found by dynamic programming over its
characters, which carries the best score and the number of pieces and never
builds the pieces themselves. Equal units of a batch slice are counted once.

Tie rules are those of the ``Unigram`` model of the ``tokenizers`` library: of
segmentations that reach a place with the same score (summed from the left in
double precision) the one whose last piece begins first wins; a character that
is no piece scores ten below the worst piece; neighbouring such characters (and
the text of the unknown piece itself) count as one token if together they are in
the vocabulary or it lacks byte pieces, else as one for each of their bytes.

Each row is counted on its own: no shuffle. Defined results: a null or empty
text has no tokens; an empty table gives an empty one; rows with equal or null ids
are counted one by one and equal texts have equal counts; a text of any length is
counted as a whole, unit by unit (one without a space is one unit, whose scores
are kept for a window of its characters only); other columns are ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textrows as tr

SPACE_MARK = "▁"
CACHED = 300_000  # units that a Python worker remembers
WINDOW = 4096  # characters whose best scores are kept together
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    """Number of pieces of the best segmentation of a text."""

    def __init__(self, pieces: list[tuple[str, float]], unknown_id: int = 0, byte_fallback: bool = True):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(pieces):
            if piece:
                self.machine.add_word(piece, (len(piece), score, k == unknown_id))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.vocabulary = {x for x, _ in pieces}
        self.longest = max(1, *map(len, self.vocabulary))
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.vocabulary for b in range(256))
        self.known: dict[str, int] = {}

    def run(self, unit: str, begin: int, end: int) -> int:
        """Tokens of neighbouring unknown characters."""
        if not self.bytes or end - begin <= self.longest and unit[begin:end] in self.vocabulary:
            return 1
        return sum(len(unit[k : min(k + WINDOW, end)].encode()) for k in range(begin, end, WINDOW))

    def unit(self, unit: str) -> int:
        """Pieces of one unit."""
        n, longest = len(unit), self.longest
        found = iter(self.machine.iter(unit))  # by the place of the last character
        last, piece = next(found, (n, None))
        # of the places from base on; a piece reaches back no further than the longest one
        base, best, count, opened = 0, [0.0], [0], [-1]  # count: without the tokens of an unknown run that is still open; opened: where it began
        for begin in range(0, n, WINDOW):
            kept = max(0, len(best) - longest)
            base += kept
            best, count, opened = best[kept:], count[kept:], opened[kept:]
            for end in range(begin + 1, min(begin + WINDOW, n) + 1):
                top, source, loose, single = None, -1, False, False
                while last < end:
                    length, score, unknown = piece
                    start = end - length - base
                    total = score + best[start]
                    if top is None or total > top or total == top and start < source:
                        top, source, loose = total, start, unknown
                    single = single or length == 1
                    last, piece = next(found, (n, None))
                if not single:
                    total = self.unknown + best[-1]
                    if top is None or total > top:  # a tie goes to the piece, which begins earlier
                        top, source, loose = total, end - 1 - base, True
                best.append(top)
                before = opened[source]
                if loose:
                    count.append(count[source])
                    opened.append(before if before >= 0 else base + source)
                else:
                    count.append(count[source] + 1 + (self.run(unit, before, base + source) if before >= 0 else 0))
                    opened.append(-1)
        return count[-1] + (self.run(unit, opened[-1], n) if opened[-1] >= 0 else 0)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Pieces of each text."""
        if texts.null_count:
            texts = texts.fill_null("")
        plain = pc.replace_substring(texts, SPACE_MARK, " ")
        lists = pc.split_pattern(pc.if_else(pc.or_(pc.starts_with(plain, " "), pc.equal(plain, "")), plain, pc.binary_join_element_wise(" ", plain, "")), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        sizes = np.empty(len(coded.dictionary), np.int64)
        for k, x in enumerate(coded.dictionary.to_pylist()):
            size = self.known.get(x)
            if size is None:
                size = self.unit(SPACE_MARK + x)
                if len(self.known) < CACHED and len(x) < 64:
                    self.known[x] = size
            sizes[k] = size
        each = sizes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        each[bounds[:-1][bounds[1:] > bounds[:-1]]] = 0  # what lies before the first space is empty
        return tr.per_text(bounds, each)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each file and Python worker."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def counts(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and n_tokens of each row. ``model``: a sentencepiece file, whose pieces and scores are taken as a unigram vocabulary."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            for part in tr.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own.texts(part.column("text")))], names=["id", "n_tokens"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_tokens")
