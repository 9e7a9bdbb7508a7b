"""Packing by power-of-two decomposition.

Each document's ids, with an end id, are cut into pieces: as many of the
longest length as fit, then the binary digits of the rest, longest first.
Every piece has a power of two as its length and is a sequence of its own, so no
sequence crosses documents and none needs padding. Pieces of equal length form
a bucket, which is dealt into batches of one shape: as many pieces as make
``longest`` ids. A task fills its own batches, so the last one of each length in
a task may have fewer rows.

A piece depends on its document alone: no shuffle, and a task's memory follows
a slice of its batch.

Defined results: a null or empty text gives the end id alone, an empty table
nothing. Rows with equal ids are packed one by one and equal texts give equal
pieces, a null id stays null; other columns are ignored. A text of any length is
encoded as a whole, in a slice of its own. Sequence and batch ids are unique, not
gapless; they follow how Spark splits the files, and are the same in each run that
splits them alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textrows as tr
from millrace.llm import tokens

LONGEST = 2048
END = 1


def decompose(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces in a row, and of how many each document has."""
    bits = int(longest).bit_length() - 1
    lengths = 1 << np.arange(bits, -1, -1)
    count = np.empty((len(sizes), bits + 1), np.int64)
    count[:, 0] = sizes // longest
    count[:, 1:] = (sizes[:, None] & lengths[None, 1:]) > 0
    return np.repeat(np.tile(lengths, len(sizes)), count.ravel()), count.sum(axis=1)


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", longest: int = LONGEST, end: int = END) -> DataFrame:
    """A row for each piece: id, start, length (its bucket), doc_tokens, sequence_id, offset, batch, batch_row, ids.

    ``ids``: unsigned little-endian 32-bit ids. ``longest`` must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        task = TaskContext.get().partitionId()
        dealt = np.zeros(longest.bit_length(), np.int64)  # pieces of each length so far
        try:
            for batch in batches:
                for part in tr.slices(batch, "text"):
                    ids, bounds = encoder.encode(part.column("text"), end)
                    sizes = np.diff(bounds)
                    length, count = decompose(sizes, longest)
                    of = np.repeat(np.arange(len(sizes)), count)
                    place = np.append(0, np.cumsum(length))  # pieces follow each other like the ids
                    bit = np.log2(length).astype(np.int64)
                    order = np.argsort(bit, kind="stable")
                    many = np.bincount(bit, minlength=len(dealt))
                    nth = np.empty(len(bit), np.int64)  # of its length, in this task
                    nth[order] = np.arange(len(bit)) - np.repeat(np.cumsum(many) - many - dealt, many)
                    dealt += many
                    batch_id = ((task * len(dealt) + bit) << 36) + nth // (longest // length)
                    binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((place * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                    columns = [part.column("id").take(pa.array(of)), place[:-1] - bounds[of], length, sizes[of], batch_id, nth % (longest // length), binary]
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["id", "start", "length", "doc_tokens", "batch", "batch_row", "ids"])
        finally:
            encoder.known.clear()  # workers outlive their tasks

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, doc_tokens long, batch long, batch_row long, ids binary")
    return out.select(F.col("id").alias(id_column), "start", "length", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "batch", "batch_row", "ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the pieces with one folder for each length."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
