"""Words of many texts at once, as numpy arrays over one Arrow buffer.

Everything here works on a slice of an Arrow batch of at most ``SLICE_BYTES``
of text (one longer text is a slice of its own), so memory inside a task
follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: ASCII white space: words are the runs between.
SPACE = np.zeros(256, np.uint8)
SPACE[[9, 10, 11, 12, 13, 32]] = 1
KEEP = np.arange(256, dtype=np.uint8)
LOWER = KEEP.copy()
LOWER[65:91] += 32
#: Bytes outside words of letters and digits; bytes from 0x80 belong to words.
PUNCT = np.zeros(256, np.uint8)
PUNCT[:128] = 1
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = 0


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch at rows so that ``column`` has about ``most`` bytes in each part."""
    if not batch.num_rows:
        return
    ends = text_offsets(batch.column(column))[1:]
    ends = ends - (text_offsets(batch.column(column))[0])
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of the texts in their buffer, one more than there are texts."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, nulls as empty, and the offsets into them."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: byte span of each, and the first word of each text."""

    start: np.ndarray  # of each word in the bytes of all texts
    end: np.ndarray
    first: np.ndarray  # of each text: index of its first word; one more at the end
    data: pa.Array  # of each word: its bytes

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word, and the distinct words."""
        d = self.data.dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def words(texts: pa.Array, gap: np.ndarray = SPACE, mapped: np.ndarray | None = None) -> Words:
    """Runs of bytes that are no ``gap``; ``mapped`` replaces bytes first, as for lower case."""
    buf, offsets = text_bytes(texts)
    inside = gap.take(buf) == 0
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[:1] = False
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[-1:] = False
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    own = buf.compress(inside)
    if mapped is not None:
        own = mapped.take(own)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    data = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(own)])
    return Words(start, end, np.searchsorted(start, offsets), data)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that begin a code point, summed up: ``cum[b]`` code points lie before byte b."""
    buf, offsets = text_bytes(texts)
    cum = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=cum[1:])
    return cum, offsets


def covered(first: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of all words, those inside any of the spans."""
    delta = np.bincount(starts, minlength=first[-1] + 1).astype(np.int64)
    delta -= np.bincount(starts + lengths, minlength=first[-1] + 1)
    return np.cumsum(delta)[:-1] > 0


def per_text(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sum of the flags of each text's words."""
    cum = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=cum[1:])
    return cum[first[1:]] - cum[first[:-1]]


def word_hashes(codes: np.ndarray, distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word by its bytes."""
    import xxhash

    own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), np.uint64, len(distinct))
    return own[codes]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
