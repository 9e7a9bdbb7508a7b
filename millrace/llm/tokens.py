"""Byte-level BPE ids of whole texts, one encoding for each distinct chunk of a slice.

A chunk begins at a single space between two characters that are surely no
white space. The tokenizer's pattern always breaks there, so the ids of a text
are those of its chunks in a row.
"""

from __future__ import annotations

from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa

from millrace.llm import textrows as tr

CACHED = 100_000  # chunks that a task remembers; later ones are encoded again

#: Lead bytes of characters without white space among them: U+00C0 to U+07FF, U+4000 to U+9FFF.
LEAD2 = np.zeros(256, bool)
LEAD2[0xC3:0xE0] = True
LEAD3 = np.zeros(256, bool)
LEAD3[0xE4:0xEA] = True
PRINT = np.zeros(256, bool)
PRINT[0x21:0x7F] = True


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at the start of each text that is not empty, and at such spaces."""
    n = len(buf)
    pad = np.concatenate([np.zeros(3, np.uint8), buf, np.zeros(1, np.uint8)])
    at = np.flatnonzero(buf == 0x20)
    b1, b2, b3, after = pad[at + 2], pad[at + 1], pad[at], pad[at + 4]
    tail = (b1 & 0xC0) == 0x80
    before = PRINT[b1] | (tail & LEAD2[b2]) | (tail & ((b2 & 0xC0) == 0x80) & LEAD3[b3])
    cut = np.zeros(n + 1, bool)
    cut[at] = before & (PRINT[after] | LEAD2[after] | LEAD3[after])
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


#: The pattern by which the tokenizer splits texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Ids of texts by a byte-level BPE file of the ``tokenizers`` library.

    Single chunks are encoded with tiktoken over the same vocabulary, whose ids
    are its merge ranks; that is several times faster for short strings. Chunks
    with a special token's text go to ``tokenizers``, which is loaded for the first
    of them.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = [x["content"] for x in data["added_tokens"]]
        chars = byte_of()
        ranks = {bytes(chars[c] for c in x): i for x, i in data["model"]["vocab"].items() if x not in special}
        self.special = [x.encode() for x in special]
        self.plain = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[bytes, bytes] = {}

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def chunk(self, chunk: bytes) -> list[int]:
        text = chunk.decode()
        if any(x in chunk for x in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.plain(text)

    def encode(self, texts: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row as uint32, and the bounds of each text; ``last`` is added to each."""
        buf, offsets = tr.text_bytes(texts)
        begin = cuts(buf, offsets)
        ends = np.append(begin, len(buf))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf)])
        d = chunks.dictionary_encode()
        code, distinct = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()
        ids = [self.known.get(x) for x in distinct]
        for k, x in enumerate(ids):
            if x is None:
                ids[k] = array("I", self.chunk(distinct[k])).tobytes()
                if len(self.known) < CACHED and len(distinct[k]) < 64:
                    self.known[distinct[k]] = ids[k]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first = np.append(0, np.cumsum(size))[:-1]
        n = size[code]
        done = np.append(0, np.cumsum(n))
        out = flat[np.repeat(first[code] - done[:-1], n) + np.arange(done[-1])]
        bounds = done[np.searchsorted(begin, offsets)]
        if last is not None:
            out = np.insert(out, bounds[1:], np.uint32(last))
            bounds = bounds + np.arange(len(bounds))
        return out, bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
