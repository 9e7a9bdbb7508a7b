"""LM scoring by masked pseudo-likelihood.

A window network predicts every word from the two words on each side. Summed
conditional log-probabilities score a document.

The network's tokens are the most frequent words and some buckets. Its output is
a class of tokens and the token in its class, so a prediction costs two short
softmaxes. A word in a bucket is charged for it: its probability is that of the
bucket times its share of the bucket's occurrences in the corpus. Words of the
vocabulary have their own share; the others, and words never seen, divide what
is left evenly. The probabilities of all words add up to one, so a text of rare
or invented words scores below a text of known ones.

What is gathered follows the corpus: all words are counted, and the vocabulary
with shares of its own holds up to ``2 * sqrt(words of the corpus)`` words, or
``ROOM`` if that is more. It is cut at a count that a histogram tells, so no task
orders all words. Every token of
every document is a training position once: the rounds take turns at the places.
Each task trains from the shared parameters on its own rows; the parameters are
averaged by the number of positions. What a task sends has the size of the
network, which is a parameter.

Defined results: a null or empty text has no tokens, the sum 0 and no mean. A
long text is cut into pieces of positions and takes time by its length. Rows with
equal or null ids are scored one by one and equal texts get equal scores but for the last digits; of words with
equal counts the first in byte order gets a token first; other columns are
ignored, whatever their names are. An empty table leaves the network as it was at
first. Sums of parameters depend on the order of their tasks in the last digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm import textrows as tr

ROOM = 1 << 16  # words of the vocabulary of a small corpus
STEPS = 16  # of the histogram of counts, for each doubling
BLOCK = 8192
HELD = 1 << 25  # bytes of counts that a task adds up at once
MOST = 60  # of logits whose exponentials are summed as they are; a batch times such a sum is far from the range's ends


@dataclass(frozen=True)
class Shape:
    """Sizes of the network: classes times members are its tokens."""

    classes: int = 64
    members: int = 64
    side: int = 2  # tokens seen on each side
    width: int = 16  # of a token's vector
    hidden: int = 32

    @property
    def tokens(self) -> int:
        return self.classes * self.members

    @property
    def words(self) -> int:
        """Tokens that stand for one word; the last class holds the buckets."""
        return self.tokens - self.members


@dataclass(frozen=True)
class Training:
    """rounds take turns at the places, so that each position is trained on once."""

    rounds: int = 2
    batch: int = 4096
    rate: float = 0.1
    seed: int = 7


def laid(tokens: np.ndarray, first: np.ndarray, side: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts in a row with ``side`` edge tokens before, between and after them, and the place of each there."""
    place = np.arange(len(tokens)) + side * np.repeat(np.arange(1, len(first)), np.diff(first))
    row = np.full(len(tokens) + side * len(first), edge)
    row[place] = tokens
    return row, place


def columns(rows: int, n: int, dtype: np.dtype) -> np.ndarray:
    """Room for a column for each position; rows are not a power of two apart, which the caches of processors are bad at."""
    return np.empty((rows, n + 16), dtype)[:, :n]


class Net:
    """The window network over one flat array of parameters. Biases are the last rows of their weights."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None, seed: int = 7):
        self.shape = shape
        total = sum(map(int, map(np.prod, self.sizes().values())))
        self.flat = np.zeros(total, np.float32) if flat is None else flat
        self.part = self.parts(self.flat)
        if flat is None:
            rng = np.random.default_rng(seed)
            self.part["vec"][:] = rng.normal(0, 0.3, self.part["vec"].shape)
            self.part["w"][:] = rng.normal(0, self.part["w"].shape[0] ** -0.5, self.part["w"].shape)
            self.part["c"][:] = rng.normal(0, 0.1, self.part["c"].shape)
            self.part["m"][:] = rng.normal(0, 0.1, self.part["m"].shape)

    def start(self, often: np.ndarray) -> None:
        """Biases by which each token has its share of the counts."""
        own = often.reshape(self.shape.classes, self.shape.members)
        self.part["cb"][:] = np.log(own.sum(axis=1) / own.sum())
        self.part["mb"][:] = np.log(own / own.sum(axis=1, keepdims=True))

    def sizes(self) -> dict[str, tuple[int, ...]]:
        s = self.shape
        return {"vec": (s.tokens + 1, s.width), "hide": (2 * s.side * s.width + 1, s.hidden), "class": (s.hidden + 1, s.classes), "member": (s.classes, s.hidden + 1, s.members)}

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views into a flat array: those of ``sizes``, and of the last three the weights w, c and m and the biases b, cb and mb."""
        out, at = {}, 0
        for name, size in self.sizes().items():
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        for whole, weights, bias in (("hide", "w", "b"), ("class", "c", "cb"), ("member", "m", "mb")):
            out[weights], out[bias] = out[whole][..., :-1, :], out[whole][..., -1, :]
        return out

    def around(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tokens on both sides of places in a row of ``laid``."""
        side = self.shape.side
        return row.take(place[:, None] + np.array([k for k in range(-side, side + 1) if k]))

    def hide(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors around each position (a row), and hidden units with a 1 below: a column for each position, as in all that follows from them."""
        p, n = self.part, len(context)
        x = p["vec"].take(context.ravel(), axis=0).reshape(n, -1)
        h = columns(self.shape.hidden + 1, n, self.flat.dtype)
        np.matmul(p["w"].T, x.T, out=h[:-1])
        h[:-1] += p["b"][:, None]
        np.tanh(h[:-1], out=h[:-1])
        h[-1] = 1
        return x, h

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of the targets by class, and each class with its place in this order."""
        of = (target // self.shape.members).astype(np.int16)  # short integers are sorted by their digits
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(self.shape.classes + 1))
        return order, [(int(c), slice(bounds[c], bounds[c + 1])) for c in np.flatnonzero(np.diff(bounds))]

    def logits(self, h: np.ndarray, classes: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes, and of the tokens in each position's own class."""
        s, p, n = self.shape, self.part, h.shape[1]
        of_class, of_member = columns(s.classes, n, h.dtype), columns(s.members, n, h.dtype)
        np.matmul(p["class"].T, h, out=of_class)
        for c, at in classes:
            np.matmul(p["member"][c].T, h[:, at], out=of_member[:, at])
        return of_class, of_member

    def bounded(self) -> bool:
        """Whether no exponential of a logit, and no sum of them, can leave the range of its type: hidden units lie between -1 and 1."""
        for name in ("class", "member"):
            whole = self.part[name]
            reach, bias = np.abs(whole[..., :-1, :]).sum(axis=-2), whole[..., -1, :]
            if not ((bias + reach).max() < MOST and (bias - reach).max(axis=-1).min() > -MOST):
                return False
        return True

    @staticmethod
    def log_shares(logits: np.ndarray, chosen: np.ndarray, bounded: bool) -> np.ndarray:
        """Log-probability of the chosen row of each column; overwrites the logits."""
        if not bounded:
            logits -= logits.max(axis=0)
        own = logits[chosen, np.arange(len(chosen))]
        return own - np.log(np.exp(logits, out=logits).sum(axis=0))

    @staticmethod
    def errors(logits: np.ndarray, chosen: np.ndarray, n: int, bounded: bool) -> np.ndarray:
        """Gradient by the logits of the negative log-probability of the chosen rows over n; overwrites the logits."""
        if not bounded:
            logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits *= 1 / (n * logits.sum(axis=0))
        logits[chosen, np.arange(len(chosen))] -= 1 / n
        return logits

    def ready(self) -> tuple[list[np.ndarray], bool]:
        """What ``log_prob`` needs of parameters that stay: what each token adds to the hidden units at each place, and ``bounded``."""
        p, width = self.part, self.shape.width
        tables = [np.zeros((self.shape.tokens + 1, self.shape.hidden + 1), self.flat.dtype) for _ in range(2 * self.shape.side)]
        for k, table in enumerate(tables):
            table[:, :-1] = p["vec"] @ p["w"][k * width : (k + 1) * width]
        tables[0][:, :-1] += p["b"]
        return tables, self.bounded()

    def log_prob(self, context: np.ndarray, target: np.ndarray, ready: tuple[list[np.ndarray], bool] | None = None) -> np.ndarray:
        s = self.shape
        tables, bounded = ready or self.ready()
        order, classes = self.by_class(target)
        context, target = context[order], target[order]
        h = tables[0].take(context[:, 0], axis=0)
        for k in range(1, len(tables)):
            h += tables[k].take(context[:, k], axis=0)
        np.tanh(h, out=h)
        h[:, -1] = 1
        of_class, of_member = self.logits(h.T, classes)
        out = np.empty(len(target))
        out[order] = self.log_shares(of_class, target // s.members, bounded).astype(np.float64) + self.log_shares(of_member, target % s.members, bounded)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        s, p, n, bounded = self.shape, self.part, len(target), self.bounded()
        grad = np.zeros_like(self.flat)
        g = self.parts(grad)
        order, classes = self.by_class(target)
        context, target = context[order], target[order]
        x, h = self.hide(context)
        of_class, of_member = self.logits(h, classes)
        d = self.errors(of_class, target // s.members, n, bounded)
        e = self.errors(of_member, target % s.members, n, bounded)
        np.matmul(h, d.T, out=g["class"])
        dh = columns(s.hidden, n, h.dtype)
        for c, at in classes:
            np.matmul(h[:, at], e[:, at].T, out=g["member"][c])
            np.matmul(p["m"][c], e[:, at], out=dh[:, at])
        dh += p["c"] @ d
        dh *= 1 - h[:-1] * h[:-1]
        g["w"][:], g["b"][:] = x.T @ dh.T, dh.sum(axis=1)
        dx = (p["w"] @ dh).reshape(2 * s.side, s.width, n)
        near = context.T.ravel()
        for k in range(s.width):
            g["vec"][:, k] = np.bincount(near, weights=dx[:, k].ravel(), minlength=s.tokens + 1)
        return grad

    def step(self, context: np.ndarray, target: np.ndarray, squares: np.ndarray, rate: float) -> None:
        grad = self.gradient(context, target)
        for a in range(0, len(grad), BLOCK):  # a block stays in the processor's cache
            g, total = grad[a : a + BLOCK], squares[a : a + BLOCK]
            total += g * g
            g *= rate
            g /= np.sqrt(total) + 1e-6
        self.flat -= grad


def bucket_of(start: np.ndarray, end: np.ndarray, buf: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the words at these bytes, by length and outer bytes."""
    return ((end - start) * 31 + buf[start].astype(np.int64) * 7 + buf[end - 1].astype(np.int64) * 131) % buckets


@dataclass
class Model:
    """words: by falling count; the first ``head`` are tokens of the network. charges: log of the share of each
    in its bucket, 0 for the head; rest: the same for other words, by bucket."""

    shape: Shape
    words: pa.Array
    head: int
    charges: np.ndarray
    rest: np.ndarray
    flat: np.ndarray

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and the first of each text."""
        w = tr.words(texts)
        return self.found(w, texts, self.words[: self.head])[0], w.first

    def found(self, w: tr.Words, texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of each word, its place in these first words of the vocabulary or -1, and which words are in buckets."""
        known = pc.index_in(w.data, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
        out = known.astype(np.int64)
        tail = np.flatnonzero((known < 0) | (known >= self.head))
        buf, _ = tr.text_bytes(texts)
        out[tail] = self.shape.words + bucket_of(w.start[tail], w.end[tail], buf, self.shape.members)
        return out, known, tail

    def charged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``tokens``, with what each is charged in between."""
        w = tr.words(texts)
        out, known, tail = self.found(w, texts, self.words)
        charge = np.zeros(len(out))
        charge[tail] = self.rest[out[tail] - self.shape.words]
        own = tail[known[tail] >= 0]
        charge[own] = self.charges[known[own]]
        return out, charge, w.first

    def score(self, texts: pa.Array, chunk: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and sum of log-probabilities of each text."""
        net = Net(self.shape, self.flat)
        tokens, logs, first = self.charged(texts)
        row, place = laid(tokens, first, self.shape.side, self.shape.tokens)
        order, _ = net.by_class(tokens)  # a chunk has few classes
        ready = net.ready()
        for a in range(0, len(tokens), chunk):
            at = order[a : a + chunk]
            logs[at] += net.log_prob(net.around(row, place[at]), tokens[at], ready)
        total = np.bincount(np.repeat(np.arange(len(texts)), np.diff(first)), weights=logs, minlength=len(texts))
        return np.diff(first), total


def counted(texts: DataFrame) -> DataFrame:
    """word (its bytes) and n, over all rows of ``text``. A task adds up the counts of its slices, ``HELD`` bytes at a time."""

    def added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return sums.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for part in tr.slices(batch, "text"):
                counts = tr.words(part.column("text")).data.value_counts()
                held.append(pa.RecordBatch.from_arrays([counts.field("values").cast(pa.binary()), counts.field("counts")], names=["word", "n"]))
                if sum(b.nbytes for b in held) > HELD:
                    yield from added(held)
                    held = []
        if held:
            yield from added(held)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucketed(counts: DataFrame, buckets: int) -> DataFrame:
    """word, n and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").cast(pa.large_binary())
            buf, first = tr.text_bytes(words)
            bucket = bucket_of(first[:-1], first[1:], buf, buckets)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(bucket, pa.int32())], names=["word", "n", "bucket"])

    return counts.mapInArrow(run, "word binary, n long, bucket int")


def cut_at(sizes: list[tuple[int, int]], room: int) -> int:
    """The least step of the histogram from which on there are no more than ``room`` words."""
    least, total = 1 << 30, 0
    for step, words in sorted(sizes, reverse=True):
        total += words
        if total > room:
            break
        least = step
    return least


def vocabulary(texts: DataFrame, shape: Shape) -> Model:
    """A model of the counts alone: each token has its share of all words."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    counts = shared.stored(bucketed(counted(texts), shape.members).withColumn("step", step), "counts")
    sizes = counts.groupBy("step").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()  # a row for each step
    words = [(r["step"], r["words"]) for r in sizes]
    tokens = sum(r["n"] for r in sizes)
    least = cut_at(words, max(ROOM, int(2 * tokens**0.5)))
    known = [(bytes(r["word"]), r["n"], r["bucket"]) for r in counts.where(F.col("step") >= least).collect()]
    known.sort(key=lambda r: (-r[1], r[0]))
    first = min(len(known), shape.words)
    other = counts.where(F.col("step") < least).groupBy("bucket").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    left, sorts = np.ones(shape.members), np.ones(shape.members)  # a share for words never seen
    for r in other:
        left[r["bucket"]] += r["n"]
        sorts[r["bucket"]] += r["words"]
    n = np.array([r[1] for r in known], np.float64)
    bucket = np.array([r[2] for r in known], np.int64)
    tail = np.arange(len(known)) >= first
    whole = left + np.bincount(bucket[tail], weights=n[tail], minlength=shape.members)
    charges = np.where(tail, np.log(n) - np.log(whole[bucket]), 0.0)
    net = Net(shape, seed=7)
    often = np.full(shape.tokens, 0.01)
    often[:first] += n[:first]
    often[shape.words :] += whole
    net.start(often)
    return Model(shape, pa.array([r[0] for r in known], pa.large_binary()), first, charges, np.log(left) - np.log(whole) - np.log(sorts), net.flat)


def trained(texts: DataFrame, model: Model, training: Training, turn: int) -> np.ndarray:
    """Parameters after a round (``turn`` counts them): each task's own, averaged by its number of positions."""
    spark = texts.sparkSession
    given = spark.sparkContext.broadcast(model)
    rate = training.rate / (turn + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        net = Net(own.shape, own.flat.copy())
        squares = np.zeros_like(net.flat)
        rng = np.random.default_rng(training.seed)
        n = 0
        for batch in batches:
            for part in tr.slices(batch, "text"):
                tokens, first = own.tokens(part.column("text"))
                row, place = laid(tokens, first, own.shape.side, own.shape.tokens)
                at = np.flatnonzero((np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))) % training.rounds == turn)
                rng.shuffle(at)
                for a in range(0, len(at), training.batch):
                    rows = at[a : a + training.batch]
                    net.step(net.around(row, place[rows]), tokens[rows], squares, rate)
                n += len(at)
        if n:
            yield shared.in_blocks(np.append(net.flat.astype(np.float64) * n, float(n)), BLOCK)

    total = shared.joined_blocks(shared.summed(texts.mapInArrow(run, "block int, data binary"), "f8"), "f8")
    given.destroy()
    return model.flat if total is None else (total[:-1] / total[-1]).astype(np.float32)


def fit(docs: DataFrame, text_column: str = "text", shape: Shape = Shape(), training: Training = Training()) -> Model:
    """Train on all rows."""
    texts = docs.select(docs[text_column].cast("string").alias("text"))
    model = vocabulary(texts, shape)
    for turn in range(training.rounds):
        model = replace(model, flat=trained(texts, model, training, turn))
    return model


def scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, n_tokens, log_prob (sum) and mean_log_prob of each row."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tr.slices(batch, "text"):
                n, total = given.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(total)], names=["id", "n_tokens", "log_prob"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, log_prob double")
    return out.select(F.col("id").alias(id_column), "n_tokens", "log_prob", F.try_divide("log_prob", "n_tokens").alias("mean_log_prob"))
