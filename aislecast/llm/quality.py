"""Document quality from supervised subword embeddings.

A word's vector is the mean of learned vectors of its hashed parts: the word
itself and its character n-grams. A document's vector is the mean over its
words; a softmax layer gives the classes. The model is fitted on the driver by
numpy gradient descent on a bounded sample of labelled documents. For scoring
it is reduced to one number for each hash bucket, as the layers are linear.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices, strings

BUCKETS = 1 << 17
GRAMS = 3
SIZE = 12
EPOCHS = 6
RATE = 0.4
BATCH = 32
# Labelled documents, and characters of them, that the fit reads at most.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 16_000_000
LONG = 20
SEED = 9
# Words, and characters of them, whose scores a scorer keeps at most, but for one text.
MEMO = 150_000
MEMO_CHARS = 4_000_000
# Stands for a word that repeats the one before it. It cannot be a word: it has a space.
AGAIN = "again again"


def parts_of(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its character n-grams, with its ends marked."""
    data = f"<{word}>".encode("utf-8", "surrogatepass") if word.isascii() else None
    if data is None:
        marked = f"<{word}>"
        grams = [marked[i : i + GRAMS].encode("utf-8", "surrogatepass") for i in range(len(marked) - GRAMS + 1)]
        data = marked.encode("utf-8", "surrogatepass")
    else:
        grams = [data[i : i + GRAMS] for i in range(len(data) - GRAMS + 1)]
    return [zlib.crc32(data, 1) % buckets, *[zlib.crc32(g) % buckets for g in grams]]


def words_of(text: str) -> list[str]:
    return text.split()


def repeats(words: list[str]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def counted(text: str) -> Counter[str]:
    words = words_of(text)
    counts = Counter(words)
    if again := repeats(words):
        counts[AGAIN] = again
    return counts


@dataclass
class Model:
    """``margin`` of each bucket and ``bias``: log odds of class 1 are the mean margin plus the bias."""

    margin: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict, repr=False)
    chars: int = field(default=0, repr=False)

    @classmethod
    def blank(cls, buckets: int = BUCKETS) -> Model:
        return cls(np.zeros(buckets, np.float32), 0.0)

    def __post_init__(self):
        self._list = self.margin.tolist()

    def _of(self, word: str) -> float:
        parts = parts_of(word, len(self._list))
        return sum(map(self._list.__getitem__, parts)) / len(parts)

    def score(self, text: str) -> float:
        """Probability of class 1. A text without words has that of the bias alone."""
        words = words_of(text)
        known = self.known
        if len(known) > MEMO or self.chars > MEMO_CHARS:
            self.forget()
        for word in set(words):
            if word not in known:
                known[word] = self._of(word)
                self.chars += len(word)
        total, count = sum(map(known.__getitem__, words)), len(words)
        if again := repeats(words):
            total, count = total + again * self._of(AGAIN), count + again
        odds = self.bias + (total / count if count else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -60, 60))))

    def forget(self) -> None:
        """Drop the scores of words, so that a worker does not hold them between tasks."""
        self.known.clear()
        self.chars = 0

    def __reduce__(self):
        return Model, (self.margin, self.bias)


def fit(texts: list[str], classes: list[int], buckets: int = BUCKETS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the cross entropy, each step scaled by its row's past gradients."""
    if len(set(classes)) < 2:
        return Model.blank(buckets)
    index: dict[str, int] = {}
    rows = []
    for text in texts:
        counts = counted(text)
        words = np.fromiter((index.setdefault(w, len(index)) for w in counts), np.int64, len(counts))
        weights = np.fromiter(counts.values(), np.float32, len(counts))
        rows.append((words, weights / max(1.0, weights.sum())))
    pieces = [parts_of(w, buckets) for w in index]
    ends = np.cumsum([0, *map(len, pieces)])
    flat = np.fromiter((b for row in pieces for b in row), np.int64, int(ends[-1]))
    del pieces, index

    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (buckets, SIZE)).astype(np.float32)
    past = np.full(buckets, 1e-6, np.float32)
    out, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    past_out, past_bias = np.full((SIZE, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    target = np.eye(2, dtype=np.float32)[classes]

    def inputs(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, weight and document of every part in the batch."""
        word = np.concatenate([rows[i][0] for i in batch])
        doc = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
        sizes = ends[word + 1] - ends[word]
        weight = np.concatenate([rows[i][1] for i in batch]) / sizes
        first = np.repeat(ends[word] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return flat[first + np.arange(sizes.sum())], np.repeat(weight, sizes), np.repeat(doc, sizes)

    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            bucket, weight, doc = inputs(batch) if len(batch) else (None,) * 3
            used, spot = np.unique(bucket, return_inverse=True)
            # Share of each bucket in each document.
            share = np.bincount(doc * len(used) + spot, weight, len(batch) * len(used)).astype(np.float32)
            share = share.reshape(len(batch), len(used))
            hidden = share @ vectors[used]
            odds = hidden @ out + bias
            chance = np.exp(odds - odds.max(1, keepdims=True))
            wrong = (chance / chance.sum(1, keepdims=True) - target[batch]) / len(batch)
            d_out, d_bias, d_vec = hidden.T @ wrong, wrong.sum(0), share.T @ (wrong @ out.T)
            past_out += d_out**2
            past_bias += d_bias**2
            past[used] += (d_vec**2).mean(1)
            out -= rate * d_out / np.sqrt(past_out)
            bias -= rate * d_bias / np.sqrt(past_bias)
            vectors[used] -= rate * d_vec / np.sqrt(past[used])[:, None]
    side = out[:, 1] - out[:, 0]
    return Model((vectors @ side).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> Model:
    """Fit on at most ``rows`` labelled documents and ``chars`` characters, picked by a hash of the id.

    Only documents that are not held out, with one label of 0 or 1, are read;
    equal rows count once. Documents are chosen by their length alone: one that
    does not fit is passed over, and one longer than a ``LONG``-th of ``chars``
    waits until the shorter ones are chosen. Only chosen texts are fetched.
    Without documents of both classes the model is blank: every score is 0.5.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label_col).alias("class"), F.max(label_col).alias("other"))
        .where(F.col("class") == F.col("other"))
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "class")
    # At most ``rows`` ids and classes: their size is known before they are sent to the tasks.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = found.where("text is not null").withColumn("mark", F.xxhash64("text"))
    sizes = found.select("doc_id", "class", "mark", F.length("text").alias("n")).distinct()
    few = sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(rows)
    chosen, left = [], chars
    for row in sorted(few.collect(), key=lambda r: r["n"] * LONG > chars):
        if row["n"] <= left:
            left -= row["n"]
            chosen.append(row)
    if not chosen:
        return Model.blank()
    keys = docs.sparkSession.createDataFrame(chosen, few.schema).select("doc_id", "mark")
    fetched = found.join(F.broadcast(keys), ["doc_id", "mark"]).groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    by_key = {(r["doc_id"], r["mark"]): r["text"] for r in fetched.toLocalIterator()}
    texts = [by_key[r["doc_id"], r["mark"]] for r in chosen]
    classes = [r["class"] for r in chosen]
    return fit(texts, classes)


ADDED = {"score": T.DoubleType(), "predicted": T.IntegerType()}


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1, higher: class 1 likelier) and ``predicted``.

    The whole text is scored, and nothing else of the row. A null or empty
    text has no words and gets the score of the bias alone. Rows are only
    mapped; columns with the added names are replaced. ``carry`` names the
    columns to keep, all by default; a text among them goes to the tasks once.
    The model has a fixed size.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    text = f"c{names.index('text')}" if "text" in names else "_text"
    base = docs.select(*kept, *([F.col("text").alias(text)] if text == "_text" else []))
    fields = base.schema.fields[: len(names)]
    schema = T.StructType(fields + [T.StructField(n, k) for n, k in ADDED.items()])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        try:
            for batch in slices(batches, 1000):
                scores = [scorer.score(value) for value in strings(batch, text)]
                own = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
                heads = [batch.schema.field(i) for i in range(len(fields))]
                shape = pa.schema([*heads, pa.field("score", pa.float64()), pa.field("predicted", pa.int32())])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *own], schema=shape)
        finally:
            scorer.forget()

    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *ADDED)
