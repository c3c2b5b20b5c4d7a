"""Token id files: byte-level BPE ids of documents, with Elias-Fano document boundaries.

A file holds the ids of consecutive documents one after the other, then a
footer: the boundaries and the document ids, both Elias-Fano coded. Ids take
two bytes where the vocabulary allows it. Files are written by tasks to the
shared folder and named in the rows they return; only those are read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path, written
from .elias_fano import EliasFano
from .text import slices, strings

MAGIC = b"TOKEFIDS"
FILE_IDS = 64 << 20
FILE_DOCS = 1 << 20
MEMO = 800_000
# Words that the library encodes in one call.
PART = 500
_TAIL = struct.Struct("<qqqqqq8s")
FILES = "part int, number int, file string, n_docs long, n_ids long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"

# Where white space meets a space on both sides, or ends the text, the text is
# encoded as a whole: the run is one piece there.
_RUNS = re.compile(r"\s \s|\s \Z")


# Signs behind letters are a piece of their own, however many there are. The
# apostrophe is not among them: it can take letters with it.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class SpacedEncoder:
    """The library's encoding, with the encoding of each word kept.

    Byte-level pieces start at a space that follows a word, so the ids of a
    text are those of its words, each with the space before it. A line end
    between two words is a piece of its own, and the word after it has no space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.type, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        # The byte-level name of a space; a token that has one starts with it.
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens
        named = self.tokenizer.get_vocab(with_added_tokens=True).items()
        self.starts = np.zeros(size, dtype=bool)
        self.starts[[i for t, i in named if len(space) == 1 and t.startswith(space[0]) and i < size]] = True
        # Words with a space before them have numbers in the order in which they are met.
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.packed: list[bytes] = []
        # Words without one: the first of a text or a line.
        self.bare: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.line_end = self._ids("\n")

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _ids(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _each(self, words: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of letters alone, a space before each.

        They are encoded as one text: an id whose token starts with a space is
        the first of its word.
        """
        done = self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)
        ids = np.array(done[0].ids)
        first = np.flatnonzero(self.starts[ids])
        if len(first) != len(words) or first[0]:
            return self._each([" " + w for w in words])
        packed, at = ids.astype(self.type).tobytes(), (first * self.width).tolist()
        return [packed[x:y] for x, y in zip(at, [*at[1:], len(packed)])]

    def _learn_bare(self, words: set[str]) -> None:
        new = list(words.difference(self.bare))
        for start in range(0, len(new), PART):
            part = new[start : start + PART]
            self.bare.update(zip(part, self._each(part)))

    def _learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        number, packed = self.number, self.packed
        start, lines = len(packed), []
        # Words with line ends inside are taken apart, as most of them are met once.
        for word in [w for w in islice(number, start, None) if "\n" in w]:
            parts = word.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
                lines.append((number[word], number[parts[0]], parts[1:]))
        self._learn_bare({part for _, _, parts in lines for part in parts})
        apart = {n for n, _, _ in lines}
        # Letters and the signs after them are separate pieces: the letters are encoded once for all signs.
        new = list(islice(number, start, None))
        plain = list(map(str.isalpha, new))
        places, letters = list(compress(count(start), plain)), list(compress(new, plain))
        signed, odd, others = [], [], []
        for n, word in compress(enumerate(new, start), map(not_, plain)):
            head = word.rstrip(SIGNS)
            if head != word and head.isalpha():
                known = len(number)
                at = number[head]
                if at == known:
                    places.append(at)
                    letters.append(head)
                signed.append((n, at, word[len(head) :]))
            elif n not in apart:
                odd.append(n)
                others.append(" " + word)
        packed.extend([b""] * (len(number) - start))
        for at, fresh, encode in ((places, letters, self._spaced), (odd, others, self._each)):
            for first in range(0, len(fresh), PART):
                for n, ids in zip(at[first : first + PART], encode(fresh[first : first + PART])):
                    packed[n] = ids
        signs = self.signs
        for sign in {sign for _, _, sign in signed}.difference(signs):
            signs[sign] = self._ids(sign)
        for n, head, sign in signed:
            packed[n] = packed[head] + signs[sign]
        for n, head, parts in lines:
            packed[n] = self.line_end.join([packed[head], *map(self.bare.__getitem__, parts)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.packed) > MEMO:
            self.number.clear()
            self.number.default_factory = count().__next__
            self.packed.clear()
        for known in (self.bare, self.signs):
            if len(known) > MEMO:
                known.clear()
        split = [None if _RUNS.search(text) else text.split(" ") for text in texts]
        first = [words.pop(0) if words else None for words in split]
        self._learn_bare({w for w in first if w is not None})
        number = self.number.__getitem__
        rows = [None if words is None else list(map(number, words)) for words in split]
        self._learn()
        out, get = [], self.packed.__getitem__
        for text, head, row in zip(texts, first, rows):
            out.append(self._ids(text) if row is None else self.bare[head] + b"".join(map(get, row)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> SpacedEncoder:
    """One for each Python worker, kept between tasks."""
    return SpacedEncoder(path)


def footer(ends: list[int], doc_ids: list[int | None], width: int) -> bytes:
    """Boundaries, document ids (in order, nulls first) and the numbers needed to find them."""
    nulls = sum(i is None for i in doc_ids)
    base = doc_ids[nulls] if nulls < len(doc_ids) else 0
    bounds = EliasFano.encode(np.array([0, *ends])).to_bytes()
    ids = EliasFano.encode(np.array([i - base for i in doc_ids[nulls:]], dtype=np.int64)).to_bytes()
    return bounds + ids + _TAIL.pack(len(bounds), len(ids), base, nulls, ends[-1] if ends else 0, width, MAGIC)


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        tail = source.read_at(_TAIL.size, size - _TAIL.size)
        n_bounds, n_ids, self.base, self.nulls, self.n_tokens, width, magic = _TAIL.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.type = np.dtype(f"<u{width}")
        coded = source.read_at(n_bounds + n_ids, size - _TAIL.size - n_bounds - n_ids)
        self.bounds = EliasFano.from_bytes(coded[:n_bounds])
        self.ids = EliasFano.from_bytes(coded[n_bounds:])
        self.n_docs = self.bounds.count - 1

    def doc_id(self, index: int) -> int | None:
        return None if index < self.nulls else self.base + self.ids.select(index - self.nulls)

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """Document ids from ``first`` up to ``last``."""
        nulls = min(max(self.nulls - first, 0), last - first)
        ids = self.ids.range(first + nulls - self.nulls, last - self.nulls) if nulls < last - first else []
        return [None] * nulls + [self.base + int(i) for i in ids]

    def tokens(self, first: int, last: int | None = None) -> np.ndarray:
        """Ids of the documents from ``first`` up to ``last`` (that one alone by default)."""
        start, end = self.bounds.select(first), self.bounds.select((first + 1) if last is None else last)
        width = self.type.itemsize
        return np.frombuffer(self.source.read_at((end - start) * width, start * width), self.type)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode the texts in order of doc_id and write token files; one row for each file.

    Rows are range-partitioned by doc_id, so only texts are shuffled, once;
    rows with the same doc_id are ordered, and dealt, by a hash of their text.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, out = TaskContext.get().partitionId(), 0, None
        end = np.array([end_id], encode.type).tobytes()

        def close() -> pa.RecordBatch:
            out.write(footer(ends, ids, encode.width))
            out.close()
            row = (part, number, f"{folder}/{name}", len(ids), ends[-1])
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["part", "number", "file", "n_docs", "n_ids"],
            )

        for batch in slices(batches, 1000):
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encode.encode(strings(batch, "text"))):
                if out is None:
                    name, ends, ids = f"{uuid.uuid4().hex}.tokens", [], []
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(packed + end)
                ends.append((ends[-1] if ends else 0) + len(packed) // encode.width + 1)
                ids.append(doc_id)
                if ends[-1] >= file_ids or len(ids) >= FILE_DOCS:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return ordered.drop("_h").mapInArrow(write, FILES)


TOKEN_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start over all files, number and checksum of ids.

    The files' starts are a running sum over one row for each file, and the files
    are read by as many tasks as there are files.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as source:
                    held = TokenFile(source)
                    for first in range(0, held.n_docs, 500):
                        last = min(held.n_docs, first + 500)
                        # Boundaries of these documents alone, by select.
                        bounds = held.bounds.range(first, last + 1)
                        block = held.tokens(first, last).astype("<u4")
                        at = bounds - bounds[0]
                        sums = [zlib.crc32(block[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                        ids = pa.nulls(last - first, TOKEN_ARROW.field("ids").type)
                        if with_ids:
                            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(block.astype(np.int32)))
                        doc_ids = pa.array(held.doc_ids(first, last), pa.int64())
                        columns = [doc_ids, pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), ids]
                        yield pa.RecordBatch.from_arrays(columns, schema=TOKEN_ARROW)

    # A number of its own, so that Spark does not merge the few names into one task.
    tasks = max(1, min(2 * files.count(), 10_000))
    return placed.select("file", "start").repartition(tasks, "file").mapInArrow(read, TOKENS)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files in the shared folder and read them back.

    Every text, null as the empty one, is encoded whole without added special
    tokens and ended with ``end_id``. Rows are in ascending order of doc_id,
    null ids first; rows that share an id are separate documents, in an order
    fixed by their text. Other columns take no part. The files are deleted when
    the application ends.
    """
    spark: SparkSession = docs.sparkSession
    folder = work_path(spark, "tokens")
    files = written(write_token_files(docs, tokenizer, folder, end_id), "token-files")
    return read_token_files(files, with_ids)
