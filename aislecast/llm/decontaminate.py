"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items: ten consecutive words, or
a whole shorter item. Words are the alphabet: a document becomes an array of
word numbers, and a shift table over blocks of two words tells how far the
search may skip. Where the shift is zero, the block picks a bucket of patterns,
and comparing their words confirms an occurrence.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
BLOCK = 2
# Words of benchmark text that one search table may hold (about 100 MB in a
# task); a larger benchmark is searched in several passes.
PASS_WORDS = 200_000

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_SPACED = bytes(b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text in lower case (A-Z), as UTF-8.

    Every byte of a character beyond ASCII is 0x80 or more, so the words can be
    cut on bytes.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


class WuManber:
    """Search table for patterns of one length over numbered words."""

    def __init__(self, patterns: dict[tuple[int, ...], list[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[object, int] = {}
        self.bucket: dict[object, list[tuple[tuple[int, ...], list[str]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = self._key(pattern, end)
                step = self.length - end
                if step < self.shift.get(key, self.far):
                    self.shift[key] = step
            self.bucket[self._key(pattern, self.length)].append((pattern, items))

    def _key(self, words: tuple[int, ...] | list[int], end: int) -> object:
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def occurrences(self, words: list[int]) -> Iterator[tuple[int, list[str]]]:
        """Start of each occurrence and the items that hold the window."""
        end, stop, block, far = self.length, len(words), self.block, self.far
        shift_of = self.shift.get
        while end <= stop:
            key = words[end - 1] if block == 1 else (words[end - 2], words[end - 1])
            step = shift_of(key, far)
            if step:
                end += step
                continue
            start = end - self.length
            here = tuple(words[start:end])
            for pattern, items in self.bucket[key]:
                if pattern == here:
                    yield start, items
            end += 1


class Benchmark:
    """Numbered words and one search table for each window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(dict)
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            size = min(window, len(words))
            for start in range(len(words) - size + 1 if size else 0):
                holders = by_length[size].setdefault(tuple(words[start : start + size]), [])
                if not holders or holders[-1] != item:
                    holders.append(item)
        self.searches = [WuManber(patterns) for _, patterns in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of words (merged, in order) and the items with occurrences."""
        number = self.number.get
        coded = [number(w, -1) for w in words]
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        for search in self.searches:
            for start, items in search.occurrences(coded):
                ranges.append((start, start + search.length))
                found.update(items)
        return merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_HITS = "array<struct<start:int,end:int>>"
_ITEMS = "array<string>"
OWN = {"_n_words": "long", "_hits": _HITS, "_items": _ITEMS}
_OWN_ARROW = [
    pa.field("_n_words", pa.int64()),
    pa.field("_hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    pa.field("_items", pa.list_(pa.string())),
]


def _passes(benchmark: DataFrame, pass_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in parts of at most ``pass_words`` words (or one item), each read by the driver on its own.

    An item that is larger than a part is one part. The parts are cut by the
    running number of words, so each holds a bounded part of the benchmark.
    """
    rough = F.size(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    sized = benchmark.select(F.col("item_id").cast("string").alias("item"), "text", rough.cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    if total <= pass_words:
        yield [(r["item"], r["text"]) for r in sized.where("item is not null").collect()]
        return
    parts = -(-2 * total // pass_words)
    dealt = sized.where("item is not null").withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    for part in range(parts):
        yield [(r["item"], r["text"]) for r in dealt.where(F.col("part") == part).collect()]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", pass_words: int = PASS_WORDS
) -> DataFrame:
    """All rows and columns of ``docs`` with what they share with the benchmark.

    Added columns (others of these names are replaced): ``n_words``, ``n_hit``
    (words inside an occurrence of any window), ``hits`` (merged word ranges,
    end exclusive), ``items`` (ids of items with occurrences, sorted as
    strings), ``contaminated``.

    The rows are read once for each pass and never shuffled. The benchmark is
    counted first; up to ``pass_words`` words it goes to the tasks as one
    table, beyond that in passes over parts of it. A null or empty text has no
    words. A benchmark item without words, or without an id, matches nothing.
    Items with the same id are one item with the windows of all its texts. An
    empty table gives an empty result, an empty benchmark no hits.
    """
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index(text_col)}"
    out = base.withColumns({name: F.lit(None).cast(kind) for name, kind in OWN.items()})
    schema = T.StructType(base.schema.fields + [T.StructField(n, T._parse_datatype_string(k)) for n, k in OWN.items()])

    for items in _passes(benchmark, pass_words):
        table = docs.sparkSession.sparkContext.broadcast(Benchmark(items, window))

        def scan(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            search = table.value
            for batch in batches:
                count, hits, found = [], [], []
                old_hits, old_items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
                for value, before, known in zip(batch.column(text).to_pylist(), old_hits, old_items):
                    words = words_of(value)
                    ranges, named = search.hits(words)
                    count.append(len(words))
                    if before:
                        ranges = merged(ranges + [(r["start"], r["end"]) for r in before])
                    hits.append([{"start": s, "end": e} for s, e in ranges])
                    found.append(sorted(named.union(known or ())))
                arrays = [batch.column(i) for i in range(batch.num_columns - len(_OWN_ARROW))]
                own = [pa.array(v, f.type) for v, f in zip((count, hits, found), _OWN_ARROW)]
                fields = [batch.schema.field(i) for i in range(len(arrays))] + _OWN_ARROW
                yield pa.RecordBatch.from_arrays(arrays + own, schema=pa.schema(fields))

        out = out.mapInArrow(scan, schema)

    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda total, r: total + r["end"] - r["start"])
    added = {
        "n_words": F.col("_n_words"),
        "n_hit": n_hit,
        "hits": F.col("_hits"),
        "items": F.col("_items"),
        "contaminated": F.size("_hits") > 0,
    }
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in added]
    return out.select(*kept, *[value.alias(name) for name, value in added.items()])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
