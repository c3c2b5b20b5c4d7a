"""Spelling variants of words by PartEnum signatures over letter multisets.

A word is a binary vector with one element for each letter and number of its
occurrence (the second ``e`` is another element than the first). One inserted,
deleted or replaced letter changes at most two elements. The elements are dealt
by hash over ``PARTS`` parts; a signature names two parts and covers the others,
so two near words share the signature whose two parts hold their differences.
Words are equi-joined on signatures and verified inside each bucket.

A bucket can be large, as words of the same syllables are anagrams. No pairs of
it are made: the words meet on what is left of them without one letter, which
only near words share. A bucket beyond ``BUCKET_ROWS`` is dealt anew over the
cluster by signature and such a remainder.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from ..session import written
from .text import slices

LETTERS = re.compile("[A-Za-zÀ-ÿ]{7,}")
SHORTEST, LEAST = 7, 2
TIMES = 10
PARTS = 5
PAIRS = list(combinations(range(PARTS), 2))
BUCKET_ROWS, BUCKET_LETTERS = 60_000, 2_000_000
CHUNK_ROWS, CHUNK_LETTERS = 30_000, 400_000
HELD_WORDS = 200_000

_STEP, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_ONE = np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_CODES = _mixed((np.arange(256, dtype=np.uint64) + _ONE) * _STEP)


def count_words(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``(word, n)``: words of the texts, some with a letter left out, and their occurrences.

    A run of letters, A-Z in lower case, loses the letter that the crc32 of
    ``<doc_id>:<run>`` points to if 31 divides that number. A row without doc_id
    has the empty id; a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = defaultdict(int)

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], names=["word", "n"]
            )
            totals.clear()
            return out

        for batch in slices(batches, 500):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                named = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(LETTERS.findall(lowered)).items():
                    drawn = zlib.crc32(word.encode(), named)
                    if drawn % 31 == 0:
                        at = drawn % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    totals[word] += n
                if len(totals) > HELD_WORDS:
                    yield rows()
        if totals:
            yield rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Letters:
    """Words as one array of codes, with the place and owner of every letter."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.count = len(raw)
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        self.code = np.frombuffer(b"".join(raw), np.uint8)
        self.owner = np.repeat(np.arange(self.count), self.length)
        self.place = np.arange(len(self.code)) - self.start[self.owner]

    def signatures(self) -> np.ndarray:
        """One row for each word, one column for each pair of left-out parts."""
        key = self.owner * 256 + self.code
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        runs = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        occurrence = np.arange(len(ordered)) - np.repeat(runs, np.diff(np.r_[runs, len(ordered)]))
        element = ((ordered & 255) << 40) + occurrence
        value = _mixed(element.astype(np.uint64) * _STEP + _ONE)
        part = _mixed(value) % np.uint64(PARTS)
        sums = [np.add.reduceat(np.where(part == np.uint64(q), value, np.uint64(0)), self.start) for q in range(PARTS)]
        total = sum(sums[1:], sums[0])
        marks = [(total - sums[i] - sums[j]) * _STEP + np.uint64(at) for at, (i, j) in enumerate(PAIRS)]
        return _mixed(np.column_stack(marks))

    def remainders(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words, and of what is left of each without the letter at each place."""
        longest = int(self.length.max(initial=1))
        powers = np.cumprod(np.r_[_ONE, np.full(longest, _BASE, np.uint64)])
        weighted = _CODES[self.code] * powers[self.place]
        sums = np.r_[np.uint64(0), np.cumsum(weighted)]
        whole = sums[self.end] - sums[self.start]
        before = sums[:-1] - sums[self.start][self.owner]
        after = (sums[self.end][self.owner] - sums[1:]) * _INVERSE
        return whole, before + after


def _meetings(letters: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, key, role)``: where words meet.

    Words of one length meet where the letter at one place is left out (role
    0); a word (role 1) meets the longer ones of which it is a remainder (role
    2). Of equal neighbouring letters one alone is left out for the latter.
    """
    whole, left = letters.remainders()
    same = _mixed(left * _STEP + (letters.place.astype(np.uint64) + _ONE))
    once = np.flatnonzero((letters.place == 0) | (letters.code != np.r_[np.uint8(0), letters.code[:-1]]))
    shorter, longer = _mixed(whole * _STEP), _mixed(left[once] * _STEP)
    words = np.concatenate([letters.owner, np.arange(letters.count), letters.owner[once]])
    roles = np.repeat(np.array([0, 1, 2], np.int8), [len(same), len(shorter), len(longer)])
    return words, np.concatenate([same, shorter, longer]), roles


def _met(words: np.ndarray, keys: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of entries with one key: all of role 0, and each of role 1 with those of role 2.

    At most one letter differs in role 0, so such a group holds no more words
    than there are letters.
    """
    order = np.lexsort((words, roles, keys))
    keys, roles, words = keys[order], roles[order], words[order]
    first, second = [], []
    step = 1
    while len(keys) > step:
        a = np.flatnonzero((keys[:-step] == keys[step:]) & (roles[step:] == 0))
        if not len(a):
            break
        first.append(a)
        second.append(a + step)
        step += 1
    new = np.r_[True, keys[1:] != keys[:-1]]
    # Entries of role 1 sort before those of role 2: the first of the group, or none.
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(keys) else np.zeros(0, np.int64)
    b = np.flatnonzero((roles == 2) & (roles[head] == 1))
    first.append(head[b])
    second.append(b)
    return order[np.concatenate(first)], order[np.concatenate(second)]


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter tells the words apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at + (len(short) == len(long)) :] == long[at + 1 :]


def _verified(words: list[str], counts: np.ndarray, signature: np.ndarray, bucket: np.ndarray, keys=None) -> pa.RecordBatch:
    """Near words found in the buckets, added up: ``(word, n_near, best_n, best)``.

    ``words`` are distinct and in order. ``bucket`` is (place in words,
    signature) for each row; a pair counts in the first signature it shares
    alone. ``keys`` gives each row's own (key, role), where the rows are dealt
    by those already.
    """
    letters = Letters(words)
    if keys is None:
        entry, key, role = _meetings(letters)
        # Repeat a word's entries for each of its buckets.
        order = np.argsort(entry, kind="stable")
        size = np.bincount(entry, minlength=len(words))
        begin = np.cumsum(size) - size
        repeat = size[bucket]
        row = np.repeat(np.arange(len(bucket)), repeat)
        at = order[np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat) + begin[bucket][row]]
        key, role = _mixed(key[at] ^ signature[row]), role[at]
    else:
        row, (key, role) = np.arange(len(bucket)), keys
    # Entries that meet nothing go before the sort that pairs need.
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    some = np.flatnonzero(np.isin(key, twice))
    x, y = _met(bucket[row[some]], key[some], role[some])
    x, y = some[x], some[y]
    one, two, shared = bucket[row[x]], bucket[row[y]], signature[row[x]]
    involved, spot = np.unique(np.concatenate([one, two]), return_inverse=True)
    if len(involved):
        all_signatures = Letters([words[i] for i in involved]).signatures()
        left, right = all_signatures[spot[: len(one)]], all_signatures[spot[len(one) :]]
        first = (left == right).argmax(axis=1)
        good = left[np.arange(len(one)), first] == shared
        one, two = one[good], two[good]
    keep = np.fromiter((near(words[a], words[b]) for a, b in zip(one.tolist(), two.tolist())), bool, len(one))
    a, b = np.concatenate([one[keep], two[keep]]), np.concatenate([two[keep], one[keep]])
    order = np.lexsort((b, -counts[b], a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in a[heads].tolist()], pa.string()),
            pa.array(np.diff(np.r_[heads, len(a)]), pa.int64()),
            pa.array(counts[b[heads]], pa.int64()),
            pa.array([words[i] for i in b[heads].tolist()], pa.string()),
        ],
        names=["word", "n_near", "best_n", "best"],
    )


def _distinct(column: pa.Array, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words in code point order, their counts, and each row's place among them."""
    coded = column.dictionary_encode()
    found, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    order = sorted(range(len(found)), key=found.__getitem__)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    spots = place[index]
    per_word = np.zeros(len(found), np.int64)
    per_word[spots] = counts
    return [found[i] for i in order], per_word, spots


def _grouped(batches: Iterator[pa.RecordBatch], by: str, rows: int) -> Iterator[pa.Table]:
    """Rows sorted by ``by`` in tables of at least ``rows`` rows that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        values = table.column(by).to_numpy()
        change = np.flatnonzero(values[1:] != values[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
        else:
            held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 5000):
        marks = Letters(batch.column("word").to_pylist()).signatures().view(np.int64)
        row = np.repeat(np.arange(len(marks)), len(PAIRS))
        yield pa.RecordBatch.from_arrays(
            [pa.array(marks.ravel()), batch.column("word").take(pa.array(row)), batch.column("n").take(pa.array(row))],
            names=["signature", "word", "n"],
        )


FOUND = "word string, n_near long, best_n long, best string, signature long, n long"


def _verify(bucket_rows: int, chunk_rows: int):
    """Task function over rows sorted by signature: near words, and the rows of buckets beyond the bound."""

    def letters(table: pa.Table) -> int:
        return pc.sum(pc.utf8_length(table.column("word"))).as_py() or 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
        """Tables of whole buckets, and of a bucket that goes on beyond the bound, piece by piece."""
        held: pa.Table | None = None
        large = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            held = None
            values = table.column("signature").to_numpy()
            if large is not None:
                cut = int(np.searchsorted(values != large, True)) if (values != large).any() else len(values)
                if cut:
                    yield table.slice(0, cut), True
                table = table.slice(cut)
                values = values[cut:]
                if not len(values):
                    continue
                large = None
            if len(values) < chunk_rows and letters(table) < CHUNK_LETTERS:
                held = table
                continue
            change = np.flatnonzero(values[1:] != values[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield table.slice(0, cut), False
            rest = table.slice(cut).combine_chunks()
            if rest.num_rows > bucket_rows or letters(rest) > BUCKET_LETTERS:
                large = values[-1]
                yield rest, True
            else:
                held = rest
        if held is not None and held.num_rows:
            yield held, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, large in parts(batches):
            table = table.combine_chunks()
            if large:
                none = pa.nulls(table.num_rows, pa.int64())
                columns = [table.column("word"), none, none, pa.nulls(table.num_rows, pa.string())]
                columns += [table.column("signature"), table.column("n")]
                named = pa.table(columns, names=["word", "n_near", "best_n", "best", "signature", "n"])
                yield from named.combine_chunks().to_batches()
                continue
            signature = table.column("signature").to_numpy().view(np.uint64)
            new = np.r_[True, signature[1:] != signature[:-1]]
            shared = np.flatnonzero(~(new & np.r_[new[1:], True]))
            table, signature = table.take(pa.array(shared)), signature[shared]
            if not len(signature):
                continue
            words, counts, spots = _distinct(table.column("word").combine_chunks(), table.column("n").to_numpy())
            found = _verified(words, counts, signature, spots)
            none = pa.nulls(found.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*found.columns, none, none], names=["word", "n_near", "best_n", "best", "signature", "n"]
            )

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets under signature and remainder."""
    for batch in slices(batches, 5000):
        words, keys, roles = _meetings(Letters(batch.column("word").to_pylist()))
        signature = batch.column("signature").to_numpy().view(np.uint64)
        take = pa.array(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_mixed(keys ^ signature[words]).view(np.int64)), pa.array(roles)]
            + [batch.column(n).take(take) for n in ("signature", "word", "n")],
            names=["key", "role", "signature", "word", "n"],
        )


def _verify_spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _grouped(batches, "key", CHUNK_ROWS):
        key = table.column("key").to_numpy().view(np.uint64)
        words, counts, spots = _distinct(table.column("word").combine_chunks(), table.column("n").to_numpy())
        signature = table.column("signature").to_numpy().view(np.uint64)
        yield _verified(words, counts, signature, spots, (key, table.column("role").to_numpy()))


def near_words(words: DataFrame, bucket_rows: int = BUCKET_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(word, n, n_near, best_n, best)``: the number of words near each word, and the most frequent of them.

    ``words`` is (word, n), each word once. Of near words equally frequent the
    first in code point order is the best.
    """
    posted = words.mapInArrow(_post, "signature long, word string, n long")
    dealt = posted.repartition("signature").sortWithinPartitions("signature")
    found = written(dealt.mapInArrow(_verify(bucket_rows, chunk_rows), FOUND), "near-words")
    large = found.where("signature IS NOT NULL").select("signature", "word", "n")
    spread = large.mapInArrow(_spread, "key long, role byte, signature long, word string, n long")
    more = (
        spread.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_verify_spread, "word string, n_near long, best_n long, best string")
    )
    every = found.where("signature IS NULL").select("word", "n_near", "best_n", "best").unionByName(more)
    best = F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), "best"))
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus:long,best:string>").alias("top"))
    rows = rows.unionByName(every.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("top")))
    grouped = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("top").alias("top"))
    return grouped.select("word", "n", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """``(word, root)`` for ``(word, form)``: the last form, found by doubling the steps.

    A form is ten times as frequent as its word, so a path has fewer than
    twenty steps.
    """
    tree = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(rounds):
        above = tree.select(F.col("word").alias("root"), F.col("root").alias("top"))
        if above.join(tree.select("root").distinct(), "root", "left_semi").isEmpty():
            return tree
        tree = written(
            salted_join(tree, above, ["root"], ["word"], "left", salts=8).select("word", F.coalesce("top", "root").alias("root")),
            "forms",
        )
    raise RuntimeError(f"forms did not end in {rounds} steps")


def spelling_variants(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: one row for each word of at least 7 letters that occurs twice.

    A word's form is the most frequent word near it (ties: the first in code
    point order) if that is at least ten times as frequent, else null; its root
    is the last form on the way. Repeated rows count as often as they occur.
    Null and empty texts have no words; other columns take no part, and an
    empty table gives an empty result.
    """
    words = written(count_words(docs).where(F.col("n") >= LEAST), "words")
    found = near_words(words, bucket_rows, chunk_rows)
    formed = F.col("best_n") >= F.col("n") * TIMES
    rows = written(
        found.select(
            "word",
            F.when(formed, F.col("best")).alias("form"),
            "n",
            "n_near",
            F.when(formed, F.col("best_n")).alias("form_n"),
        ),
        "word-forms",
    )
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
