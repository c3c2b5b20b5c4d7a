"""BPE encoding by traversal of a trie of words, and decoding.

The encoding of a word by ranked merges has a useful property: the encoding of
every prefix ends in one fixed token, and a row of tokens is an encoding if each
pair of neighbours is one. So the distinct words of a batch go into a trie, and
a depth-first walk finds the last token of each prefix once, from the last
tokens of the shorter prefixes on its path. Words that share a prefix share its
work; the tokens of a word are read off backwards from its end.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices, strings

# What an encoder keeps at most, but for one batch of texts: words and pieces, characters
# of what is kept for them, checked pairs of tokens, and states. Some 100 MB in all.
MEMO = 100_000
MEMO_CHARS = 16_000_000
PAIRS = 200_000
STATES = 50_000
ADDED = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}

# The characters with the White_Space property.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{WHITE_SPACE}]+")
# str.split() also cuts at these four.
_SEPARATORS = re.compile("[\x1c-\x1f]")


# Signs that are one piece behind letters, if the tokenizer file says so. The
# apostrophe is not among them: it can take letters with it.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS = "".join(chr(c) for c in range(0x100) if _LATIN.fullmatch(chr(c)))


class TrieEncoder:
    """Encodes words with the vocabulary and merges of a tokenizer file."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        inner: dict[str, int] = {}
        final: dict[str, int] = {}
        # Tokens of one character, with or without the suffix.
        self.single: set[int] = set()
        for token, number in vocab.items():
            ends = bool(suffix) and token.endswith(suffix) and token != suffix
            stem = token[: -len(suffix)] if ends else token
            (final if ends else inner)[stem] = number
            if len(stem) == 1:
                self.single.add(number)
        self.inner, self.final = inner, final if suffix else inner
        self.begins = {stem[:n] for stem in (*inner, *final) for n in range(1, len(stem) + 1)}
        self.vocab, self.width = vocab, max(vocab.values()) + 1
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        self.halves = {token: (i, *pair) for pair, (i, token) in self.rank.items()}
        # Each token is made by one merge, which comes behind those of its halves.
        self.ordered = len(self.halves) == len(merges) and all(
            self._made(x) < i for i, *pair in self.halves.values() for x in pair
        )
        self.names = {} if self.ordered else {number: token for token, number in vocab.items()}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.states: dict[str, tuple[str, list[tuple[int, int]], list[tuple[int, int]]]] = {}

    def _made(self, token: int) -> int:
        """The rank of the merge that makes ``token``, -1 for a single character."""
        return self.halves[token][0] if token in self.halves else -1

    def _atoms(self, token: int) -> tuple[str, ...]:
        """The characters of ``token``, the last one with the suffix if it ends a word."""
        name, suffix = self.names[token], self.suffix
        if suffix and name.endswith(suffix) and name != suffix:
            return (*name[: -len(suffix) - 1], name[-len(suffix) - 1 :])
        return tuple(name)

    def by_merges(self, atoms: Iterable[str]) -> list[int]:
        """The ranked merges themselves, for a few atoms."""
        row = [self.vocab[a] for a in atoms]
        none = (len(self.rank), -1)
        while len(row) > 1:
            best = min((self.rank.get(pair, none) for pair in zip(row, row[1:])))
            if best is none or best[1] < 0:
                break
            out, i = [], 0
            while i < len(row):
                if i + 1 < len(row) and self.rank.get((row[i], row[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            row = out
        return row

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` stays as it is behind ``before`` (-1: at the start of the word)."""
        if not self.ordered:
            head = self._atoms(before) if before >= 0 else ()
            return self.by_merges(head + self._atoms(token)) == [t for t in (before, token) if t >= 0]
        return self._whole(token) and (before < 0 or self._whole(before) and self._apart(before, token, len(self.rank)))

    def _whole(self, token: int) -> bool:
        """Whether the merges make ``token`` of its characters."""
        known = self.whole.get(token)
        if known is None:
            if token in self.halves:
                rank, left, right = self.halves[token]
                known = self._whole(left) and self._whole(right) and self._apart(left, right, rank)
            else:
                known = token in self.single
            self.whole[token] = known
        return known

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge below the rank ``limit`` joins tokens across the place where two whole ones meet.

        The merges are undone, the last one first. Two tokens that met there
        until the merge of rank ``limit`` have no merge of their own before it;
        of equal merges the one further to the left comes first.
        """
        rank, halves, none = self.rank, self.halves, (-1, -1, -1)
        while True:
            joined = rank.get((left, right))
            if joined is not None and joined[0] < limit:
                return False
            (a, _, tail), (b, head, _) = halves.get(left, none), halves.get(right, none)
            if a > b:
                left, limit = tail, a
            elif b >= 0:
                right, limit = head, b + 1
            else:
                return True

    def _state(self, text: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
        """The longest end of ``text`` that begins a token, and the tokens that end there.

        Tokens are ``(token, length)``, longest first: those inside a word, and
        those at its end.
        """
        start = 0
        while start < len(text) and text[start:] not in self.begins:
            start += 1
        state = text[start:]
        ends = [(state[i:], len(state) - i) for i in range(len(state))]
        inner, final = ([(at[t], n) for t, n in ends if t in at] for at in (self.inner, self.final))
        found = self.states[text] = (state, inner, final)
        return found

    def _last(self, ending: list[tuple[int, int]], last: list[int], end: int, text: str) -> tuple[int, int]:
        """Last token of the encoding of ``text[:end]`` and its length: the longest one that ends there
        and fits behind the last token of what is left."""
        pairs, width = self.pairs, self.width
        for found in ending:
            token, size = found
            before = last[end - size]
            pair = before * width + token
            known = pairs.get(pair)
            if known is None:
                known = pairs[pair] = self.fits(before, token)
            if known:
                return found
        raise KeyError(f"no token ends {text[:end]!r}")

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each word, none of them empty.

        In sorted order the words are the leaves of their trie as a depth-first
        walk meets them. ``last`` and ``size`` hold the branch that leads to the
        present leaf; going on to the next one keeps the shared part.
        """
        for kept, most in ((self.pairs, PAIRS), (self.states, STATES)):
            if len(kept) > most:
                kept.clear()
        found: dict[str, list[int]] = {}
        states, step, new_state = self.states, self._last, self._state
        pairs, known, width = self.pairs, self.pairs.get, self.width
        last, size, state, branch = [-1], [0], [""], ""
        for word in sorted(words):
            stem = word[:-1]
            shared, most = 0, min(len(stem), len(branch))
            while shared < most and stem[shared] == branch[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], state[shared + 1 :]
            branch, at = stem, state[shared]
            for end in range(shared + 1, len(stem) + 1):
                text = at + stem[end - 1]
                at, ending, _ = states.get(text) or new_state(text)
                # The first that is known to fit, mostly the longest.
                for token, n in ending:
                    if known(last[end - n] * width + token):
                        break
                    if (last[end - n] * width + token) not in pairs:
                        token, n = step(ending, last, end, stem)
                        break
                else:
                    raise KeyError(f"no token ends {stem[:end]!r}")
                last.append(token)
                size.append(n)
                state.append(at)
            text = at + word[-1]
            token, n = step((states.get(text) or new_state(text))[2], last, len(word), word)
            row, rest = [token], len(word) - n
            while rest:
                row.append(last[rest])
                rest -= size[rest]
            found[word] = row[::-1]
        return found


class WordEncoder:
    """Encodes texts word by word: each distinct word once, through the trie."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encoder = TrieEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.token = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Words have numbers in the order in which they are met; by number, their ids and
        # their tokens, each joined by one space. The same of pieces, by piece.
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids: list[str] = []
        self.tokens: list[str] = []
        self.piece_ids: dict[str, str] = {}
        self.piece_tokens: dict[str, str] = {}
        self.chars = 0
        # Letters of one piece in normal form, and signs that are a piece of their own behind letters.
        normal = {c: self._cut(c) for c in _LETTERS}
        self.letters = {ord(c): p[0] for c, p in normal.items() if len(p) == 1}
        self.whole = len(self.letters) == len(normal) and self._cut(_LETTERS) == ["".join(p for [p] in normal.values())]
        self.lowers = all(self.letters.get(ord(c)) == c.lower() for c in _LETTERS if c.isascii())
        together = self._cut("a" + SIGNS) == ["a", SIGNS]
        self.signs = "".join(c for c in SIGNS if together and self._cut("a" + c) == ["a", c])

    def _cut(self, word: str) -> list[str]:
        """The word in normal form, cut as the tokenizer file says."""
        normal = self.tokenizer.normalizer.normalize_str(word)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _learn(self, words: list[str]) -> None:
        """Keep the joined ids and the joined tokens of new words, in their order."""
        # Letters and the signs behind them are taken by table, other words are cut.
        heads, tails, cut = [], [], {}
        for n, word in enumerate(words):
            head = word.rstrip(self.signs)
            if self.whole and head.isalpha() and (head.isascii() or _LATIN.fullmatch(head)):
                heads.append(head.lower() if self.lowers and head.isascii() else head.translate(self.letters))
                tails.append(word[len(head) :])
            else:
                special = "<|" in word and any(s in word for s in self.special)
                cut[n] = None if special else self._cut(word)
                heads.append("")
                tails.append("")
        ids_of, tokens_of = self.piece_ids, self.piece_tokens
        new = set(heads).union(tails, *filter(None, cut.values())).difference(ids_of, [""])
        for piece, ids in self.encoder.encode(new).items():
            ids_of[piece], tokens_of[piece] = joined = self._joined(ids)
            self.chars += len(piece) + len(joined[0]) + len(joined[1])
        for n, (head, tail) in enumerate(zip(heads, tails)):
            if tail:
                ids, tokens = f"{ids_of[head]} {ids_of[tail]}", f"{tokens_of[head]} {tokens_of[tail]}"
            elif head:
                ids, tokens = ids_of[head], tokens_of[head]
            elif cut[n] is None:
                ids, tokens = self._joined(self.tokenizer.encode(words[n], add_special_tokens=False).ids)
            else:
                ids, tokens = " ".join(map(ids_of.__getitem__, cut[n])), " ".join(map(tokens_of.__getitem__, cut[n]))
            self.ids.append(ids)
            self.tokens.append(tokens)
            self.chars += len(words[n]) + len(ids) + len(tokens)

    def _joined(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join([self.token[i] for i in ids])

    def _forget_words(self) -> None:
        self.number.clear()
        self.number.default_factory = count().__next__
        for kept in (self.ids, self.tokens, self.piece_ids, self.piece_tokens):
            kept.clear()
        self.chars = 0

    def forget(self) -> None:
        """Drop all that was kept of texts, so that a worker does not hold it between tasks."""
        self._forget_words()
        self.encoder.pairs.clear()
        self.encoder.states.clear()

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of tokens, ids and decoded tokens, both joined by one space."""
        if max(len(self.ids), len(self.piece_ids)) > MEMO or self.chars > MEMO_CHARS:
            self._forget_words()
        number, rows = self.number.__getitem__, []
        for t in texts:
            words = [w for w in _SPACES.split(t) if w] if _SEPARATORS.search(t) else t.split()
            rows.append(list(map(number, words)))
        new = list(islice(self.number, len(self.ids), None))
        for start in range(0, len(new), 50_000):
            self._learn(new[start : start + 50_000])
        ids_of, tokens_of, out = self.ids.__getitem__, self.tokens.__getitem__, []
        for row in rows:
            ids = " ".join(map(ids_of, row))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(tokens_of, row))))
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept between tasks without what it learned from texts."""
    return WordEncoder(path)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_and_decode(
    docs: DataFrame, tokenizer: str, text_col: str = "text", with_ids: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """All rows and columns of ``docs`` (or those of ``carry``) with the token ids of the whole text and the decoded text's digest.

    Added columns (others of these names are replaced): ``n_tokens``, ``ids``
    (null unless ``with_ids``), ``ids_sha256`` (of the decimal ids joined by
    one space) and ``decoded_sha256``. A null text is the empty one and has no
    tokens. Rows are only mapped: repeated rows, ties and nulls in other columns
    pass through, an empty table gives an empty one.
    """
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED]
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text")
    )
    fields = [f for f in base.schema.fields if f.name != "_text"]
    schema = T.StructType(fields + [T.StructField(n, k) for n, k in ADDED.items()])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        try:
            for batch in slices(batches, 500):
                done = encoder.encode(strings(batch, "_text"))
                own = [
                    pa.array([n for n, _, _ in done], pa.int64()),
                    pa.array([list(map(int, i.split())) if with_ids else None for _, i, _ in done], pa.list_(pa.int32())),
                    pa.array([sha256(i) for _, i, _ in done], pa.string()),
                    pa.array([sha256(d) for _, _, d in done], pa.string()),
                ]
                arrays = batch.columns[: len(fields)]
                heads = [batch.schema.field(i) for i in range(len(fields))]
                names_own = [pa.field(n, a.type) for n, a in zip(ADDED, own)]
                yield pa.RecordBatch.from_arrays([*arrays, *own], schema=pa.schema(heads + names_own))
        finally:
            encoder.forget()

    out = base.mapInArrow(encode, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *ADDED)
