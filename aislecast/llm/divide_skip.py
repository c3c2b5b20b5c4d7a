"""T-occurrence search over inverted lists by DivideSkip.

A query asks for the documents that are in at least T of the lists of its
tokens. The longest lists are set aside: a document in T of all lists is in T
less their number of the short ones, so these alone are merged by a heap. The
few candidates are then looked up in the long lists by binary search, until
they reach T or cannot any more.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np

# How much a step of the merge costs against a probe; a small value sets many lists aside.
RATIO = 0.0085


class InvertedLists:
    """Inverted lists of sets, each an ascending array of tokens."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        self.begin = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
        self.tokens = tokens[self.begin]
        self.end = np.r_[self.begin[1:], len(tokens)].astype(np.int64)
        self.owners = owners[order].tolist()

    def search(self, query: np.ndarray, percent: int) -> Iterator[int]:
        """Places of the sets with ``100 * intersection >= percent * union``, in order."""
        least = needed(len(query), 0, percent)
        at = np.searchsorted(self.tokens, query)
        known = at < len(self.tokens)
        known[known] = self.tokens[at[known]] == query[known]
        at = at[known]
        if not len(query) or len(at) < least:
            return
        length = self.end[at] - self.begin[at]
        order = np.argsort(length, kind="stable")[::-1]
        lists = [*zip(self.begin[at][order].tolist(), self.end[at][order].tolist())]
        longest = lists[0][1] - lists[0][0]
        aside = min(least - 1, int(least / (RATIO * math.log2(longest) + 1)))
        long, short = lists[:aside], lists[aside:]
        merged = heapq.merge(*(self.owners[a:b] for a, b in short))
        for owner, hits in groupby(merged):
            found = sum(1 for _ in hits)
            need = needed(len(query), self.sizes[owner], percent)
            left = len(long)
            for a, b in reversed(long):
                if found >= need or found + left < need:
                    break
                place = bisect_left(self.owners, owner, a, b)
                found += place < b and self.owners[place] == owner
                left -= 1
            if found >= need:
                yield owner


def needed(one: int, other: int, percent: int) -> int:
    """Least overlap of similar sets of these sizes; of one size and any other, if ``other`` is 0."""
    by_size = -(-percent * max(one, other) // 100)
    return max(by_size, -(-percent * (one + other) // (100 + percent)) if other else by_size)
