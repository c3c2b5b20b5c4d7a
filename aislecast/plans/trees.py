"""Regression trees as arrays: growth on binned rows in one place, and prediction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

BINS = 256
# Splits must lower the loss by more than rounding does.
LEAST_GAIN = 1e-9
# Rows for each node from which on rows are told apart node by node.
ROWS_A_NODE = 64


@dataclass(frozen=True)
class Growth:
    """How one tree grows. ``depth`` None sets no limit; ``l2`` is added to every node's weight."""

    depth: int | None = None
    l2: float = 0.0
    least_weight: float = 1.0


@dataclass
class Tree:
    """Nodes of one tree. A leaf has feature -1 and gain 0; the right child follows the left one."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    KINDS = (np.int16, np.int16, np.int32, np.float64, np.float64)

    @classmethod
    def of(cls, *parts) -> Tree:
        """A tree of five lists, or of five byte strings."""
        read = [np.frombuffer(p, k) if isinstance(p, bytes) else np.array(p, k) for p, k in zip(parts, cls.KINDS)]
        return cls(*read)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.feature, self.bin, self.left, self.value, self.gain

    def leaves(self, codes: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every column of ``codes`` (features x rows)."""
        if start is None and codes.shape[1] >= ROWS_A_NODE * len(self.feature):
            ends = np.flatnonzero(self.feature < 0).tolist()
            node = np.empty(codes.shape[1], np.int64)
            for end, rows in zip(ends, self.parted(codes, np.arange(codes.shape[1]), ends)):
                node[rows] = end
            return node
        node = np.zeros(codes.shape[1], np.int64) if start is None else start
        rows = np.flatnonzero(self.feature[node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = self.left[at] + (codes[self.feature[at], rows] > self.bin[at])
            rows = rows[self.feature[node[rows]] >= 0]
        return node


    def parted(self, codes: np.ndarray, rows: np.ndarray, nodes: Sequence[int]) -> list[np.ndarray]:
        """Those of ``rows`` that fall into each of the ascending ``nodes``, in their order."""
        inner = np.flatnonzero(self.feature >= 0)
        above = np.zeros(len(self.feature), np.int64)
        above[self.left[inner]] = above[self.left[inner] + 1] = inner
        # Only branches that lead to one of the nodes are followed.
        leads = np.zeros(len(self.feature), bool)
        leads[nodes] = True
        for n in range(len(leads) - 1, 0, -1):
            if leads[n]:
                leads[above[n]] = True
        wanted, found, todo = set(nodes), {}, [(0, rows)] if len(nodes) else []
        while todo:
            n, held = todo.pop()
            if n in wanted:
                found[n] = held
                continue
            left = int(self.left[n])
            right = codes[self.feature[n]].take(held) > self.bin[n]
            if leads[left + 1]:
                todo.append((left + 1, held[right]))
            if leads[left]:
                todo.append((left, held[~right]))
        return [found[n] for n in nodes]


def leaf_value(gradient, weight, l2: float):
    return -gradient / (weight + l2)


def _gain(g, h, l2: float):
    return g * g / np.maximum(h + l2, 1e-300)


def best_split(gradient: np.ndarray, weight: np.ndarray, growth: Growth) -> tuple[int, int, float, float, float]:
    """``(feature, bin, gain, left gradient, left weight)`` of a (features x bins) histogram; feature -1 if none.

    Rows of bins up to the split's go left. Ties go to the first feature, then the first bin.
    """
    g, h = gradient[0].sum(), weight[0].sum()
    gl, hl = np.cumsum(gradient, axis=1)[:, :-1], np.cumsum(weight, axis=1)[:, :-1]
    hr = h - hl
    gain = _gain(gl, hl, growth.l2) + _gain(g - gl, hr, growth.l2) - _gain(g, h, growth.l2)
    allowed = (hl >= growth.least_weight) & (hr >= growth.least_weight - 1e-9) & (hr > 1e-9) & (hl > 0)
    gain = np.where(allowed, gain, -np.inf)
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (-1, 0)
    if not gain.size or not gain[feature, at] > LEAST_GAIN:
        return -1, 0, 0.0, 0.0, 0.0
    return int(feature), int(at), float(gain[feature, at]), float(gl[feature, at]), float(hl[feature, at])


def grow(codes: np.ndarray, gradient: np.ndarray, weight: np.ndarray, growth: Growth, features: np.ndarray) -> Tree:
    """Grow a tree on rows in memory, all nodes of a level at once.

    ``codes`` is features x rows; only the rows of ``features`` are split on.
    ``gradient`` is already multiplied by the weight. The bins present in a
    node are counted, or sorted where the nodes are many and small, so the work of
    a level does not depend on the number of nodes.
    """
    feature, cut, left, gained = [-1], [0], [0], [0.0]
    value = [float(leaf_value(gradient.sum(), weight.sum(), growth.l2))]
    rows, node = np.arange(len(weight)), np.zeros(len(weight), np.int64)
    ids = np.zeros(1, np.int64)
    bins = [int(c.max(initial=0)) + 1 for c in codes]
    depth = 0
    while len(rows) and (growth.depth is None or depth < growth.depth):
        drawn_g, drawn_h = gradient[rows], weight[rows]
        total_g = np.bincount(node, drawn_g, len(ids))
        total_h = np.bincount(node, drawn_h, len(ids))
        best = np.full(len(ids), LEAST_GAIN)
        which, at = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        left_g, left_h = np.zeros(len(ids)), np.zeros(len(ids))
        for f in features:
            key = node * bins[f] + codes[f][rows]
            if len(ids) * bins[f] <= 4 * len(rows):
                keys = np.flatnonzero(np.bincount(key))
                g, h = np.bincount(key, drawn_g)[keys], np.bincount(key, drawn_h)[keys]
            else:
                keys, spot = np.unique(key, return_inverse=True)
                g, h = np.bincount(spot, drawn_g), np.bincount(spot, drawn_h)
            owner = keys // bins[f]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(keys)])
            sums_g, sums_h = np.cumsum(g), np.cumsum(h)
            gl = sums_g - np.repeat(sums_g[first] - g[first], size)
            hl = sums_h - np.repeat(sums_h[first] - h[first], size)
            gt, ht = total_g[owner], total_h[owner]
            hr = ht - hl
            gain = _gain(gl, hl, growth.l2) + _gain(gt - gl, hr, growth.l2) - _gain(gt, ht, growth.l2)
            last = np.r_[owner[1:] != owner[:-1], True]
            bad = last | (hl < growth.least_weight) | (hr < growth.least_weight - 1e-9) | (hr <= 1e-9)
            gain[bad] = -np.inf
            top = np.maximum.reduceat(gain, first)
            better = top > best[owner[first]]
            if not better.any():
                continue
            # The first place of each node that reaches its best gain.
            hit = np.flatnonzero(gain == np.repeat(top, size))
            hit = hit[np.r_[True, owner[hit][1:] != owner[hit][:-1]]]
            chosen = hit[better]
            n = owner[chosen]
            best[n], which[n], at[n] = gain[chosen], f, keys[chosen] % bins[f]
            left_g[n], left_h[n] = gl[chosen], hl[chosen]
        split = np.flatnonzero(which >= 0)
        if not len(split):
            break
        begin = len(feature) + 2 * np.arange(len(split))
        for n, b in zip(split, begin):
            feature[ids[n]], cut[ids[n]], left[ids[n]], gained[ids[n]] = int(which[n]), int(at[n]), int(b), float(best[n])
        sides_g = np.column_stack([left_g[split], total_g[split] - left_g[split]]).ravel()
        sides_h = np.column_stack([left_h[split], total_h[split] - left_h[split]]).ravel()
        feature += [-1] * len(sides_g)
        cut += [0] * len(sides_g)
        left += [0] * len(sides_g)
        gained += [0.0] * len(sides_g)
        value += leaf_value(sides_g, sides_h, growth.l2).tolist()
        place = np.full(len(ids), -1)
        place[split] = np.arange(len(split))
        kept = place[node] >= 0
        rows, node = rows[kept], node[kept]
        side = codes[which[node], rows] > at[node]
        node = 2 * place[node] + side
        ids = (begin[:, None] + np.arange(2)).ravel()
        depth += 1
    return Tree.of(feature, cut, left, value, gained)
