"""Boosted trees and forests on quantised blocks.

The features of the training rows are binned once to bytes and kept as blocks,
in a bounded number of partitions. A level of all trees that grow together is one job:
every task adds up the gradients of its blocks by node, feature and bin that the
feature has, the sums of all tasks are added node by node, and each node's best split
comes back as one row. Of two siblings only the lighter one is summed; the other is their
parent less it. A node of at most ``FINISH_ROWS`` rows (more in a large table) leaves this loop: its
rows go, keyed by tree and node, to one bounded group that grows the rest of the
tree there.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FEATURES, TARGET
from ..session import durable, path_exists, written
from .trees import BINS, Growth, Tree, best_split, grow, leaf_value

BLOCK_ROWS = 8_192
# Partitions of one block each at most: a partition sends a row for every node of a level.
# Beyond them a core gets two partitions, of no more rows than the last number, in blocks of this many times the rows.
PARTS, LARGE, PART_ROWS = 64, 8, 2_097_152
# Rows of a node that ends in a group; of a large table a group takes a ``PARTS``-th of the rows, up to the second number.
FINISH_ROWS, MOST_FINISH_ROWS = 16_384, 262_144
# The predictions so far are held in executor memory and, after this many rounds, written.
RENEW = 25
# Levels after which the histograms of a level are written: a plan names those of all levels held before, twice each.
PLAN_LEVELS = 3
# A forest with more nodes than this, as far as rows and depth tell, is held in files below its upper nodes.
MOST_NODES = 4_000_000
# Rows, counted once for each tree, that go to the ends of the trees at once; trees of such a forest grow in groups.
END_ROWS = 16_777_216
# A block holds the predictions of as many models as these bytes take; more models are fitted one group after another.
HELD_BYTES = 4_194_304
# Histograms that a task adds up at once; a level with more nodes is summed in parts.
LEVEL_BYTES = 33_554_432
# In large blocks features with few bins are counted together, in one histogram of at most so many bins for all nodes.
JOINT_BINS = 2_048
BLOCK = "block long, codes binary, target binary, days binary, base binary"
ROOTS = ", roots array<struct<tree: int, part: int, sums: binary>>"
NODE = ("feature", "bin", "left", "value", "gain")
PART = "tree int, node int, " + ", ".join(f"{n} binary" for n in NODE)
TREE = "tree int, node int, feature int, cut double, left int, value double, gain double"

TREE_NAMES = [part.split()[0] for part in TREE.split(", ")]
ABOUT = "features array<string>, edges array<array<double>>, base double, scale double"


@cache
def ddl(text: str) -> T.StructType:
    """A schema, parsed once: a fit makes thousands of frames of a few schemas."""
    return T.StructType.fromDDL(text)


@dataclass(frozen=True)
class Draw:
    """Which rows a tree sees: a share of them, or each as often as a bootstrap draws it, before a day if one is given.

    The numbers depend on seed, tree and block alone, so a task that runs again
    draws the same rows.
    """

    seed: int = 42
    share: float = 1.0
    bootstrap: bool = False
    before: int | None = None

    def weights(self, tree: int, block: int, days: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([self.seed, tree, block])
        if self.bootstrap:
            drawn = poisson(rng, len(days)) if len(days) > BLOCK_ROWS else rng.poisson(1.0, len(days)).astype(float)
        else:
            drawn = rng.random(len(days)) < self.share if self.share < 1 else np.ones(len(days), bool)
        return drawn if self.before is None else drawn * (days < self.before)


@cache
def _poisson_cells() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of Poisson numbers (mean 1) up to each; the number of each 65,536th of the shares; the cells with two of them."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
    low, high = (np.searchsorted(shares, (np.arange(65_536) + i) / 65_536, side="right") for i in (0, 1))
    return shares, low.astype(np.uint8), low != high


def poisson(rng: np.random.Generator, count: int) -> np.ndarray:
    """Poisson numbers of mean 1, by table: a fifth of the time that numpy takes, for large blocks."""
    shares, numbers, mixed = _poisson_cells()
    cell = rng.integers(0, 65_536, count, np.uint16)
    drawn = numbers.take(cell)
    # A cell across the border of two numbers is cut finer.
    between = np.flatnonzero(mixed.take(cell))
    drawn[between] = np.searchsorted(shares, (cell[between] + rng.random(len(between))) / 65_536, side="right")
    return drawn


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins, from one aggregate over all rows: at most ``bins`` quantiles."""
    shares = f"array({', '.join(f'{(i + 1) / bins}D' for i in range(bins))})"
    found = rows.agg(
        *[F.expr(f"percentile_approx(cast(`{f}` AS double), {shares}, {40 * bins})").alias(f) for f in features]
    ).first()
    return [np.unique(found[f] if found[f] is not None else [0.0])[:-1] for f in features]


def coded(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Features x rows of bin numbers: the number of edges below each value."""
    return np.stack([np.searchsorted(e, values[:, j], side="left").astype(np.uint8) for j, e in enumerate(edges)])


def is_large(count: int) -> bool:
    """Whether a table of ``count`` rows has more than ``PARTS`` small blocks, and so has large ones."""
    return math.ceil(count / BLOCK_ROWS) > PARTS


def block_rows(count: int) -> int:
    return BLOCK_ROWS * LARGE if is_large(count) else BLOCK_ROWS


def to_blocks(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    edges: Sequence[np.ndarray],
    bases: Sequence[float],
    count: int,
    date: str | None = None,
) -> DataFrame:
    """The rows as durable blocks: bins as bytes, label, day, and for every model the prediction so far."""
    parts, size = max(1, math.ceil(count / BLOCK_ROWS)), block_rows(count)
    if is_large(count):
        parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(count / PART_ROWS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32

        def block(part: np.ndarray) -> pd.DataFrame:
            codes, target, days = coded(part[:, :-2], edges), part[:, -2].copy(), part[:, -1].astype(np.int32)
            held = np.repeat(np.array(bases, float), len(part))
            row = (number, codes.tobytes(), target.tobytes(), days.tobytes(), held.tobytes())
            return pd.DataFrame([row], columns=["block", "codes", "target", "days", "base"])

        parts: list[np.ndarray] = []
        for frame in frames:
            parts.append(frame.to_numpy(float))
            if sum(map(len, parts)) < size:
                continue
            table = np.concatenate(parts)
            full = len(table) // size * size
            for start in range(0, full, size):
                yield block(table[start : start + size])
                number += 1
            parts = [table[full:]]
        rest = np.concatenate(parts) if parts else ()
        if len(rest):
            yield block(rest)

    day = F.unix_date(date) if date else F.lit(0)
    doubles = rows.select(*[F.col(n).cast("double").alias(n) for n in [*features, label]], day.cast("double").alias("_day"))
    return durable(doubles.repartition(parts).mapInPandas(run, BLOCK))


@dataclass
class Growing:
    """A tree while it grows, its nodes as lists.

    Its gradients are those of the predictions of ``model`` in the blocks, to
    which the numbers in ``ahead`` are added one after another. Trees of different
    models grow in the same jobs.
    """

    number: int
    features: np.ndarray
    draw: Draw
    growth: Growth
    key: int = 0
    model: int = 0
    ahead: tuple[float, ...] = ()
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def plan(self) -> Growing:
        """What a task needs of it."""
        return replace(self, depth=[])

    def _parts(self) -> tuple[list, ...]:
        return self.feature, self.bin, self.left, self.value, self.gain

    def tree(self) -> Tree:
        return Tree.of(*self._parts())

    def most(self, count: int) -> float:
        """Rows that it is expected to see of ``count``."""
        return count * (1.0 if self.draw.bootstrap else self.draw.share)

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> int:
        """Split a leaf; the number of its left child."""
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, cut, at, gain
        for value in values:
            for held, new in zip(self._parts(), (-1, 0, 0, value, 0.0)):
                held.append(new)
            self.depth.append(self.depth[node] + 1)
        return at

    def graft(self, node: int, part: Tree) -> None:
        """Put the tree ``part`` in place of a leaf."""
        left = np.where(part.feature >= 0, part.left + len(self.feature) - 1, 0)
        for held, new in zip(self._parts(), (part.feature, part.bin, left, part.value, part.gain)):
            held[node] = new[0].item()
            held += new[1:].tolist()
        self.depth += [0] * (len(part.feature) - 1)


class Block:
    """A block in a task; gradients of squared error, prediction less target, are made when asked for.

    ``held`` is empty where the block has no predictions; they start at 0 then.
    """

    def __init__(self, row: dict, width: int):
        self.number = row["block"]
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(width, -1)
        self.target, self.days = np.frombuffer(row["target"]), np.frombuffer(row["days"], np.int32)
        self.held = np.frombuffer(row["base"]).reshape(-1, len(self.target)) if len(row["base"]) else np.empty((0, len(self.target)))
        self.joint: dict[tuple[int, ...], np.ndarray] = {}
        self.gradients: dict[int, np.ndarray] = {}

    def joined(self, group: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
        """One code for the bins of all features of a group, the last feature's changing fastest."""
        if len(group) == 1:
            return self.codes[group[0]]
        if tuple(group) not in self.joint:
            code = self.codes[group[0]].astype(np.int32)
            for f in group[1:]:
                code = code * np.int32(sizes[f]) + self.codes[f]
            self.joint[tuple(group)] = code
        return self.joint[tuple(group)]

    def sample(self, growing: Growing) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and weight of every row for one tree."""
        if growing.model not in self.gradients:
            held = reduce(np.add, growing.ahead, self.held[growing.model] if len(self.held) else 0.0)
            self.gradients[growing.model] = held - self.target
        return self.gradients[growing.model], growing.draw.weights(growing.key, self.number, self.days)

    def by_node(self, growing: Growing, tree: Tree, nodes: Sequence[int]) -> tuple[np.ndarray, ...]:
        """Rows that the tree sees in these leaves: leaf by leaf in their order, with the leaf's place in ``nodes``, gradient and weight."""
        gradient, weight = self.sample(growing)
        parts = tree.parted(self.codes, np.flatnonzero(weight != 0), nodes)
        if len(parts) == 1:
            rows, at = parts[0], np.zeros(len(parts[0]), np.int64)
        else:
            rows, at = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        return rows, at, gradient.take(rows), weight.take(rows).astype(float)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the batches; byte columns are views of them."""
    for batch in batches:
        columns = [(n, c, pa.types.is_binary(c.type)) for n, c in zip(batch.schema.names, batch.columns)]
        for i in range(batch.num_rows):
            yield {n: c[i].as_buffer() if view else c[i].as_py() for n, c, view in columns}


def joint_features(sizes: Sequence[int], features: Sequence[int], most: int) -> list[list[int]]:
    """The features in groups whose bins, multiplied, are at most ``most``; a feature with more is alone."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(features, key=lambda f: -sizes[f]):
        fits = next((i for i, (bins, _) in enumerate(groups) if bins * sizes[f] <= most), None)
        if fits is None:
            groups.append((sizes[f], [f]))
        else:
            bins, held = groups[fits]
            groups[fits] = bins * sizes[f], [*held, f]
    return [held for _, held in groups]


class Histograms:
    """Sums of gradients and weights of a tree's nodes by feature and bin, block by block.

    Features of a group are counted together, by all their bins, and told
    apart at the end: half of the work and less. That changes the order of the sums,
    so blocks of few rows have groups of one feature.
    """

    def __init__(self, sizes: Sequence[int], features: Sequence[int], nodes: int, joint: bool):
        self.sizes, self.features, self.nodes = sizes, [int(f) for f in features], nodes
        most = JOINT_BINS // nodes if joint else 0
        self.groups = joint_features(sizes, self.features, most)
        self.bins = [math.prod(sizes[f] for f in group) for group in self.groups]
        self.sums = [np.zeros((2, nodes * bins)) for bins in self.bins]

    def add(self, block: Block, rows: np.ndarray, at: np.ndarray, g: np.ndarray, w: np.ndarray | None) -> None:
        """Rows of a block, the place of each one's node, its gradient, and its weight where that is not 1."""
        for sums, group, bins in zip(self.sums, self.groups, self.bins):
            key = block.joined(group, self.sizes).take(rows)
            if self.nodes > 1:
                key = at * bins + key
            sums[0] += np.bincount(key, g, sums.shape[1])
            sums[1] += np.bincount(key, w, sums.shape[1])

    def of_features(self) -> np.ndarray:
        """Nodes x (gradients, weights) x bins of the first feature, of the second and so on."""
        found = {}
        for sums, group in zip(self.sums, self.groups):
            table = sums.reshape(2, self.nodes, *(self.sizes[f] for f in group))
            for i, f in enumerate(group):
                found[f] = table.sum(axis=tuple(2 + j for j in range(len(group)) if j != i))
        return np.concatenate([found[f] for f in self.features], axis=2).swapaxes(0, 1)


def _add_nodes(
    total: dict[int, Histograms], block: Block, sizes: Sequence[int], trees: Sequence[tuple[Growing, Tree, Sequence[int]]]
) -> None:
    """Add a block's rows to the histograms of these nodes of each tree, by tree in ``total``."""
    for plan, tree, nodes in trees:
        rows, at, g, w = block.by_node(plan, tree, nodes)
        if plan.number not in total:
            total[plan.number] = Histograms(sizes, plan.features, len(nodes), len(block.target) > BLOCK_ROWS)
        if plan.draw.bootstrap:
            total[plan.number].add(block, rows, at, w * g, w)
        else:
            total[plan.number].add(block, rows, at, g, None)


SUMS = "tree int, parent int, node int, part int, sums binary"
FOUND = "tree int, node int, feature int, bin int, gain double, gl double, hl double, g double, h double, sums binary"


def _summed(blocks: DataFrame, sizes: Sequence[int], growing: Sequence[Growing], small: dict) -> DataFrame:
    """Histograms of the nodes in ``small`` ((tree, node) -> parent), one row for each node and task.

    ``sizes`` are the bins of each feature. A node's sums of gradients, then of
    weights, are those of the bins of its first feature, of its second and so on.
    """
    wanted = {g.number: sorted(n for t, n in small if t == g.number) for g in growing}
    trees = [(g.plan(), g.tree(), wanted[g.number]) for g in growing if wanted[g.number]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Histograms] = {}
        for row in _rows(batches):
            block = Block(row, len(sizes))
            _add_nodes(total, block, sizes, trees)
        part = TaskContext.get().partitionId()
        for number in list(total):
            nodes, sums = wanted[number], total.pop(number).of_features()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * len(nodes), pa.int32()),
                    pa.array([small[number, n] for n in nodes], pa.int32()),
                    pa.array(nodes, pa.int32()),
                    pa.array([part] * len(nodes), pa.int32()),
                    pa.array([s.tobytes() for s in sums], pa.binary()),
                ],
                names=["tree", "parent", "node", "part", "sums"],
            )

    return blocks.mapInArrow(run, ddl(SUMS))


def _in_parts(blocks: DataFrame, sizes: Sequence[int], growing: Sequence[Growing], small: dict) -> DataFrame:
    """``_summed``, by as many passes over the blocks as keep a task's histograms within ``LEVEL_BYTES``."""
    bins = {g.number: 16 * max(sum(sizes[f] for f in g.features), 1) for g in growing}
    parts, free = [], 0
    for tree, node in sorted(small):
        size = bins[tree]
        if size > free:
            parts.append({})
            free = max(LEVEL_BYTES, size)
        parts[-1][tree, node] = small[tree, node]
        free -= size
    return reduce(DataFrame.unionByName, [_summed(blocks, sizes, growing, part) for part in parts])


def _splits(
    sums: DataFrame, parents: DataFrame | None, pairs: dict, growing: Sequence[Growing], sizes: Sequence[int], groups: int
) -> DataFrame:
    """Best split of every summed node and of its sibling, with their histograms.

    ``pairs`` is (tree, parent) -> sibling of the summed node, or None for a root.
    """
    growths, features = {g.number: g.growth for g in growing}, {g.number: g.features for g in growing}
    rows = sums
    if parents is not None:
        wanted = F.concat_ws("/", "tree", "node").isin([f"{t}/{p}" for t, p in pairs])
        held = parents.where(wanted).select(
            "tree", F.col("node").alias("parent"), F.lit(-1).alias("node"), F.lit(0).alias("part"), "sums"
        )
        rows = sums.unionByName(held)

    def result(tree: int, node: int, array: np.ndarray) -> dict:
        # Bins that a feature does not have hold nothing, so no split falls there.
        bins = [sizes[f] for f in features[tree]]
        whole = np.zeros((2, len(bins), max(bins)))
        whole[:, np.arange(max(bins)) < np.array(bins)[:, None]] = array
        feature, cut, gain, gl, hl = best_split(whole[0], whole[1], growths[tree])
        return {
            "tree": tree, "node": node, "feature": feature, "bin": cut, "gain": gain, "gl": gl, "hl": hl,
            "g": float(whole[0, 0].sum()), "h": float(whole[1, 0].sum()), "sums": array.tobytes(),
        }

    schema = pa.schema(
        [("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32())]
        + [(n, pa.float64()) for n in ("gain", "gl", "hl", "g", "h")] + [("sums", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, light, whole, node = None, None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if light is None or key not in pairs:
                return
            out = [result(key[0], node, light)]
            if pairs[key] is not None:
                out.append(result(key[0], pairs[key], whole - light))
            yield pa.RecordBatch.from_pylist(out, schema)

        for row in _rows(batches):
            if (row["tree"], row["parent"]) != key:
                yield from close()
                key, light, whole = (row["tree"], row["parent"]), None, None
            array = np.frombuffer(row["sums"]).reshape(2, -1)
            if row["node"] < 0:
                whole = array
            else:
                node, light = row["node"], array if light is None else light + array
        yield from close()

    dealt = rows.repartition(groups, "tree", "parent").sortWithinPartitions("tree", "parent", "node", "part")
    return dealt.mapInArrow(run, ddl(FOUND))


def _finished(blocks: DataFrame, width: int, growing: Sequence[Growing], ends: dict) -> DataFrame:
    """The rest of the trees below the nodes in ``ends`` ((tree, node) -> depth), each grown in one group of bounded rows.

    One row for each of these nodes, with the arrays of its tree as bytes.
    """
    wanted = {g.number: sorted(n for t, n in ends if t == g.number) for g in growing}
    trees = [(g.plan(), g.tree(), wanted[g.number]) for g in growing if wanted[g.number]]
    features, growths = {g.number: g.features for g in growing}, {g.number: g.growth for g in growing}

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "node", "block", "codes", "held"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for row in _rows(batches):
            block = Block(row, width)
            for plan, tree, nodes in trees:
                rows, at, g, w = block.by_node(plan, tree, nodes)
                codes, held, out = block.codes[:, rows], np.stack([g * w, w]), []
                places = np.searchsorted(at, np.arange(len(nodes) + 1)).tolist()
                for node, start, end in zip(nodes, places, places[1:]):
                    if start < end:
                        parts = codes[:, start:end].tobytes(), held[:, start:end].tobytes()
                        out.append((plan.number, node, block.number, *parts))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            codes = np.concatenate([np.frombuffer(c, np.uint8).reshape(width, -1) for c, _ in parts], axis=1)
            gradient, weight = np.concatenate([np.frombuffer(h).reshape(2, -1) for _, h in parts], axis=1)
            growth = growths[key[0]]
            left = None if growth.depth is None else growth.depth - ends[key]
            tree = grow(codes, gradient, weight, replace(growth, depth=left), features[key[0]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()) for k in key] + [pa.array([a.tobytes()]) for a in tree.parts()],
                names=["tree", "node", *NODE],
            )

        for row in _rows(batches):
            if (row["tree"], row["node"]) != key:
                yield from close()
                key, parts = (row["tree"], row["node"]), []
            parts.append((row["codes"], row["held"]))
        yield from close()

    rows = blocks.mapInArrow(collect, ddl("tree int, node int, block long, codes binary, held binary"))
    groups = min(len(ends), 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(groups, "tree", "node").sortWithinPartitions("tree", "node", "block")
    return dealt.mapInArrow(finish, ddl(PART))


def group_rows(count: int, least: int) -> int:
    """Rows of a node that one group finishes, in a table of ``count`` rows: bounded, and enough groups for many tasks."""
    return max(least, min(MOST_FINISH_ROWS, count // PARTS))


def grow_together(
    blocks: DataFrame,
    count: int,
    sizes: Sequence[int],
    growing: Sequence[Growing],
    finish_rows: int = FINISH_ROWS,
    finished: list[DataFrame] | None = None,
) -> list[Tree]:
    """Grow the trees level by level, all small nodes at the end at once; ``sizes`` are the bins of each feature.

    With a list ``finished`` the trees end at these nodes, and what is below
    them is appended as a frame (``PART``) that is not evaluated here.
    """
    by_number = {g.number: g for g in growing}
    growths = {g.number: g.growth for g in growing}
    finish_rows = group_rows(count, finish_rows)
    ends: dict[tuple[int, int], int] = {}
    # Node to sum -> parent, and parent -> the sibling that follows by subtraction.
    small: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], int | None] = {}
    for tree in growing:
        if tree.most(count) <= finish_rows:
            ends[tree.number, 0] = 0
        else:
            small[tree.number, 0], pairs[tree.number, -1] = -1, None
    before, parents, level = None, None, 0
    groups = max(1, min(len(growing) * 4, blocks.sparkSession.sparkContext.defaultParallelism))
    while small:
        if not level and "roots" in blocks.columns:
            sums = blocks.select(F.inline("roots")).selectExpr("tree", "-1 AS parent", "0 AS node", "part", "sums")
        else:
            sums = _in_parts(blocks, sizes, growing, small)
        level += 1
        found = _splits(sums, parents, pairs, growing, sizes, groups)
        found = durable(found) if level % PLAN_LEVELS == 0 else found.persist()
        small, pairs = {}, {}
        for row in found.drop("sums").collect():
            tree, node, l2 = by_number[row["tree"]], row["node"], growths[row["tree"]].l2
            if node == 0:
                tree.value[0] = float(leaf_value(row["g"], row["h"], l2))
            # A node that ends in a group was summed for its sibling's sake alone.
            if row["feature"] < 0 or (row["tree"], node) in ends:
                continue
            gr, hr = row["g"] - row["gl"], row["h"] - row["hl"]
            values = (float(leaf_value(row["gl"], row["hl"], l2)), float(leaf_value(gr, hr, l2)))
            left = tree.split(node, int(tree.features[row["feature"]]), row["bin"], row["gain"], values)
            depth = tree.depth[left]
            if tree.growth.depth is not None and depth >= tree.growth.depth:
                continue
            large = False
            for child, weight in ((left, row["hl"]), (left + 1, hr)):
                if weight <= finish_rows:
                    ends[tree.number, child] = depth
                else:
                    large = True
            if large:
                light = min((row["hl"], left), (hr, left + 1))[1]
                small[tree.number, light], pairs[tree.number, node] = node, 2 * left + 1 - light
        if before is not None:
            before.unpersist()
        before, parents = parents, found
    for held in (before, parents):
        if held is not None:
            held.unpersist()
    if ends and finished is not None:
        finished.append(_finished(blocks, len(sizes), growing, ends))
    elif ends:
        for row in _finished(blocks, len(sizes), growing, ends).toArrow().to_pylist():
            by_number[row["tree"]].graft(row["node"], Tree.of(*(row[n] for n in NODE)))
    return [g.tree() for g in growing]


def _renewed(
    blocks: DataFrame,
    sizes: Sequence[int],
    new: Sequence[tuple[float, Sequence[Tree]]],
    write: bool,
    growing: Sequence[Growing] = (),
    start: Sequence[float] = (),
) -> DataFrame:
    """The blocks with the predictions of these trees (rate and trees of each model) added, written or held in memory.

    Blocks without predictions begin with those in ``start``. The last block of a task comes with the histograms of the roots of the trees that grow next.
    """
    roots, root = [g.plan() for g in growing], Tree.of([-1], [0], [0], [0.0], [0.0])
    names = ["block", "codes", "target", "days"]
    kind = pa.list_(pa.struct([("tree", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Histograms] = {}
        before, part = None, TaskContext.get().partitionId()

        def closed(kept: list[pa.Array], held: bytes, last: bool) -> pa.RecordBatch:
            sums = [{"tree": n, "part": part, "sums": t.of_features()[0].tobytes()} for n, t in total.items()] if last else None
            return pa.RecordBatch.from_arrays([*kept, pa.array([held], pa.binary()), pa.array([sums], kind)], names=[*names, "base", "roots"])

        for batch in batches:
            # A block at a time: a batch may hold many.
            for i, row in enumerate(_rows([batch])):
                if before is not None:
                    yield closed(*before, False)
                block = Block(row, len(sizes))
                block.held = block.held.copy() if len(block.held) else np.repeat(np.array(start, float)[:, None], len(block.target), 1)
                for so_far, (rate, trees) in zip(block.held, new):
                    for tree in trees:
                        so_far += rate * tree.value[tree.leaves(block.codes)]
                _add_nodes(total, block, sizes, [(plan, root, [0]) for plan in roots])
                before = [batch.column(n).slice(i, 1) for n in names], block.held.tobytes()
        if before is not None:
            yield closed(*before, True)

    rows = blocks.mapInArrow(run, ddl(BLOCK + ROOTS))
    return durable(rows) if write else rows.persist(StorageLevel.MEMORY_AND_DISK)


def bin_counts(edges: Sequence[np.ndarray]) -> list[int]:
    """Bins of each feature."""
    return [len(e) + 1 for e in edges]


def _gains(tree: Tree, width: int) -> np.ndarray:
    """Loss that the splits on each feature take away."""
    inner = tree.feature >= 0
    return np.bincount(tree.feature[inner], tree.gain[inner], width)


def most_nodes(count: int, depth: int | None) -> int:
    """Nodes that a tree on ``count`` rows has at most."""
    return 2 * count if depth is None or depth > 40 else min(2 * count, 2 ** (depth + 1))


@dataclass(frozen=True)
class TreeModel:
    """A fitted ensemble: as large as its trees, which the driver holds. ``scale`` multiplies every tree's value; rows go left up to the cut."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    edges: tuple[np.ndarray, ...]
    base: float = 0.0
    scale: float = 1.0

    def transform(self, rows: DataFrame, column: str = "log_prediction") -> DataFrame:
        """``rows`` with the prediction; the trees are sent to the executors once."""
        return rows.withColumn(column, self._column(rows.sparkSession, [len(self.trees)]).getItem(0))

    def staged(self, rows: DataFrame, counts: Sequence[int], column: str = "staged") -> DataFrame:
        """``rows`` with an array: the predictions of the first trees, for each of the ascending ``counts``."""
        return rows.withColumn(column, self._column(rows.sparkSession, list(counts)))

    def _column(self, spark: SparkSession, counts: list[int]) -> Column:
        sent = spark.sparkContext.broadcast((self.trees, self.edges, self.base, self.scale))

        @F.pandas_udf("array<double>")
        def predict(values: pd.DataFrame) -> pd.Series:
            trees, edges, base, scale = sent.value
            codes = coded(values.to_numpy(float), edges)
            total, out = np.full(codes.shape[1], base), np.empty((codes.shape[1], len(counts)))
            for i, (a, b) in enumerate(zip([0, *counts], counts)):
                for tree in trees[a:b]:
                    total += scale * tree.value[tree.leaves(codes)]
                out[:, i] = total
            return pd.Series(list(out))

        return predict(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table, one row for each node; ``cut`` is in units of the feature."""
        names = [n for n in TREE_NAMES if n not in ("tree", "node", "cut")]
        parts = []
        for number, tree in enumerate(self.trees):
            cut = [self.edges[f][b] if f >= 0 else np.nan for f, b in zip(tree.feature, tree.bin)]
            held = {n: getattr(tree, n) for n in names}
            parts.append(pd.DataFrame({"tree": number, "node": np.arange(len(cut)), "cut": cut, **held}))
        table = pd.concat(parts).astype({n: np.int32 for n in ("tree", "node", "feature", "left")})
        return spark.createDataFrame(table[TREE_NAMES], TREE)

    def importances(self) -> np.ndarray:
        """Each feature's share of the loss that its splits take away, the mean over the trees."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            gains = _gains(tree, len(self.features))
            total += gains / (gains.sum() or 1.0)
        return total / (total.sum() or 1.0)

    def save(self, path: str, spark: SparkSession) -> None:
        """Write the trees as a table, and the rest as one row beside it."""
        self.nodes(spark).write.parquet(f"{path}/nodes")
        about = (list(self.features), [e.tolist() for e in self.edges], self.base, self.scale)
        spark.createDataFrame([about], ABOUT).coalesce(1).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> TreeModel:
        about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
        edges = tuple(np.array(e) for e in about["edges"])
        table = spark.read.schema(TREE).parquet(f"{path}/nodes").orderBy("tree", "node").toArrow().to_pandas()
        trees = []
        for _, part in table.groupby("tree"):
            inner = part["feature"].to_numpy() >= 0
            places = np.zeros(len(part), np.int16)
            places[inner] = [np.searchsorted(edges[f], c) for f, c in zip(part["feature"][inner], part["cut"][inner])]
            trees.append(Tree.of(part["feature"], places, part["left"], part["value"], part["gain"]))
        fitted = tuple(about["features"]), tuple(trees), edges, about["base"], about["scale"]
        if path_exists(spark, f"{path}/parts"):
            return StoredForest(*fitted, spark.read.schema(PART).parquet(f"{path}/parts"))
        return cls(*fitted)


@dataclass(frozen=True)
class StoredForest(TreeModel):
    """A forest whose lower nodes stay in files: ``trees`` end where a row of ``parts`` (``PART``) goes on.

    The driver holds the upper nodes alone. Rows go to the parts that they fall
    into, so a prediction shuffles each row's bins once for each tree, and no task
    needs more than one part. It writes its rows first, so it is not for streams.
    """

    parts: DataFrame | None = None

    def transform(self, rows: DataFrame, column: str = "log_prediction") -> DataFrame:
        kept = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
        trees, edges, features, scale = self.trees, self.edges, self.features, self.scale
        base, width, groups = self.base, len(self.features), rows.sparkSession.sparkContext.defaultParallelism * 4
        sent = rows.sparkSession.sparkContext.broadcast((trees, edges))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, edges = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
                codes, first = coded(table, edges), batch.column("_row")[0].as_py()
                for number, tree in enumerate(trees):
                    ends = np.flatnonzero(tree.feature < 0).tolist()
                    out = [
                        (first, number, n, at.astype(np.int32).tobytes(), codes[:, at].tobytes(), float(tree.value[n]))
                        for n, at in zip(ends, tree.parted(codes, np.arange(len(table)), ends))
                        if len(at)
                    ]
                    kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64()
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, part = None, None
            for row in _rows(batches):
                if (row["tree"], row["node"]) != key:
                    key, part = (row["tree"], row["node"]), None
                if row["first"] < 0:
                    part = Tree.of(*(bytes(row[n]) for n in NODE))
                    continue
                codes = np.frombuffer(row["codes"], np.uint8).reshape(width, -1)
                # A leaf of the upper nodes has no part.
                values = np.full(codes.shape[1], row["leaf"]) if part is None else part.value[part.leaves(codes)]
                held = [row["first"]], [row["tree"]], [row["node"]], [bytes(row["at"])], [values.tobytes()]
                kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(held, kinds)], names=["first", "tree", "node", "at", "found"]
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, parts, tree, total = None, [], None, None

            def tree_done() -> np.ndarray:
                # Every row is in each tree once, so the first tree tells how many there are.
                at = np.concatenate([np.frombuffer(a, np.int32) for a, _ in parts])
                held = np.full(len(at), base) if total is None else total
                held[at] += scale * np.concatenate([np.frombuffer(v) for _, v in parts])
                return held

            def done() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(total))), pa.array(total)], names=["_row", column])

            for row in _rows(batches):
                if parts and (row["first"], row["tree"]) != (first, tree):
                    total, parts = tree_done(), []
                    if row["first"] != first:
                        yield done()
                        total = None
                first, tree = row["first"], row["tree"]
                parts.append((row["at"], row["found"]))
            if parts:
                total = tree_done()
                yield done()

        names = ["first", "tree", "node", "at", "codes", "leaf"]
        asked = kept.select("_row", *[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(
            ask, ddl("first long, tree int, node int, at binary, codes binary, leaf double")
        )
        lower = self.parts.withColumn("first", F.lit(-1).cast("long"))
        both = asked.unionByName(lower, allowMissingColumns=True).repartition(groups, "tree", "node")
        found = both.sortWithinPartitions("tree", "node", "first").mapInArrow(
            answer, ddl("first long, tree int, node int, at binary, found binary")
        )
        dealt = found.repartition(groups, "first").sortWithinPartitions("first", "tree", "node")
        predicted = dealt.mapInArrow(add, ddl(f"_row long, `{column}` double"))
        return kept.join(predicted, "_row").select(*rows.columns, column)

    def staged(self, rows: DataFrame, counts: Sequence[int], column: str = "staged") -> DataFrame:
        raise NotImplementedError("a forest in files has no stages")

    def importances(self) -> np.ndarray:
        width = len(self.features)
        gains = np.stack([_gains(tree, width) for tree in self.trees])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                found = _gains(Tree.of(*(bytes(row[n]) for n in NODE)), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * width, pa.int32()), pa.array(np.arange(width, dtype=np.int32)), pa.array(found)],
                    names=["tree", "feature", "gain"],
                )

        below = self.parts.mapInArrow(run, ddl("tree int, feature int, gain double")).groupBy("tree", "feature").sum("gain")
        for tree, feature, gain in below.collect():
            gains[tree, feature] += gain
        sums = gains.sum(axis=1, keepdims=True)
        total = (gains / np.where(sums == 0, 1.0, sums)).sum(axis=0)
        return total / (total.sum() or 1.0)

    def save(self, path: str, spark: SparkSession) -> None:
        """As the base does, with the parts beside; ``nodes`` has the upper nodes alone."""
        self.parts.write.parquet(f"{path}/parts")
        super().save(path, spark)


@dataclass(frozen=True)
class BlockBoosting:
    """Boosting for squared error: a draw of rows and of columns for each tree, an L2 term in every leaf.

    ``base`` is the prediction before the first tree.
    """

    rounds: int
    rate: float
    depth: int
    row_share: float = 1.0
    column_share: float = 1.0
    least_weight: float = 1.0
    l2: float = 1.0
    base: float = 0.5
    bins: int = BINS
    seed: int = 42
    features: tuple[str, ...] = tuple(FEATURES)
    label: str = TARGET
    finish_rows: int = FINISH_ROWS

    def columns(self, tree: int) -> np.ndarray:
        width = len(self.features)
        drawn = np.random.default_rng([self.seed, tree]).choice(width, max(1, int(self.column_share * width)), replace=False)
        return np.sort(drawn)

    def fit(self, rows: DataFrame) -> TreeModel:
        return fit_in_step(rows, [self])[0]


def fit_in_step(rows: DataFrame, models: Sequence[BlockBoosting], before: Sequence[dt.date | None] = (), date: str = "date") -> list[TreeModel]:
    """Fit several boosted models at once: in every round the next trees of all of them grow in the same jobs.

    The models share features, label and bins. A model with a day in
    ``before`` is fitted on the rows before that day; the bins are those of
    all rows.
    """
    first = models[0]
    if any((m.features, m.label, m.bins) != (first.features, first.label, first.bins) for m in models):
        raise ValueError("models fitted in step need the same features, label and bins")
    limits = [None if d is None else (d - dt.date(1970, 1, 1)).days for d in before] or [None] * len(models)
    count, edges = rows.count(), bin_edges(rows, first.features, first.bins)
    day = date if any(d is not None for d in limits) else None
    most = max(1, HELD_BYTES // (8 * block_rows(count)))
    if len(models) <= most:
        blocks = to_blocks(rows, first.features, first.label, edges, [m.base for m in models], count, day)
        return _in_step(blocks, count, edges, models, limits)
    # Models of like rounds share a group, so that no group waits for a few of its models.
    order = sorted(range(len(models)), key=lambda i: models[i].rounds)
    blocks = to_blocks(rows, first.features, first.label, edges, [], count, day)
    fitted: dict[int, TreeModel] = {}
    for group in (order[i : i + most] for i in range(0, len(order), most)):
        some = [models[i] for i in group]
        fitted |= zip(group, _in_step(blocks, count, edges, some, [limits[i] for i in group], False))
    blocks.unpersist()
    return [fitted[i] for i in range(len(models))]


def _in_step(
    blocks: DataFrame,
    count: int,
    edges: Sequence[np.ndarray],
    models: Sequence[BlockBoosting],
    limits: Sequence[int | None],
    begun: bool = True,
) -> list[TreeModel]:
    """Fit models, each on the rows before its day; ``begun`` tells whether the blocks hold their first predictions."""
    trees: list[list[Tree]] = [[] for _ in models]
    sizes, finish_rows, last = bin_counts(edges), min(m.finish_rows for m in models), None
    done, start = 0, [m.base for m in models]
    for number in range(max(m.rounds for m in models)):
        since = [t[done:number] for t in trees]
        # A tree without a split adds one number to all rows: they need not be written anew for it.
        renew = number and (number % RENEW == 0 or any(len(tree.feature) > 1 for some in since for tree in some))
        ahead = [() if renew else tuple(m.rate * float(tree.value[0]) for tree in some) for m, some in zip(models, since)]
        if not begun and not renew:
            ahead = [(base, *numbers) for base, numbers in zip(start, ahead)]
        growing = [
            Growing(i, m.columns(number), Draw(m.seed, m.row_share, before=limits[i]), Growth(m.depth, m.l2, m.least_weight), number, i, ahead[i])
            for i, m in enumerate(models)
            if number < m.rounds
        ]
        if renew:
            new = [(m.rate, some) for m, some in zip(models, since)]
            large = [g for g in growing if g.most(count) > group_rows(count, finish_rows)]
            last, blocks = blocks, _renewed(blocks, sizes, new, number % RENEW == 0, large, () if begun else start)
            done, begun = number, True
        rows = blocks if renew else blocks.drop("roots")
        for tree, new in zip(growing, grow_together(rows, count, sizes, growing, finish_rows)):
            trees[tree.model].append(new)
        # The blocks of this round are made by now and need those of the last one no more.
        if last is not None:
            last.unpersist()
    blocks.unpersist()
    return [TreeModel(m.features, tuple(t), tuple(edges), m.base, m.rate) for m, t in zip(models, trees)]


@dataclass(frozen=True)
class BlockForest:
    """A forest whose trees grow together, each on a bootstrap of the rows; ``depth`` None sets no limit."""

    trees: int
    depth: int | None = None
    bins: int = BINS
    seed: int = 42
    features: tuple[str, ...] = tuple(FEATURES)
    label: str = TARGET
    finish_rows: int = FINISH_ROWS

    def fit(self, rows: DataFrame, edges: Sequence[np.ndarray] | None = None) -> TreeModel:
        """``edges`` are the bins of each feature, where they are known already."""
        count, edges = rows.count(), bin_edges(rows, self.features, self.bins) if edges is None else edges
        return self.fit_blocks(to_blocks(rows, self.features, self.label, edges, [0.0], count), count, edges)

    def fit_blocks(self, blocks: DataFrame, count: int, edges: Sequence[np.ndarray]) -> TreeModel:
        """``fit`` on blocks of ``count`` rows."""
        draw, growth = Draw(self.seed, bootstrap=True), Growth(self.depth)
        growing = [Growing(t, np.arange(len(self.features)), draw, growth, t) for t in range(self.trees)]
        about, sizes = (tuple(edges), 0.0, 1.0 / self.trees), bin_counts(edges)
        if self.trees * most_nodes(count, self.depth) <= MOST_NODES:
            return TreeModel(self.features, tuple(grow_together(blocks, count, sizes, growing, self.finish_rows)), *about)
        trees, parts, some = [], [], max(1, END_ROWS // max(count, 1))
        for start in range(0, self.trees, some):
            finished: list[DataFrame] = []
            trees += grow_together(blocks, count, sizes, growing[start : start + some], self.finish_rows, finished)
            parts += [written(part, "subtrees") for part in finished]
        empty = blocks.sparkSession.createDataFrame([], ddl(PART))
        return StoredForest(self.features, tuple(trees), *about, reduce(DataFrame.unionByName, parts or [empty]))
