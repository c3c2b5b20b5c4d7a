"""Near-duplicate documents by an inverted join of MinHash coordinates.

1. Every text becomes its set of word shingles and a MinHash signature. Texts
   with equal sets are one node from here on, so copies are never paired.
2. Nodes are posted under each (coordinate, value) pair. A pair of nodes that
   agrees in enough coordinates shares one of the rarest of each, so only that
   prefix of a node's postings is merged; the longer lists are skipped.
3. In every list the nodes are counted against its first node; the best match
   of each node is confirmed on full sets. That joins most of a group of copies
   with as many comparisons as nodes.
4. Lists that still hold unlinked nodes are compared in full: their nodes form
   clusters, dealt in blocks of bounded size, and each pair of blocks is one
   task that counts common shingles exactly. Pairs of blocks inside one
   component are left out. Only links leave a task, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from ..session import written
from .components import components
from .text import slices

COORDINATES = 64
# Of 64 coordinates, texts with a similarity of 0.8 agree in 51 on average, and
# in fewer than 36 once in about 236,000 pairs (binomial sum).
MATCHES = 36
BLOCK_NODES = 400
BLOCK_SHINGLES = 300_000
SEED = 8
MEMO = 300_000

_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; of the whole text if it has fewer words.

    Words are runs of characters other than space and ``\\x09-\\x0D``, with A-Z
    in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _words
    if len(known) > MEMO:
        known.clear()
    for word in set(words):
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total = _mixed(total * _STEP + hashed[i : i + count])
    return np.unique(total)


def forget() -> None:
    """Drop the hashes of words, so that a worker does not hold them between tasks."""
    _words.clear()


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the set's hashes, 32 bits of it."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingle_set), 2048):
        part = (shingle_set[start : start + 2048, None] ^ _FLIP) * _TIMES
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n, mark, sig)``: size, digest and signature of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches, 1000):
                marks, sizes, sigs = [], [], []
                for text in batch.column("text").to_pylist():
                    found = shingles(text, width)
                    sizes.append(len(found))
                    marks.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sigs.append(signature(found).tolist() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(marks, pa.binary()),
                        pa.array(sigs, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n", "mark", "sig"],
                )
        finally:
            forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, mark binary, sig array<int>")


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``(node, set)`` of the nodes, made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches, 200):
                sets = [shingles(text, width).view(np.int64) for text in batch.column("text").to_pylist()]
                lengths = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.ListArray.from_arrays(pa.array(lengths), flat)], names=["node", "set"]
                )
        finally:
            forget()

    named = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    return named.join(nodes.select("node").distinct(), "node").mapInArrow(run, "node long, set array<long>")


def _prefixes(nodes: DataFrame, matches: int) -> DataFrame:
    """``(node, token)``: the coordinate values that are enough to find all partners of a node.

    Two nodes that agree in ``matches`` of the coordinates share one among the
    ``COORDINATES - matches + 1`` rarest of each. Values that no other node has
    are the rarest; they fill the prefix without being listed.
    """
    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    posted = nodes.select("node", F.posexplode("sig").alias("at", "value")).select("node", token.alias("token"))
    counts = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(counts, "token")
    ranked = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))
    room = F.size("held") - F.lit(matches - 1)  # prefix length less the values nobody shares
    return ranked.where(room > 0).select("node", F.explode(F.slice("held", F.lit(1), room)).alias("t")).select(
        "node", F.col("t.token").alias("token")
    )


def _similar(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return common * 100 >= (n_a + n_b - common) * percent


def _star_links(lists: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Confirmed links of nodes with the first node of one of their lists: the best one."""
    pairs = lists.where("node <> lead").select("node", "lead").distinct()
    sig = nodes.select("node", "sig")
    both = pairs.join(sig, "node").join(sig.select(F.col("node").alias("lead"), F.col("sig").alias("other")), "lead")
    agree = F.aggregate(F.zip_with("sig", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    best = (
        both.select("node", "lead", agree.alias("agree"))
        .where(F.col("agree") >= matches)
        .groupBy("node")
        .agg(F.max(F.struct("agree", (-F.col("lead")).alias("minus"))).alias("best"))
        .select("node", (-F.col("best.minus")).alias("lead"))
    )
    full = best.join(sets, "node").join(sets.select(F.col("node").alias("lead"), F.col("set").alias("other")), "lead")
    common = F.size(F.array_intersect("set", "other"))
    return full.where(_similar(common, F.size("set"), F.size("other"), percent)).select(
        F.col("node").alias("a"), F.col("lead").alias("b")
    )


def common_counts(values: np.ndarray, owner: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of ``rows`` with those of ``columns``."""
    distinct, spot, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[spot]
    owner, column = owner[keep], place[spot[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width, n = np.zeros((len(rows), len(columns)), np.float32), 4096, int(shared.sum())
    for start in range(0, n, width):
        a, b = np.searchsorted(column, (start, start + width))
        held = np.zeros((int(max(rows.max(), columns.max())) + 1, min(width, n - start)), np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        total += held[rows] @ held[columns].T
    return total


def _cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between components of one cluster: every pair of nodes of different components is counted.

    ``members`` is (cluster, component, node, n, set).
    """

    def parts(nodes: Column, total: Column) -> Column:
        return F.ceil(F.greatest(nodes / BLOCK_NODES, total / BLOCK_SHINGLES)).cast("long")

    narrow = members.drop("set")
    sized = narrow.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sized = sized.withColumn("own", parts(F.col("c"), F.col("s")))
    pooled = sized.where("own = 1").groupBy("cluster").agg(parts(F.sum("c"), F.sum("s")).alias("pool"))
    plan = sized.join(pooled, "cluster", "left").select("cluster", "component", "own", "pool")
    # A component larger than a block has blocks of its own; the others share the pool's.
    alone = F.col("own") > 1
    block = F.when(alone, F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("component"), F.col("pool")))
    holder = F.when(alone, F.col("component"))
    placed = written(
        salted_join(members, plan, ["cluster", "component"], ["node"], salts=4).select(
            "cluster", "component", "node", "set", holder.alias("holder"), block.alias("block")
        ),
        "cluster-members",
    )
    name = F.struct(F.coalesce("holder", F.lit(-1)).alias("h"), F.col("holder").isNull().alias("p"), "block")
    named = placed.withColumn("name", name)
    blocks = named.select("cluster", "name").distinct()
    pairs = blocks.join(blocks.select("cluster", F.col("name").alias("other")), "cluster").where(
        (F.col("name") <= F.col("other"))
        & ~((F.col("name.h") == F.col("other.h")) & ~F.col("name.p") & ~F.col("other.p"))
    )
    to = pairs.select("cluster", F.col("name").alias("first"), F.col("other").alias("second"))
    left = named.join(to.withColumn("name", F.col("first")), ["cluster", "name"]).withColumn("side", F.lit(0))
    right = named.join(to.where("first <> second").withColumn("name", F.col("second")), ["cluster", "name"])
    columns = ["cluster", "first", "second", "side", "component", "set"]
    dealt = left.select(columns).unionByName(right.withColumn("side", F.lit(1)).select(columns))

    def compare(table: pa.Table) -> pa.Table:
        column = table.column("set").combine_chunks()
        component, side = table.column("component").to_numpy(), table.column("side").to_numpy()
        lengths = np.diff(column.offsets.to_numpy())
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rows = np.flatnonzero(side == 0)
        columns = np.flatnonzero(side == 1) if (side == 1).any() else rows
        a, b = [], []
        if len(np.unique(component)) > 1 and len(rows):
            common = common_counts(column.flatten().to_numpy(), owner, rows, columns)
            union = lengths[rows][:, None] + lengths[columns][None, :] - common
            r, c = np.nonzero((common * 100 >= union * percent) & (component[rows][:, None] != component[columns][None, :]))
            found = np.unique(np.sort(np.column_stack([component[rows[r]], component[columns[c]]]), axis=1), axis=0)
            a, b = _forest(found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.select(
        F.struct("cluster", "first", "second").alias("pair"), "side", "component", "set"
    ).groupBy("pair").applyInArrow(compare, "a long, b long")


def _forest(pairs: np.ndarray) -> tuple[list[int], list[int]]:
    """As many of the pairs as connect the same nodes."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    a, b = [], []
    for x, y in pairs.tolist():
        rx, ry = find(x), find(y)
        if rx != ry:
            top[ry] = rx
            a.append(x)
            b.append(y)
    return a, b


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Documents are linked if ``100 * intersection >= percent * union`` of their
    sets of ``width``-word shingles; links are confirmed on full sets.
    ``component_id`` is the smallest doc_id that a document reaches, itself
    included, and ``kept`` marks the document of that id.

    A text without words, empty or null, has no set and no link. Rows with
    equal ids and texts give equal rows. A row without doc_id is in a component
    of its own and kept. Other columns take no part, and an empty table gives
    an empty result. What the join misses are pairs whose signatures agree in
    fewer than ``matches`` of 64 coordinates.
    """
    table = written(_sets(docs, width), "shingle-sets")
    valid = table.where("doc_id is not null and n > 0")
    nodes = written(
        valid.groupBy("mark").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")),
        "nodes",
    )
    prefix = _prefixes(nodes, matches)
    leads = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("lead")).where("c > 1")
    lists = written(prefix.join(leads.drop("c"), "token"), "lists")
    sets = written(_full_sets(docs, lists, width), "full-sets")
    first = written(_with_all(lists, components(_star_links(lists, nodes, sets, matches, percent))), "first-components")

    # Lists whose nodes are not all in one component yet.
    mixed = lists.join(first, "node")
    low = mixed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_lists = written(mixed.join(low.drop("high"), "token").select("node", "component", "low"), "open-lists")
    clusters = components(open_lists.select(F.col("component").alias("a"), F.col("low").alias("b")).distinct())
    members = (
        open_lists.select("node", "component")
        .distinct()
        .join(clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component")
        .join(sets.withColumn("n", F.size("set").cast("long")), "node")
        .select("cluster", "component", "node", "n", "set")
    )
    more = components(_cluster_links(members, percent))
    last = first.join(
        more.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left"
    ).select("node", F.coalesce("top", "component").alias("component"))
    by_mark = nodes.join(last, "node", "left").select("mark", F.coalesce("component", "node").alias("component"))
    joined = salted_join(table, by_mark, ["mark"], ["doc_id"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _with_all(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The component of every listed node, itself if it has no link yet."""
    listed = lists.select("node").distinct()
    return listed.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
