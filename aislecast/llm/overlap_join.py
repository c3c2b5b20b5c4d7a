"""N-gram Jaccard join of documents by T-occurrence search, exact.

1. Every text becomes its set of word shingles; texts with equal sets are one
   node. A node is posted under the tokens of its prefix: the first ones in an
   order of all tokens, so many that a partner must share several of them
   (``shared_least``). Nodes with fewer shared tokens have no partner.
2. In rounds, every node is compared with one other node of its lists, that it
   meets most often and often enough. That joins most of a group of copies with as many
   comparisons as nodes.
3. In lists whose nodes are not all joined yet, a node visits the components of
   the others that it meets often enough: DivideSkip finds its partners in the inverted lists of their
   sets, which are held in blocks of bounded size, small components together. A list with more than
   ``COMPONENTS`` of them is left to step 4.
4. Nodes of such frequent tokens are posted anew in an order that has these
   tokens last, and treated as in step 3. Those that still have frequent ones
   after ``LEVELS`` rounds visit whole blocks of each other.

The order of tokens is that of their hashes, so no frequencies have to be
shuffled. Blocks and their visitors are dealt by numbers of bounded size, and
only links leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from ..session import written
from .components import components
from .divide_skip import InvertedLists, needed
from .near_copies import shingles
from .text import slices

PERCENT = 85
STARS = 1
LEVELS = 3
COMPONENTS = 12
FILTER_BITS = 1 << 24
BLOCK_TOKENS = 1_000_000
VISITORS = 2_000


def shared_least(n, percent: int):
    """Tokens that the prefix of a set of size ``n`` shares with that of a partner as large: half of the shortest prefix.

    For numbers and columns alike.
    """
    shortest = n - (n * percent + 99 - (n * percent + 99) % 100) / 100 + 1
    return (shortest + 1 - (shortest + 1) % 2) / 2


def _prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The first of the ordered tokens: similar sets share ``shared_least`` of theirs, for the smaller one's size."""
    n = len(tokens)
    return tokens[: n - needed(n, 0, percent) + int(shared_least(n, percent))] if n else tokens


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    lengths = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat.view(np.int64)))


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, n, mark, prefix)``: size, digest and prefix of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            sets = [shingles(text, width) for text in batch.column("text").to_pylist()]
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(marks, pa.binary()),
                    _lists([_prefix(s, percent) for s in sets]),
                ],
                names=["doc_id", "n", "mark", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, mark binary, prefix array<long>")


def _bits(nodes: DataFrame) -> np.ndarray:
    """A filter of fixed size that every one of the nodes passes."""
    places = nodes.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("at"))
    words = places.groupBy(F.expr("int(at div 32)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 32)))").alias("bits"))
    found = words.toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``(node, set)``: the sets of the nodes in ascending order, unsigned, made anew from their texts.

    Texts are not shuffled: a filter of ``FILTER_BITS`` drops most others where
    they are read. Those that pass by chance do no harm.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_bits(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array(sent.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1) == 1))
            sets = [shingles(text, width) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets)], names=["node", "set"])

    node = F.col("doc_id").cast("long")
    rows = docs.select(node.alias("node"), F.pmod(F.xxhash64(node), F.lit(FILTER_BITS)).alias("at"), "text")
    return rows.where("node is not null").mapInArrow(run, "node long, set array<long>")


def _visits(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` of visitors with sets of the block they visit, one for each other component there.

    ``rows`` is (block, visitor, name, component, set).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple]:
            for batch in slices(batches, 500):
                column = batch.column("set")
                offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
                sets = [flat[a:b] for a, b in zip(offsets, offsets[1:])]
                yield from zip(*(batch.column(n).to_pylist() for n in ("block", "visitor", "name", "component")), sets)

        a, b = [], []
        for _, block in groupby(entries(), lambda e: e[0]):
            names, sets, places, index = [], [], [], None
            for _, visitor, name, component, tokens in block:
                if not visitor:
                    names.append(name)
                    places.append(component)
                    sets.append(tokens)
                    continue
                if index is None:
                    index, others = InvertedLists(sets), len(set(places))
                met = {component}
                for found in index.search(tokens, percent):
                    if places[found] not in met:
                        met.add(places[found])
                        a.append(name)
                        b.append(names[found])
                        if len(met) > others:
                            break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    # Visitors of one block in one task, in an order that puts the block's sets first.
    dealt = rows.repartition("block", "share").sortWithinPartitions("block", "share", "visitor").drop("share")
    return dealt.mapInArrow(run, "a long, b long")


def _star_links(lists: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links of nodes with the first node of another component in one of their lists: that they meet most often.

    ``lists`` is (token, node, component). Which node of a list is first
    changes with ``turn``.
    """
    rank = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    first = lists.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "node", "component", "least")).alias("first"))
    met = salted_join(lists, first, ["token"], ["node"], salts=4).where("component <> first.component")
    enough = F.least(shared_least(F.col("least"), percent), shared_least(F.col("first.least"), percent))
    often = met.groupBy("node", F.col("first.node").alias("lead")).agg(
        F.count(F.lit(1)).alias("n"), F.min(enough).alias("enough")
    )
    best = often.where("n >= enough").groupBy("node").agg(F.max(F.struct("n", (-F.col("lead")).alias("minus"))).alias("best"))
    pairs = written(best.select("node", (-F.col("best.minus")).alias("lead")), "star-pairs")
    block = F.col("lead").cast("string").alias("block")
    leads = pairs.select("lead", block).distinct().select(F.col("lead").alias("node"), F.col("lead").alias("component"), "block")
    visitors = pairs.select("node", F.lit(None).cast("long").alias("component"), block)
    return _visits(_dealt(visitors, leads, sets), percent)


def _dealt(visitors: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``_visits``: every member's set in each share of its block, every visitor's in one share.

    ``visitors`` and ``members`` are (node, component, block); a block has one
    share for each ``VISITORS`` visitors.
    """
    shares = visitors.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("shares"))
    share = F.pmod(F.xxhash64("node"), F.col("shares")).alias("share")
    placed = salted_join(visitors, shares, ["block"], ["node"], salts=8).select(
        "node", "component", "block", share, F.lit(True).alias("visitor")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    copied = members.join(shares, "block").select("node", "component", "block", every, F.lit(False).alias("visitor"))
    rows = placed.unionByName(copied).join(sets, "node")
    return rows.select("block", "share", "visitor", F.col("node").alias("name"), "component", "set")


def _open(lists: DataFrame, component: DataFrame) -> DataFrame:
    """The lists ``(token, node, component, least, most)`` whose nodes are not all in one component."""
    placed = lists.select("token", "node").join(component, "node")
    ends = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return salted_join(placed, ends.where("low < high").select("token"), ["token"], ["node"], salts=4)


def _visit_links(lists: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between components that share a list, as links of nodes.

    A node visits the components of its lists that are larger than its own, or
    as large with a greater id, if sets of its size can have partners there and
    it meets them often enough.
    """
    sized = component.groupBy("component").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("most").alias("total"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
    )
    kept = written(sized, "component-sizes")
    here = lists.select("token", "component").distinct().join(kept, "component")
    there = here.groupBy("token").agg(
        F.collect_list(F.struct("c", "component", "least", "most", "total")).alias("others")
    )
    rows = lists.join(kept.select("component", "c"), "component")
    met = salted_join(rows, there, ["token"], ["node"], salts=4).select(
        "node", "least", "most", F.struct("c", "component").alias("own"), F.explode("others").alias("other")
    )
    larger = F.struct(F.col("other.c"), F.col("other.component")) > F.struct(F.col("own.c"), F.col("own.component"))
    fits = (F.col("most") * 100 >= F.col("other.least") * percent) & (F.col("other.most") * 100 >= F.col("least") * percent)
    enough = F.least(shared_least(F.col("least"), percent), shared_least(F.col("other.least"), percent))
    often = met.where(larger & fits).groupBy("node", F.col("other.component").alias("there")).agg(
        F.count(F.lit(1)).alias("n"), F.min(enough.cast("int")).alias("enough")
    )
    found = often.where("n >= enough").select("node", "there")
    totals = kept.select(F.col("component").alias("there"), "total")
    visits = written(found.join(component.select("node", "component"), "node").join(totals, "there"), "visits")
    # Components of less than a block share blocks; a larger one has several of its own.
    goals = visits.select("there", "total").distinct()
    small = F.col("total") <= BLOCK_TOKENS
    pools = 1 + (goals.agg(F.sum(F.when(small, F.col("total")))).first()[0] or 0) // BLOCK_TOKENS
    parts = F.when(small, 1).otherwise(F.ceil(F.col("total") / BLOCK_TOKENS))
    goals = goals.select("there", small.alias("small"), parts.alias("parts"))

    def block(part: Column) -> Column:
        own = F.concat_ws("/", F.lit("own"), "there", part)
        pool = F.concat_ws("/", F.lit("pool"), F.pmod(F.xxhash64("there"), F.lit(pools)))
        return F.when(F.col("small"), pool).otherwise(own).alias("block")

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    visitors = (
        visits.withColumn("small", small)
        .select("node", "component", "there", "small", parts.alias("parts"))
        .select("node", "component", "there", "small", every)
        .select("node", "component", block(F.col("part")))
        .distinct()
    )
    members = salted_join(
        component.select("node", "component", F.col("component").alias("there")), goals, ["there"], ["node"], salts=8
    ).select("node", "component", block(F.pmod(F.xxhash64("node"), F.col("parts"))))
    return _visits(_dealt(visitors, members, sets), percent)


def _pool_links(lists: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between nodes of lists that many components share, without a row for each pair of them.

    The nodes are dealt over blocks; each visits the blocks that have a node of
    one of its lists, itself or on the far side of its own block.
    """
    nodes = lists.select("node", "component", "most").distinct()
    pools = 1 + (nodes.agg(F.sum("most")).first()[0] or 0) // BLOCK_TOKENS
    pool = F.pmod(F.xxhash64("node"), F.lit(pools))
    there = lists.groupBy("token").agg(F.collect_set(pool).alias("pools"))
    visits = salted_join(lists.select("token", "node", "component"), there, ["token"], ["node"], salts=8).select(
        "node", "component", pool.alias("own"), F.explode("pools").alias("pool")
    )
    block = F.concat_ws("/", F.lit("pool"), "pool").alias("block")
    visitors = visits.where("pool >= own").select("node", "component", block).distinct()
    members = nodes.select("node", "component", F.concat_ws("/", F.lit("pool"), pool).alias("block")).distinct()
    return _visits(_dealt(visitors, members, sets), percent)


def _posted_anew(nodes: DataFrame, sets: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """``(token, node)``: prefixes of the nodes in the order that has the frequent tokens last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            prefixes = []
            for tokens, late in zip(batch.column("set").to_pylist(), batch.column("late").to_pylist()):
                tokens = np.array(tokens, np.int64).view(np.uint64)
                last = np.isin(tokens, np.array(late, np.int64).view(np.uint64))
                prefixes.append(_prefix(np.concatenate([tokens[~last], tokens[last]]), percent))
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(prefixes)], names=["node", "prefix"])

    held = sets.join(nodes, "node")
    late = (
        held.select("node", F.explode("set").alias("token"))
        .join(frequent, "token")
        .groupBy("node")
        .agg(F.collect_list("token").alias("late"))
    )
    rows = held.join(late, "node").select("node", "set", "late")
    return rows.mapInArrow(run, "node long, prefix array<long>").select(F.explode("prefix").alias("token"), "node")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings ``(token, node)`` of tokens that several nodes have, from one shuffle."""
    counted = postings.repartition("token").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token")))
    return counted.where("c > 1").drop("c")


def overlap_join(docs: DataFrame, width: int = 4, percent: int = PERCENT, most: int = COMPONENTS, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``.

    Documents are linked if ``100 * intersection >= percent * union`` of their
    sets of ``width``-word shingles. ``component_id`` is the smallest doc_id
    that a document reaches by links, itself included.

    A text without words, empty or null, has no set and no link. Rows that share
    a doc_id are one document with several texts. A row without doc_id is in a component
    of its own, a null one. Other columns take no part, and an empty table
    gives an empty result. No link between different sets is lost; shingles
    are compared by 64-bit hashes.
    """
    table = written(_sets(docs, width, percent), "overlap-sets")
    valid = table.where("doc_id is not null and n > 0")
    nodes = valid.groupBy("mark").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"))
    first = valid.groupBy("mark").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"))
    lists = written(_shared(first.select(F.explode("prefix").alias("token"), "node")), "overlap-lists")
    # A partner of a set is at least this large.
    smallest = (F.col("n") * percent + 99 - (F.col("n") * percent + 99) % 100) / 100
    meets = lists.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    listed = written(
        nodes.withColumn("enough", shared_least(smallest, percent))
        .groupBy("node")
        .agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("enough").alias("enough"))
        .join(meets, "node")
        .where("c >= enough")
        .select("node", "least", "most"),
        "overlap-listed",
    )
    sets = _full_sets(docs, listed, width)
    if not valid.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
        sets = sets.distinct()
    sets = written(sets, "overlap-full-sets")
    component = listed.withColumn("component", F.col("node"))
    frequent: DataFrame | None = None
    for level in range(levels):
        pending = written(_open(lists, component), "open-lists")
        for turn in range(STARS if level == 0 else 0):
            component = _joined(component, _star_links(pending, sets, percent, turn))
            pending = written(_open(pending, component), "open-lists")
        several = pending.select("token", "component").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("c"))
        heavy = written(several.where(F.col("c") > most).select("token"), "frequent-tokens")
        light = pending.join(heavy, "token", "left_anti")
        component = _joined(component, _visit_links(light, component, sets, percent))
        if heavy.isEmpty():
            break
        if level == levels - 1:
            some = pending.join(heavy, "token", "left_semi").drop("component").join(component.select("node", "component"), "node")
            component = _joined(component, _pool_links(some, component, sets, percent))
            break
        again = written(pending.join(heavy, "token", "left_semi").select("node").distinct(), "nodes-again")
        frequent = heavy if frequent is None else frequent.unionByName(heavy)
        lists = written(_shared(_posted_anew(again, sets, frequent.distinct(), percent)), "overlap-lists")
    by_mark = nodes.select("mark", "node").join(component.select("node", "component"), "node", "left")
    by_mark = by_mark.select("mark", F.coalesce("component", "node").alias("component"))
    joined = salted_join(table.drop("prefix"), by_mark, ["mark"], ["doc_id"], "left")
    found = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id")
    return _one_per_id(written(joined.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id")), "overlap-rows"))


def _joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components of nodes after links ``(a, b)`` between nodes."""
    at = component.select("node", "component")
    pairs = links.join(at.select(F.col("node").alias("a"), F.col("component").alias("one")), "a").join(
        at.select(F.col("node").alias("b"), F.col("component").alias("two")), "b"
    )
    pairs = written(pairs.where("one <> two").select("one", "two").distinct(), "new-links")
    if pairs.isEmpty():
        return component
    top = components(pairs, "one", "two").select(F.col("node").alias("component"), F.col("component").alias("top"))
    rows = salted_join(component, top, ["component"], ["node"], "left", salts=8)
    return written(rows.withColumn("component", F.coalesce("top", "component")).drop("top"), "overlap-components")


def _one_per_id(rows: DataFrame) -> DataFrame:
    """The rows, with the components of rows that share a doc_id made one."""
    ends = rows.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    split = written(ends.where("low < high").select("doc_id", "low"), "split-ids")
    if split.isEmpty():
        return rows
    pairs = rows.join(split, "doc_id").select(F.col("component_id").alias("a"), F.col("low").alias("b"))
    top = components(pairs).select(F.col("node").alias("component_id"), F.col("component").alias("top"))
    joined = salted_join(rows, top, ["component_id"], ["doc_id"], "left", salts=8)
    return joined.select("doc_id", "n_shingles", F.coalesce("top", "component_id").alias("component_id"))
