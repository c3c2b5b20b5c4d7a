"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected to a few axes in several ways, each with a shift of its
own, and put in Hilbert order. Each curve is cut into ranges of about as many
vectors; a query is compared with the ranges around its own place on every
curve, and the finds of all curves are merged and ranked by their true scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .hilbert import hilbert_keys

CURVES, AXES, BITS = 24, 6, 10
RANGES, SIDE = 48, 1
MIN_RANGE = 600
BLOCK = 4_096
SEED = 20
SPARE = 8


@dataclass(frozen=True)
class Curves:
    """Projections, shifts and scale: what turns a vector into its keys."""

    axes: np.ndarray  # curve x dimension + 1 x axis
    shift: np.ndarray  # curve x axis
    centre: np.ndarray
    scale: np.ndarray
    longest: float

    @classmethod
    def drawn(cls, total: np.ndarray, squares: np.ndarray, count: int, longest: float, curves: int, seed: int) -> Curves:
        """Random orthonormal axes, scaled by the spread of the data along each."""
        rng = np.random.default_rng(seed)
        size = len(total) + 1
        used = min(AXES, size)
        axes = np.stack([np.linalg.qr(rng.normal(size=(size, used)))[0] for _ in range(curves)])
        mean = total / count
        spread = np.append(np.sqrt(np.maximum(squares / count - mean**2, 0)), 0)
        centre = np.einsum("d,cdk->ck", np.append(mean, 0), axes)
        scale = np.sqrt(np.einsum("d,cdk->ck", spread**2, axes**2))
        return cls(axes, rng.random((curves, used)), centre, np.where(scale > 0, scale, 1.0), longest)

    def keys(self, vectors: np.ndarray, as_query: bool) -> np.ndarray:
        """Key of each vector on each curve (curve x vector).

        A stored vector gets one more component, which brings all of them to
        the same length; a query gets zero. So the largest inner product is
        the smallest distance.
        """
        rest = np.maximum(self.longest**2 - np.einsum("nd,nd->n", vectors, vectors), 0)
        wide = np.column_stack([vectors, np.zeros(len(vectors)) if as_query else np.sqrt(rest)])
        out = []
        for axes, shift, centre, scale in zip(self.axes, self.shift, self.centre, self.scale):
            place = (wide @ axes - centre) / scale  # in standard deviations
            cells = (place + 5 + 2 * shift) / 12 * (1 << BITS)
            out.append(hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return np.array(out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``(vec_id, vec)`` that take part: an id, and a vector of finite numbers that is not zero."""
    vec = F.col("vec")
    good = (
        F.col("vec_id").isNotNull()
        & (F.size(vec) > 0)
        & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        & F.exists(vec, lambda x: x != 0)
    )
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return named.where(F.coalesce(good, F.lit(False)))


def distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """One row for each distinct vector: a number ``vid`` of its own and its ``copies`` smallest ids.

    No more copies of a vector can be among that many nearest ones. Equal rows
    count once. The rank limit works before the shuffle, so many copies cost no
    task anything. The numbers rise with the smallest id, so they settle ties as
    ids do; an id that several vectors share gives each of them another number.
    Write the result before it is used twice: numbers depend on the partitions.
    """
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= copies)
    groups = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = F.col("ids")[0]
    ordered = groups.repartitionByRange(first, "vec").sortWithinPartitions(first, "vec")
    return ordered.withColumn("vid", F.monotonically_increasing_id())


def _matrix(batch: pa.RecordBatch, name: str = "vec") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _statistics(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Number, sums, sums of squares and largest length: one row from each task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares, longest = 0, 0.0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                n, total, squares = n + len(x), total + x.sum(0), squares + (x**2).sum(0)
                longest = max(longest, float(np.sqrt((x**2).sum(1)).max()))
        if n:
            yield pa.RecordBatch.from_pydict(
                {"n": [n], "total": [total.tolist()], "squares": [squares.tolist()], "longest": [longest]}
            )

    rows = points.select("vec").mapInArrow(sums, "n long, total array<double>, squares array<double>, longest double").collect()
    total, squares = (sum(np.array(r[k]) for r in rows) for k in ("total", "squares"))
    return sum(r["n"] for r in rows), total, squares, max((r["longest"] for r in rows), default=0.0)


def _inner_product(a: str, b: str) -> Column:
    """Products added up in the order of the components, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(
    vectors: DataFrame,
    k: int = 20,
    is_query: str = "vec_id % 20 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    ranges: int = RANGES,
    side: int = SIDE,
    min_range: int = MIN_RANGE,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """The ``k`` nearest rows found for each query row, by largest inner product.

    ``is_query`` is a condition on ``vec_id``. Each curve is cut into
    ``ranges`` ranges (fewer while they would hold less than ``min_range``
    vectors), and a query visits its own range and ``side`` ones on each side.
    Ranges are shares of the table, so the share of it that a query meets, and
    with it the recall, does not fall as the table grows. A range is searched
    in blocks of about ``block`` vectors, each a task's group.

    Rows with a null id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor those of another length than most.
    Equal rows count once. No row with the query's own id is its neighbour, and
    an id with several vectors is searched once for each of them, so it has as
    many lists; lists are made longer inside by the most vectors an id has. Ties
    go to the smaller id. With fewer candidates than ``k``, all are returned; an
    empty table gives an empty result. Only the two named columns are read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("vec") == sizes[0]["d"])
    # Rows of a query's own id leave its list, so the list needs as many spare places.
    per_id = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    own = 1 if per_id == 1 else rows.distinct().groupBy("vec_id").count().agg(F.max("count")).first()[0]
    points = written(distinct_vectors(rows, k + own), "points")
    asked = rows.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), "vec")
    queries = written(asked.join(points.select("vid", "vec"), "vec").select("query_id", "vid"), "queries")
    searched = points.join(queries.select("vid").distinct().withColumn("asked", F.lit(True)), "vid", "left").select(
        "vid", "vec", F.coalesce("asked", F.lit(False)).alias("asked")
    )

    n, total, squares, longest = _statistics(points)
    plan = Curves.drawn(total, squares, n, longest, curves, seed)
    used = max(1, min(ranges, n // min_range))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = plan.keys(_matrix(batch), False)
                yield pa.RecordBatch.from_pydict(
                    {"curve": np.repeat(np.arange(len(keys), dtype=np.int32), batch.num_rows), "key": keys.ravel()}
                )

    shares = [i / used for i in range(1, used)] or [0.5]
    cuts = (
        points.select("vec")
        .mapInArrow(keyed, "curve int, key long")
        .groupBy("curve")
        .agg(F.percentile_approx("key", shares, F.lit(100 * used)).alias("cuts"))
        .collect()
    )
    borders = [np.array(r["cuts"][: used - 1], dtype=np.int64) for r in sorted(cuts, key=lambda r: r["curve"])]
    blocks = max(1, math.ceil(n / used / block))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stored vector goes to a block of its range, a query to all blocks of the ranges around."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch), batch.column("vid").to_numpy()
            keys = plan.keys(x, False)
            is_asked = batch.column("asked").to_numpy(zero_copy_only=False).astype(bool)
            q, q_ids = x[is_asked], ids[is_asked]
            q_keys = plan.keys(q, True) if len(q) else np.zeros((len(keys), 0), np.int64)
            part = (ids * 2654435761 % (1 << 31)) % blocks
            for curve, cut in enumerate(borders):
                base = curve * used
                at = np.searchsorted(cut, keys[curve])
                yield _placed((base + at) * blocks + part, ids, x, False)
                here = np.searchsorted(cut, q_keys[curve])
                for move in range(-side, side + 1):
                    inside = (here + move >= 0) & (here + move < used)
                    for b in range(blocks):
                        if inside.any():
                            group = (base + here + move)[inside] * blocks + b
                            yield _placed(group, q_ids[inside], q[inside], True)

    keep = k + own + SPARE

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asked").to_numpy().astype(bool)
        ids = table.column("vid").to_numpy()
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        stored, s_ids = flat[~asks], ids[~asks]
        q, q_ids = flat[asks], ids[asks]
        out_q, out_v, out_s = [], [], []
        for start in range(0, len(q) if len(s_ids) else 0, 512):
            scores = q[start : start + 512] @ stored.T
            if scores.shape[1] > keep:
                best = np.argpartition(-scores, keep, axis=1)[:, :keep]
                # Also all that tie with the last one kept, so that ties are settled by id later.
                least = np.take_along_axis(scores, best, 1).min(1)
                r, c = np.nonzero(scores >= least[:, None])
            else:
                r, c = np.nonzero(np.ones(scores.shape, bool))
            out_q.append(q_ids[start + r])
            out_v.append(s_ids[c])
            out_s.append(scores[r, c])
        if not out_q:
            return pa.table({"qid": pa.array([], pa.int64()), "vid": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        return pa.table({"qid": np.concatenate(out_q), "vid": np.concatenate(out_v), "near": np.concatenate(out_s)})

    found = (
        searched.mapInArrow(dealt, "block long, vid long, vec array<double>, asked boolean")
        .groupBy("block")
        .applyInArrow(compare, "qid long, vid long, near double")
        .groupBy("qid", "vid")
        .agg(F.max("near").alias("near"))
    )
    best = Window.partitionBy("qid").orderBy(F.desc("near"), "vid")
    merged = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n", "near")
    # The true scores, from the vectors themselves.
    scored = (
        merged.join(points.select("vid", "vec", "ids"), "vid")
        .join(points.select(F.col("vid").alias("qid"), F.col("vec").alias("q_vec")), "qid")
        .select("qid", "ids", _inner_product("q_vec", "vec").alias("score"))
        .select("qid", F.explode("ids").alias("vec_id"), "score")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    lists = (
        scored.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + own)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    )
    answered = queries.join(lists, queries["vid"] == lists["qid"])
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )


def _placed(group: np.ndarray, ids: np.ndarray, vectors: np.ndarray, asked: bool) -> pa.RecordBatch:
    size = vectors.shape[1]
    flat = pa.array(np.ascontiguousarray(vectors).ravel())
    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * size), flat)
    return pa.RecordBatch.from_arrays(
        [pa.array(group.astype(np.int64)), pa.array(ids), vec, pa.array(np.full(len(ids), asked))],
        names=["block", "vid", "vec", "asked"],
    )
