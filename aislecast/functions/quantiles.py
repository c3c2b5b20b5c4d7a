"""Exact quantiles without gathering a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer. Here the values are first counted (with map-side combine).
Brackets around the wanted ranks are then narrowed until each holds few enough
distinct values to be sorted by one task, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .spreading import salted_join

# Distinct values that one task sorts, and parts that a longer bracket is cut into.
BRACKET_ROWS = 100_000
PARTS = 32


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values of each group and how often they occur: ``(groups, x, n)``."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    counts: DataFrame,
    groups: Sequence[str],
    probs: Sequence[float],
    few_groups: bool = False,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Linearly interpolated quantiles of ``value_counts`` output.

    Returns ``groups`` plus ``total`` (rows) and ``q``, an array in the order of
    ``probs``. Equal to NumPy's default method. ``few_groups`` says that the
    groups are column names, at most one per column of a table: the one-row-per-
    group frames are then broadcast. Otherwise they are joined with salted keys.
    At least one group column is needed; a constant will do.

    A bracket is a range of values that holds a wanted rank; at first each
    group is one. A bracket of more than ``bracket_rows`` distinct values is cut
    at approximate quantiles, and only the parts that hold a rank go on. Each
    pass makes the largest bracket some ``PARTS`` times smaller.
    """
    groups = list(groups)
    low, high, share = _ranks(probs)
    # Every pass reads them, so they are taken once.
    counts = written(counts, "counts")
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    nothing = F.lit(None).cast("double")
    brackets = totals.select(
        *groups, "total", nothing.alias("above"), nothing.alias("to"), F.lit(0).cast("long").alias("before")
    )

    def inside(brackets: DataFrame) -> DataFrame:
        met = counts.join(F.broadcast(brackets), groups) if few_groups else salted_join(counts, brackets, groups, ["x"])
        over = F.coalesce(F.col("x") > F.col("above"), F.lit(True))
        return met.where(over & F.coalesce(F.col("x") <= F.col("to"), F.lit(True)))

    bounds = ["total", "above", "to", "before"]
    while (_largest(inside(brackets), [*groups, "before"]) or 0) > bracket_rows:
        brackets = written(_narrowed(inside(brackets), [*groups, *bounds], low + high), "brackets")
    within = Window.partitionBy(*groups, "before").orderBy("x")
    ranked = (
        inside(brackets)
        .withColumn("end", F.col("before") + F.sum("n").over(within))
        .withColumn("start", F.col("end") - F.col("n"))
    )

    def at(rank):
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("x")))

    picks = [
        at(first) + (at(second) - at(first)) * F.max(part)
        for first, second, part in zip(low, high, share)
    ]
    return ranked.groupBy(*groups).agg(F.max("total").alias("total"), F.array(*picks).alias("q"))


def _largest(rows: DataFrame, keys: Sequence[str]) -> int | None:
    """Distinct values in the largest bracket."""
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0]


def _narrowed(rows: DataFrame, keys: Sequence[str], ranks: Sequence[Column]) -> DataFrame:
    """The parts of the brackets that hold a rank.

    The sums per part are map-side combined, one row for each bracket and part.
    """
    cuts = [i / PARTS for i in range(1, PARTS)]
    borders = rows.groupBy(*keys).agg(F.percentile_approx("x", cuts, F.lit(20 * PARTS)).alias("borders"))
    # A group and the rows before it tell a bracket; its lower bound may be missing.
    names = [k for k in keys if k not in ("above", "to")]
    cut = salted_join(rows.drop("above", "to"), borders.select(*names, "above", "borders"), names, ["x"])
    part = F.size(F.filter("borders", lambda b: b < F.col("x")))
    sizes = cut.groupBy(*names, "above", "borders", part.alias("part")).agg(
        F.sum("n").alias("size"), F.max("x").alias("to")
    )
    order = Window.partitionBy(*names).orderBy("part")
    placed = sizes.withColumn("end", F.col("before") + F.sum("size").over(order)).withColumn(
        "start", F.col("end") - F.col("size")
    )
    held = [(F.col("start") <= rank) & (rank < F.col("end")) for rank in ranks]
    wanted = held[0]
    for one in held[1:]:
        wanted = wanted | one
    below = F.coalesce(F.get("borders", F.col("part") - 1), "above")
    return placed.where(wanted).select(
        *[k for k in names if k != "before"], below.alias("above"), "to", F.col("start").alias("before")
    )


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    approx: bool = False,
    accuracy: int = 10000,
    few_groups: bool = False,
) -> DataFrame:
    """Quantiles of ``value`` per group, exact by default or from Spark's sketch."""
    if not approx:
        return exact_quantiles(value_counts(df, groups, value), groups, probs, few_groups=few_groups)
    x = F.col(value).cast("double")
    return df.groupBy(*groups).agg(
        F.count(x).alias("total"),
        F.percentile_approx(x, [float(p) for p in probs], F.lit(accuracy)).alias("q"),
    )


def _ranks(probs: Sequence[float]) -> tuple[list[Column], list[Column], list[Column]]:
    """Zero-based ranks below and above each quantile, and the share between them."""
    spots = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    low = [F.floor(s) for s in spots]
    return low, [F.ceil(s) for s in spots], [s - f for s, f in zip(spots, low)]
