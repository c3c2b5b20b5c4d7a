"""Data behind the charts: histograms, densities, box statistics, daily means."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, value_counts
from ..functions.spreading import salted_join
from ..session import written
from .columns import numeric_names


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 25) -> DataFrame:
    """Equal-width bins between each column's min and max, the last one closed.

    Returns ``(attribute, bin, lower, upper, n)``; empty bins have ``n = 0``. A
    constant column has all its rows in the first bin, one without values has
    no bins. The limits are one row, read first; the bins are then counted where
    the rows are, so at most ``bins`` rows a column and task are shuffled.
    """
    names = list(columns or numeric_names(df))
    doubles = df.select([F.col(c).cast("double").alias(c) for c in names])
    ends = doubles.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))])
    row = ends.first()
    known = {c: (row[f"lo{i}"], (row[f"hi{i}"] - row[f"lo{i}"]) / bins) for i, c in enumerate(names) if row[f"lo{i}"] is not None}
    limits = df.sparkSession.createDataFrame(
        [(c, lo, width, b) for c, (lo, width) in known.items() for b in range(bins)],
        "attribute string, lo double, width double, bin int",
    )

    def place(c: str) -> Column:
        lo, width = known[c]
        spot = F.floor((F.col(c) - F.lit(lo)) / F.lit(width)) if width else F.lit(0)
        return F.when(F.col(c).isNotNull(), F.least(spot, F.lit(bins - 1)).cast("int")).alias(c)

    filled = (
        doubles.select(*[place(c) for c in known])
        .unpivot([], list(known), "attribute", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("attribute", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        if known
        else df.sparkSession.createDataFrame([], "attribute string, bin int, n long")
    )
    return limits.join(filled, ["attribute", "bin"], "left").select(
        "attribute",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def kernel_density(
    df: DataFrame, group: str, value: str, points: int = 200, cut: float = 3.0
) -> DataFrame:
    """Gaussian kernel density of ``value`` per group at evenly spaced points.

    Scott bandwidth; the grid reaches ``cut`` bandwidths past the data. Rows are
    first reduced to distinct values with counts; one aggregate then holds
    ``points`` sums for each group, combined on the map side.
    """
    counts = value_counts(df, [group], value)
    return _density_curve(counts, _density_grid(df, group, value, points, cut), group, points)


def binned_density(
    df: DataFrame, group: str, value: str, points: int = 200, cut: float = 3.0, tolerance: float = 1e-4
) -> DataFrame:
    """``kernel_density`` from linearly binned rows: for columns with about as many values as rows.

    Each row is shared by the two nodes around it on a grid so fine that no
    density is off by more than ``tolerance`` times the height of one kernel,
    ``1 / (h * sqrt(2 * pi))``: linear interpolation of the kernel between nodes
    ``d`` apart errs by at most ``(d / h)**2 / 8`` of that. Rows are added up where
    they are read, so a task shuffles two sums for each node it meets, and the
    curve is summed over nodes in place of values. Their number grows with the
    range in bandwidths, about the fifth root of the rows. Null and constant
    groups are left out as in ``kernel_density``.
    """
    finest = math.sqrt(8 * tolerance)
    grid = _density_grid(df, group, value, points, cut).where(F.col("h") > 0)
    ratio = F.ceil(F.col("step") / (F.col("h") * finest)).cast("double")
    nodes = grid.select(group, "first", (F.col("step") / ratio).alias("width"))
    rows = df.select(group, F.col(value).cast("double").alias("x")).where("x is not null")
    spot = (F.col("x") - F.col("first")) / F.col("width")
    shares = (
        salted_join(rows, nodes, [group], ["x"])
        .select(group, "first", "width", F.floor(spot).alias("node"), (spot - F.floor(spot)).alias("right"))
        .groupBy(group, "first", "width", "node")
        .agg(F.sum(1 - F.col("right")).alias("left"), F.sum("right").alias("right"))
    )
    sides = F.array(
        F.struct(F.col("node").alias("node"), F.col("left").alias("n")),
        F.struct((F.col("node") + 1).alias("node"), F.col("right").alias("n")),
    )
    counts = shares.select(group, "first", "width", F.inline(sides)).select(
        group, (F.col("first") + F.col("node") * F.col("width")).alias("x"), "n"
    )
    return _density_curve(counts, grid, group, points)


def _density_grid(df: DataFrame, group: str, value: str, points: int, cut: float) -> DataFrame:
    """``(group, total, h, first, step)``: number of values, bandwidth and evenly spaced points of each group."""
    # Spread from the raw rows: stable, unlike sums of squares of the counts.
    spread = df.groupBy(group).agg(
        F.count(value).cast("double").alias("total"),
        F.stddev_samp(F.col(value).cast("double")).alias("sd"),
        F.min(F.col(value).cast("double")).alias("lo"),
        F.max(F.col(value).cast("double")).alias("hi"),
    )
    return spread.withColumn("h", F.col("sd") * F.pow("total", F.lit(-0.2))).select(
        group,
        "total",
        "h",
        (F.col("lo") - cut * F.col("h")).alias("first"),
        ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)).alias("step"),
    )


def _density_curve(counts: DataFrame, grid: DataFrame, group: str, points: int) -> DataFrame:
    """Kernels around the values ``x``, ``n`` times each, summed at the points of the grid."""
    x, n = F.col("x"), F.col("n")
    placed = salted_join(counts, grid.where(F.col("h") > 0), [group], ["x"]).select(
        group,
        "first",
        "step",
        # In bandwidths from the first grid point, and the share of one value.
        ((F.col("first") - x) / F.col("h")).alias("z0"),
        (F.col("step") / F.col("h")).alias("dz"),
        (n / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))).alias("w"),
    )

    def height(point: int) -> Column:
        z = F.col("z0") + point * F.col("dz")
        return F.sum(F.col("w") * F.exp(z * z * -0.5))

    curve = placed.groupBy(group, "first", "step").agg(F.array(*[height(i) for i in range(points)]).alias("heights"))
    return curve.select(group, "first", "step", F.posexplode("heights").alias("point", "density")).select(
        group, "point", (F.col("first") + F.col("point") * F.col("step")).alias("at"), "density"
    )


def box_stats(df: DataFrame, dimensions: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (extreme rows within 1.5 IQR) and outliers per level.

    ``(dimension, level, q1, median, q3, low, high, outliers, n)``. With no
    dimensions the whole table is one box. The counts of distinct values are
    made once, for quartiles and whiskers.
    """
    if dimensions:
        text = [F.col(d).cast("string").alias(d) for d in dimensions]
        long = df.select(F.col(value), *text).unpivot([value], list(dimensions), "dimension", "level")
    else:
        long = df.select(F.col(value), F.lit("all").alias("dimension"), F.lit("all").alias("level"))
    groups = ["dimension", "level"]
    counts = written(value_counts(long.where(F.col("level").isNotNull()), groups, value), "box-counts")
    boxes = exact_quantiles(counts, groups, [0.25, 0.5, 0.75]).select(
        *groups,
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return salted_join(counts, boxes, groups, ["x"]).groupBy(*groups, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("low"),
        F.max(F.when(inside, F.col("x"))).alias("high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
        F.sum("n").alias("n"),
    )


def daily_means(df: DataFrame, *values: str, date: str = "date") -> DataFrame:
    """Mean of each value per date, with the row count and standard deviation."""
    sums = [F.avg(v).alias(f"mean_{v}") for v in values]
    spreads = [F.stddev_samp(v).alias(f"std_{v}") for v in values]
    return df.groupBy(date).agg(*sums, *spreads, F.count(F.lit(1)).alias("n"))
