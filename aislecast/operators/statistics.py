"""Descriptive statistics, correlation and association."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, value_counts
from ..session import held
from .columns import long_values, numeric_names
from .moments import pair_moments


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, approx_median: bool = False
) -> DataFrame:
    """Min, max, range, mean, median, population std, skew and kurtosis per column.

    Skew and (excess) kurtosis are bias-corrected. All of them are aggregates of
    one pass, so no value is shuffled, and with ``approx_median`` neither for
    the median. An exact median needs the counts of the distinct values.
    """
    names = list(columns or numeric_names(df))
    kinds = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop, "g1": F.skewness, "g2": F.kurtosis}
    kinds["total"] = F.count
    if approx_median:
        kinds["median"] = lambda c: F.percentile_approx(c, 0.5, F.lit(10_000))
    # One row for each column and task is shuffled.
    long = long_values(df, names)
    table = long.groupBy("attribute").agg(*[f("value").alias(k) for k, f in kinds.items()])
    if not approx_median:
        counts = value_counts(long, ["attribute"], "value")
        with held(counts) as kept:
            found = exact_quantiles(kept, ["attribute"], [0.5], few_groups=True)
            medians = [(r["attribute"], r["q"][0]) for r in found.collect()]
        small = df.sparkSession.createDataFrame(medians, "attribute string, median double")
        # One row per column of the table: safe to broadcast.
        table = table.join(F.broadcast(small), "attribute", "left")
    total = F.col("total").cast("double")
    skew = F.try_divide(F.col("g1") * F.sqrt(total * (total - 1)), total - 2)
    kurtosis = F.try_divide(total - 1, (total - 2) * (total - 3)) * ((total + 1) * F.col("g2") + 6)
    return table.where(total > 0).select(
        "attribute",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        "mean",
        "median",
        "std",
        F.when(total > 2, skew).alias("skew"),
        F.when(total > 3, kurtosis).alias("kurtosis"),
    )


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair as ``(col_a, col_b, r)``.

    One scan that adds up co-moment arrays, one for each task. A row with a
    missing value counts for the pairs in which it is complete; NaN counts as
    missing.
    """
    names = list(columns or numeric_names(df))
    found = pair_moments(df, names)
    r = found[0].correlations() if found else np.full((len(names), len(names)), np.nan)
    cells = [
        (a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(cells, "col_a string, col_b string, r double")


def corr_with(totals: DataFrame, x: str = "key", y: str = "sales") -> DataFrame:
    """Correlation of key and total for each attribute of ``totals_per_key``."""
    return totals.groupBy("attribute").agg(F.corr(F.col(x), F.col(y).cast("double")).alias("r"))


def trend_line(totals: DataFrame, x: str = "key", y: str = "sales") -> DataFrame:
    """Straight line of total on key for each attribute."""
    yd = F.col(y).cast("double")
    return totals.groupBy("attribute").agg(
        F.regr_slope(yd, F.col(x)).alias("slope"),
        F.regr_intercept(yd, F.col(x)).alias("intercept"),
        F.regr_r2(yd, F.col(x)).alias("r2"),
        F.regr_count(yd, F.col(x)).alias("n_keys"),
    )


def pair_counts(df: DataFrame, columns: Sequence[str], mirror: bool = False) -> DataFrame:
    """Contingency tables of all column pairs as ``(x, y, x_level, y_level, n)``.

    The table is read once: rows are first counted by their joint levels and
    the pairs are taken from those few counts.
    """
    names = list(columns)
    joint = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    pairs = list(combinations_with_replacement(names, 2))
    if mirror:
        pairs += [(b, a) for a, b in combinations(names, 2)]
    cells = [
        F.struct(
            F.lit(a).alias("x"),
            F.lit(b).alias("y"),
            F.col(a).cast("string").alias("x_level"),
            F.col(b).cast("string").alias("y_level"),
        )
        for a, b in pairs
    ]
    long = joint.select("n", F.inline(F.array(*cells)))
    present = F.col("x_level").isNotNull() & F.col("y_level").isNotNull()
    return long.where(present).groupBy("x", "y", "x_level", "y_level").agg(F.sum("n").alias("n"))


def cramers_v_from_counts(cells: DataFrame, published: bool = False) -> DataFrame:
    """Bias-corrected Cramér's V per ``(x, y)`` of ``pair_counts``.

    chi2 = N (sum of n_ij^2 / (r_i c_j) - 1) covers cells that do not occur, so
    no grid of levels is built. A 2x2 table takes the Yates correction. By
    default the bias term is taken off chi2; ``published=True`` takes it off
    chi2 / N.
    """
    pair = ["x", "y"]
    rows = cells.groupBy(*pair, "x_level").agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*pair, "y_level").agg(F.sum("n").alias("c"))
    shares = (
        cells.join(rows, [*pair, "x_level"])
        .join(cols, [*pair, "y_level"])
        .groupBy(*pair)
        .agg(F.sum(F.pow("n", F.lit(2.0)) / (F.col("r").cast("double") * F.col("c"))).alias("phi"))
    )
    # Sums of 1/r_i and 1/c_j give the sum of 1/e_ij over all cells of a 2x2.
    row_side = rows.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("r").alias("n"), F.sum(1 / F.col("r")).alias("inv_r")
    )
    col_side = cols.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c")
    )
    # One row per pair from each of the three: gathered without a join.
    parts = shares.unionByName(row_side, allowMissingColumns=True)
    parts = parts.unionByName(col_side, allowMissingColumns=True)
    names = ["phi", "n", "n_rows", "inv_r", "n_cols", "inv_c"]
    t = parts.groupBy(*pair).agg(*[F.max(name).alias(name) for name in names])

    n, r, k = F.col("n").cast("double"), F.col("n_rows"), F.col("n_cols")
    plain = F.greatest(n * (F.col("phi") - 1), F.lit(0.0))
    inverse_e = n * F.col("inv_r") * F.col("inv_c")
    gap = F.sqrt(plain / inverse_e)
    yates = F.pow(gap - F.least(gap, F.lit(0.5)), F.lit(2.0)) * inverse_e
    chi2 = F.when((r == 2) & (k == 2), yates).when((r == 1) | (k == 1), 0.0).otherwise(plain)

    bias = F.try_divide((k - 1) * (r - 1), n - 1)
    if published:
        phi2 = F.greatest(chi2 / n - bias, F.lit(0.0))
    else:
        phi2 = F.greatest(chi2 - bias, F.lit(0.0)) / n
    k_corr = k - F.try_divide(F.pow(k - 1, F.lit(2.0)), n - 1)
    r_corr = r - F.try_divide(F.pow(r - 1, F.lit(2.0)), n - 1)
    v = F.sqrt(F.try_divide(phi2, F.least(k_corr - 1, r_corr - 1)))
    return t.select("x", "y", v.alias("v"))


def cramers_v(df: DataFrame, x: str, y: str, published: bool = False) -> DataFrame:
    """One row ``(x, y, v)`` for one pair of columns."""
    named = df.select(F.col(x).alias("x_level"), F.col(y).alias("y_level"))
    cells = (
        named.where(F.col("x_level").isNotNull() & F.col("y_level").isNotNull())
        .groupBy("x_level", "y_level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(x).alias("x"), F.lit(y).alias("y"), "x_level", "y_level", "n")
    )
    return cramers_v_from_counts(cells, published)


def cramers_v_matrix(df: DataFrame, columns: Sequence[str], published: bool = False) -> DataFrame:
    """All pairs of ``columns``, both ways round."""
    half = cramers_v_from_counts(pair_counts(df, columns), published)
    both = F.when(
        F.col("x") == F.col("y"), F.array(F.struct("x", "y", "v"))
    ).otherwise(
        F.array(
            F.struct("x", "y", "v"),
            F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "v"),
        )
    )
    return half.select(F.inline(both))
