"""Scaling and encoding, each split into fitting and applying."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encode import assortment_rank, cycle, lookup
from ..functions.quantiles import quantiles
from ..functions.spreading import salted_join
from ..schemas import CYCLES, TARGET
from ..session import durable
from .columns import long_values

QUARTILES = [0.25, 0.5, 0.75]

# A literal map or one column per level is for metadata-sized sets of levels.
MAX_LITERAL_LEVELS = 1000


def robust_parameters(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``(feature, center, scale)``: median and interquartile range."""
    long = long_values(df, columns, "feature")
    q = quantiles(long, ["feature"], "value", QUARTILES, approx=approx, few_groups=True)
    return q.select(
        "feature", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale")
    )


def minmax_parameters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, center, scale)``: minimum and range, from one aggregate."""
    ends = [
        F.struct(
            F.lit(c).alias("feature"),
            F.min(F.col(c).cast("double")).alias("center"),
            (F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))).alias("scale"),
        )
        for c in columns
    ]
    return df.agg(F.array(*ends).alias("rows")).select(F.inline("rows")).where(F.col("center").isNotNull())


def scaled(value: Column, center: Column | float, scale: Column | float) -> Column:
    """``(value - center) / scale``, where a scale of 0 counts as 1."""
    center = center if isinstance(center, Column) else F.lit(center)
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return (value - center) / F.coalesce(F.nullif(scale, F.lit(0.0)), F.lit(1.0))


def scale_columns(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Scale every column that has a row in ``parameters``.

    The parameters are one row per column; they are read here and become
    literals, so applying them needs no join.
    """
    fitted = {r["feature"]: (r["center"], r["scale"]) for r in parameters.collect()}
    return df.withColumns(
        {name: scaled(F.col(name).cast("double"), *pair) for name, pair in fitted.items()}
    )


def unscaled(value: Column, center: float, scale: float) -> Column:
    return value * F.lit(scale if scale != 0 else 1.0) + F.lit(center)


def few_levels(df: DataFrame, column: str) -> list | None:
    """Sorted distinct values, or None when there are too many for a literal."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_LITERAL_LEVELS + 1)
    found = [r[0] for r in rows.collect()]
    return sorted(found) if len(found) <= MAX_LITERAL_LEVELS else None


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code)`` of all sorted distinct values, numbered without one big sort.

    The levels are range-partitioned and sorted within partitions; the codes of
    a partition start after the levels of the partitions before it. The sorted
    levels are written first, so a lost executor cannot renumber them.
    """
    levels = df.where(F.col(column).isNotNull()).select(column).distinct()
    spot = F.monotonically_increasing_id()
    placed = durable(
        levels.repartitionByRange(F.col(column)).sortWithinPartitions(column).select(
            column,
            F.shiftright(spot, 33).alias("part"),
            spot.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        )
    )
    # One row per partition: its number is bounded by the shuffle partitions.
    order = Window.orderBy("part")
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = starts.select("part", (F.sum("size").over(order) - F.col("size")).alias("start"))
    return placed.join(starts, "part").select(
        column, (F.col("start") + F.col("place")).cast("int").alias("code")
    )


def label_encode(
    df: DataFrame, column: str, levels: Sequence | DataFrame | None = None, unseen: int | None = None
) -> DataFrame:
    """Replace sorted distinct values by 0..k-1, and a value that is no level, or missing, by ``unseen``.

    ``levels`` is the sorted list, or a frame ``(column, code)``, which is
    joined; without it the levels are those of ``df``, at any number.
    """
    if levels is None:
        found = few_levels(df, column)
        levels = level_codes(df, column) if found is None else found
    other = F.lit(unseen).cast("int")
    if not isinstance(levels, DataFrame):
        codes = {level: code for code, level in enumerate(levels)}
        return df.withColumn(column, F.coalesce(lookup(F.col(column), codes).cast("int"), other))
    names = df.columns
    others = [n for n in names if n != column] or names
    coded = salted_join(df, levels.select(column, "code"), [column], others, "left")
    return coded.withColumn(column, F.coalesce(F.col("code").cast("int"), other)).select(*names)


def one_hot(df: DataFrame, column: str, levels: Sequence[str] | None) -> DataFrame:
    """One 0/1 column ``<column>_<level>`` per level in place of ``column``.

    A table gets no more than ``MAX_LITERAL_LEVELS`` such columns.
    """
    if levels is None or len(levels) > MAX_LITERAL_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LITERAL_LEVELS} levels, too many for a column each")
    flags = {
        f"{column}_{level}": F.when(F.col(column) == level, 1).otherwise(0) for level in levels
    }
    return df.withColumns(flags).drop(column)


def ordinal_encode(df: DataFrame, column: str, ranks: Mapping[str, int] | None = None) -> DataFrame:
    code = lookup(F.col(column), ranks) if ranks else assortment_rank(F.col(column))
    return df.withColumn(column, code)


def log_target(df: DataFrame, column: str = TARGET) -> DataFrame:
    return df.withColumn(column, F.log1p(F.col(column)))


def unlog(value: Column) -> Column:
    return F.expm1(value)


def cyclic_encoding(df: DataFrame, cycles: Mapping[str, int] = CYCLES) -> DataFrame:
    waves = {}
    for name, period in cycles.items():
        waves[f"{name}_sin"], waves[f"{name}_cos"] = cycle(F.col(name), period)
    return df.withColumns(waves)
