"""Sums, means, counts, pivots and bins behind the business questions.

Every operator is one ``groupBy`` whose partial sums are combined before the
shuffle, so a value that holds a third of the rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import HOLIDAY_OTHERWISE, TARGET


def total_by(df: DataFrame, *keys: str, value: str = TARGET) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def mean_by(df: DataFrame, *keys: str, value: str = TARGET, name: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name or value))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distance_bin(distance: Column, width: int = 1000, bins: int = 19) -> Column:
    """Number of the right-closed interval; NULL outside ``(0, width*bins]``."""
    number = F.ceil(distance / width).cast("int")
    return F.when(number.between(1, bins), number)


def bin_label(number: Column, width: int = 1000) -> Column:
    return F.format_string("(%d, %d]", (number - 1) * width, number * width)


def total_by_distance(df: DataFrame) -> DataFrame:
    return total_by(df, "competition_distance")


def total_by_distance_bin(df: DataFrame, width: int = 1000, bins: int = 19) -> DataFrame:
    """Sum of sales for each interval, 0 for an empty one.

    Sums of all bins come from one aggregate row, which is then turned into
    one row per bin, so that empty bins need no join.
    """
    number = distance_bin(F.col("competition_distance"), width, bins)
    per_bin = df.groupBy(number.alias("distance_bin")).agg(F.sum(TARGET).alias(TARGET))
    sums = [
        F.coalesce(F.sum(F.when(F.col("distance_bin") == b, F.col(TARGET))), F.lit(0))
        for b in range(1, bins + 1)
    ]
    rows = [
        F.struct(F.lit(b).alias("distance_bin"), F.col(f"b{b}").alias(TARGET))
        for b in range(1, bins + 1)
    ]
    wide = per_bin.agg(*[s.alias(f"b{b}") for b, s in enumerate(sums, start=1)])
    long = wide.select(F.inline(F.array(*rows)))
    return long.withColumn("interval", bin_label(F.col("distance_bin"), width))


def total_by_competition_months(df: DataFrame, limit: int = 120) -> DataFrame:
    months = F.col("competition_time_month")
    return total_by(df.where((months < limit) & (months != 0)), "competition_time_month")


def total_by_promo_weeks(df: DataFrame) -> DataFrame:
    """Weeks after (extended) and before (regular) the start; week 0 is in neither."""
    weeks = F.col("promo_time_week")
    phase = F.when(weeks > 0, "extended").when(weeks < 0, "regular")
    return total_by(df.where(weeks != 0), "promo_time_week").withColumn("phase", phase)


def weekly_promo_compare(df: DataFrame) -> DataFrame:
    """Weekly sales on promotion days with and without the extended promotion."""
    promo = df.where(F.col("promo") == 1)
    return promo.groupBy("year_week").agg(
        F.sum(F.when(F.col("promo2") == 1, F.col(TARGET))).alias("traditional_and_extended"),
        F.sum(F.when(F.col("promo2") == 0, F.col(TARGET))).alias("traditional"),
    )


def total_by_holiday(df: DataFrame, *keys: str) -> DataFrame:
    special = df.where(F.col("state_holiday") != HOLIDAY_OTHERWISE)
    return total_by(special, *keys, "state_holiday")


def half_year(month: Column) -> Column:
    return F.when(month > 6, "H2").otherwise("H1")


def total_by_half_year(df: DataFrame) -> DataFrame:
    return total_by(df.withColumn("half", half_year(F.col("month"))), "half")


def tenth_side(day: Column) -> Column:
    return F.when(day <= 10, "before_10_days").otherwise("after_10_days")


def total_around_tenth(df: DataFrame) -> DataFrame:
    return total_by(df.withColumn("before_after", tenth_side(F.col("day"))), "before_after")


def pivot_totals(
    df: DataFrame, row: str, column: str, levels: Sequence[str], value: str = TARGET
) -> DataFrame:
    """Wide sums; a missing cell is NULL. Explicit levels spare Spark a second pass."""
    return df.groupBy(row).pivot(column, list(levels)).agg(F.sum(value))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    counts = df.groupBy(row).pivot(column, list(levels)).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def totals_per_key(df: DataFrame, keys: Sequence[str], value: str = TARGET) -> DataFrame:
    """Sums by each key on its own, as ``(attribute, key, value)``, in one pass."""
    narrow = df.select(value, *[F.col(k).cast("double").alias(k) for k in keys])
    long = narrow.unpivot([value], list(keys), "attribute", "key")
    return long.groupBy("attribute", "key").agg(F.sum(value).alias(value))


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column some frame lacks is NULL there."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked
