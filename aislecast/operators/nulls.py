"""Counting and filling missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of NULLs; one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in df.columns])
    return counts.unpivot([], df.columns, "attribute", "nulls")


def ten_times_max(df: DataFrame, column: str) -> Column:
    """10 x the column's maximum, evaluated once as a scalar subquery."""
    return df.agg((F.max(column) * 10).alias("fill")).scalar()


def fill(df: DataFrame, column: str, value: Column | float) -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(column, F.coalesce(F.col(column), value))


def fill_max10(df: DataFrame, column: str) -> DataFrame:
    return fill(df, column, ten_times_max(df, column))


def fill_from_date(df: DataFrame, date: str = "date") -> DataFrame:
    """Missing competition and promotion starts take the row's own date.

    The week is the ISO week and the year the calendar year, so the two can
    disagree around New Year; that is the specified behaviour.
    """
    d = F.col(date)
    parts = {
        "competition_open_since_month": F.month(d),
        "competition_open_since_year": F.year(d),
        "promo2_since_week": F.weekofyear(d),
        "promo2_since_year": F.year(d),
    }
    return df.withColumns(
        {name: F.coalesce(F.col(name), part.cast("double")) for name, part in parts.items()}
    )
