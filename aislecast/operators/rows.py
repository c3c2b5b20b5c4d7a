"""Row filters, date splits, first rows, top rows and samples."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import HORIZON_DAYS


def not_closed(open_flag: str = "open") -> Column:
    """``open != 0`` where a missing flag counts as open."""
    return ~F.col(open_flag).eqNullSafe(0)


def open_with_sales(df: DataFrame) -> DataFrame:
    return df.where(not_closed() & (F.col("sales") > 0))


def open_rows(df: DataFrame, open_flag: str = "open") -> DataFrame:
    return df.where(not_closed(open_flag))


def holiday_sales(df: DataFrame) -> DataFrame:
    return df.where((F.col("state_holiday") != "0") & (F.col("sales") > 0))


def members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def present(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def last_date(df: DataFrame, date: str = "date") -> dt.date:
    """Latest date of the table: one aggregate, one value on the driver."""
    return df.agg(F.max(date)).first()[0]


def holdout_start(last: dt.date, days: int = HORIZON_DAYS) -> dt.date:
    return last - dt.timedelta(days=days)


def split_by_date(
    df: DataFrame, cutoff: dt.date, date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Rows before ``cutoff`` and rows from it on.

    The cutoff is a literal, so both filters reach the file scan.
    """
    return df.where(F.col(date) < F.lit(cutoff)), df.where(F.col(date) >= F.lit(cutoff))


def cutoff_by_store(df: DataFrame, days: int = HORIZON_DAYS) -> DataFrame:
    latest = df.groupBy("store").agg(F.max("date").alias("last_date"))
    return latest.withColumn("cutoff", F.date_sub("last_date", days))


def head_rows(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def top_rows(df: DataFrame, by: str, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` largest rows by ``by``; ``keys`` break ties."""
    return df.orderBy(F.desc_nulls_last(by), *keys).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42, numbers: Sequence[Column] | None = None) -> DataFrame:
    """``n`` rows in random order.

    Ordering by a seeded hash of the row gives the same sample however the
    table is partitioned, also when a task runs again. ``numbers`` are integer
    expressions that tell the rows apart: the order is then plain arithmetic on
    them, which any engine repeats.
    """
    if numbers:
        return df.orderBy(scattered(numbers, seed), *numbers).limit(n)
    mark = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    return df.orderBy(mark).limit(n)


# A prime below 2**31 and multipliers: products stay below 2**63.
_PRIME, _FACTORS = 2_147_483_647, (48_271, 69_621, 16_807)


def scattered(numbers: Sequence[Column], seed: int) -> Column:
    """A pseudo-random number of integer columns, by linear steps modulo a prime."""
    mark = F.lit(seed).cast("long")
    for i, number in enumerate(numbers):
        mark = F.pmod((mark + number.cast("long")) * _FACTORS[i % 3], F.lit(_PRIME))
    return F.pmod(mark * 40_014 + 12_345, F.lit(_PRIME))


def sample_share(df: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A share of the rows, for samples too large to sort."""
    return df.sample(fraction=share, seed=seed)
