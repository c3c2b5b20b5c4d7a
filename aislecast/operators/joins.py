"""Joins of sales, stores and per-store results.

No join carries a broadcast hint: the store table can grow with the data, so
the choice is left to Spark, which broadcasts only below
``spark.sql.autoBroadcastJoinThreshold`` (checked again at run time by AQE) and
otherwise shuffles by store and splits skewed partitions. A sales table has one
row per store and day, so no store holds more rows than there are days.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import lookup
from ..functions.spreading import salted_join


def attach_store(sales: DataFrame, store: DataFrame, key: str = "Store") -> DataFrame:
    """Left join: every sales row with the columns of its store."""
    return sales.join(store, key, "left")


def join_metrics(*frames: DataFrame, key: str = "store") -> DataFrame:
    """Inner join of per-store results."""
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.join(frame, key, "inner")
    return joined


def attach_mean(
    df: DataFrame,
    value: str,
    name: str,
    key: str = "store",
    source: DataFrame | None = None,
    spread_by: str = "date",
) -> DataFrame:
    """Left join of the per-key mean of ``value``, taken from ``source`` or from ``df``.

    The mean is a map-side combined aggregate, so a key that holds much of the
    table adds one small row per task to the shuffle, which a window would not.
    The rows of such a key are dealt over several tasks by ``spread_by``.
    """
    base = df if source is None else source
    means = base.groupBy(key).agg(F.avg(value).alias(name))
    return salted_join(df, means, [key], [spread_by], "left", salts=8)


def map_lookup(df: DataFrame, name: str, key: Column, table: Mapping) -> DataFrame:
    return df.withColumn(name, lookup(key, table))
