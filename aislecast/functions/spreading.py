"""Joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of many ``rows`` with a frame of one (or few) rows per key.

    The rows of a key are dealt over ``salts`` partitions by a hash of
    ``spread_by``, and ``per_key`` is repeated for each of them. Every row still
    meets its partner exactly once. The hash depends on values only, so a task
    that runs again deals its rows the same way. Where ``per_key`` proves small
    at run time, AQE turns this into a broadcast join.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    left = rows.withColumn("_salt", salt)
    right = per_key.withColumn("_salt", every)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
