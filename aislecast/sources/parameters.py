"""Fitted scaler and encoder parameters as a small table and as a value."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels that are read as a list; a longer list stays a frame.
MAX_LISTED = 1000
COLUMNS = "feature string, method string, name string, value double"


@dataclass(frozen=True)
class Parameters:
    """What preparation needs: one center and scale per column, levels per encoder.

    ``levels`` has the sorted list of a feature, or for more than ``MAX_LISTED``
    levels a frame ``(feature, code)`` that stays distributed.
    """

    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, list[str] | DataFrame] = field(default_factory=dict)
    fills: dict[str, float] = field(default_factory=dict)

    @classmethod
    def from_table(cls, table: DataFrame) -> Parameters:
        """Read a parameter table: a few rows per feature, but for encoders of many levels."""
        scales: dict[str, dict[str, float]] = defaultdict(dict)
        levels: dict[str, dict[str, float]] = defaultdict(dict)
        fills: dict[str, float] = {}
        is_level = F.col("method") == "level"
        sizes = {r["feature"]: r["count"] for r in table.where(is_level).groupBy("feature").count().collect()}
        large = sorted(f for f, n in sizes.items() if n > MAX_LISTED)
        listed = table.where(~is_level | ~F.col("feature").isin(large)) if large else table
        for feature, method, name, value in listed.collect():
            if method in ("robust", "minmax"):
                scales[feature][name] = value
            elif method == "level":
                levels[feature][name] = value
            elif method == "fill":
                fills[feature] = value
        known: dict[str, list[str] | DataFrame] = {f: sorted(codes, key=codes.get) for f, codes in levels.items()}
        for feature in large:
            rows = table.where(is_level & (F.col("feature") == feature))
            known[feature] = rows.select(F.col("name").alias(feature), F.col("value").cast("int").alias("code"))
        return cls({f: (s["center"], s["scale"]) for f, s in scales.items()}, known, fills)


def save_parameters(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> Parameters:
    return Parameters.from_table(spark.read.schema(COLUMNS).parquet(path))
