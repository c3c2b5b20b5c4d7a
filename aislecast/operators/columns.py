"""Renaming, selecting, casting and describing columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FEATURES, snake_name


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def rename_snake(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_name(name) for name in df.columns])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def select_features(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The fixed feature list, in order, plus ``extra`` columns."""
    return df.select(*FEATURES, *extra)


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def long_values(df: DataFrame, columns: Sequence[str], name: str = "attribute") -> DataFrame:
    """``(name, value)`` rows of the given columns as doubles."""
    doubles = df.select([F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), name, "value")


def numeric_columns(df: DataFrame) -> DataFrame:
    return df.select(*numeric_names(df))


def text_columns(df: DataFrame) -> DataFrame:
    return df.select(*text_names(df))


def cast_integers(df: DataFrame, *names: str, strict: bool = True) -> DataFrame:
    """Cast to int; with ``strict=False`` text that is no number becomes NULL."""
    if strict:
        return df.withColumns({n: F.col(n).cast("int") for n in names})
    return df.withColumns({n: F.col(n).try_cast("int") for n in names})


def parse_dates(df: DataFrame, *names: str, fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Parse to dates; with ``strict=False`` what is no date becomes NULL."""
    read = F.to_date if strict else F.try_to_date
    return df.withColumns({n: read(n, fmt) if fmt else read(n) for n in names})


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")
    )


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: name, type and how many values are present."""
    types = dict(df.dtypes)
    counts = df.agg(*[F.count(F.col(n)).alias(n) for n in df.columns])
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(types[name]).alias("column_type"),
            F.col(name).alias("present"),
        )
        for name in df.columns
    ]
    return counts.select(F.inline(F.array(*rows)))


def names_difference(df: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Columns of ``df`` that are not in ``selected``: a question about the schema alone."""
    others = [(n,) for n in df.columns if n not in set(selected)]
    return df.sparkSession.createDataFrame(others, "feature string")
