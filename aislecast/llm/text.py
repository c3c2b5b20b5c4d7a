"""Small text helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z alone. Text without other letters takes the built-in function, which is faster."""
    only_ascii = F.length(value) == F.octet_length(value)
    return F.when(only_ascii, F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))


def with_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns; one of the same name in any case is replaced."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty one."""
    return [value or "" for value in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
