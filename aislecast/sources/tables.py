"""Reading the sales, store and future tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FUTURE, SALES, STORE


REFUSED = "_refused_line"


def csv_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line of CSV files with a header, and ``_refused_line``: the line itself if a cell could not be read.

    The schema is fixed: no inference pass over the data.
    """
    held = T.StructType([*schema.fields, T.StructField(REFUSED, T.StringType())])
    reader = spark.read.schema(held).option("header", True).option("enforceSchema", False)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REFUSED)
    rows = reader.option("dateFormat", "yyyy-MM-dd").csv(path)
    # True of every row, but it needs all cells: else those that a query leaves out would not be read.
    return rows.where(F.length(F.concat_ws("", *[F.col(n).cast("string") for n in schema.names])) >= 0)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of CSV files that could be read in full; the others are in ``refused_csv``."""
    return csv_lines(spark, path, schema).where(F.col(REFUSED).isNull()).drop(REFUSED)


def refused_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(line)``: the lines that ``read_csv`` leaves out. Lines read and refused are all lines but the headers."""
    odd = csv_lines(spark, path, schema).where(F.col(REFUSED).isNotNull())
    return odd.select(F.col(REFUSED).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


_READERS = {"csv": read_csv, "parquet": read_parquet}


def read_sales(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return _READERS[kind](spark, path, SALES)


def read_store(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return _READERS[kind](spark, path, STORE)


def read_future(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return _READERS[kind](spark, path, FUTURE)


def write_by_month(df: DataFrame, path: str, date: str = "Date") -> None:
    """Write a sales table partitioned by year and month, so date filters skip folders."""
    dated = df.withColumns(
        {"sales_year": F.year(date), "sales_month": F.month(date)}
    )
    dated.write.partitionBy("sales_year", "sales_month").parquet(path)


def rows_since(months: DataFrame, since: DataFrame, until: dt.date, key: str = "Store", date: str = "Date") -> DataFrame:
    """Rows of a table written by month, from each key's own day up to ``until``.

    ``since`` is ``(key, since)``. The months from the first of these days on
    are known at run time alone; joined to the table's folders they prune those
    that no key needs before they are read.
    """
    month = F.trunc("since", "month")
    known = since.where(F.col("since") <= F.lit(until)).select(month.alias("first")).distinct()
    every = F.explode(F.sequence("first", F.trunc(F.lit(until), "month"), F.expr("INTERVAL 1 MONTH"))).alias("month")
    needed = known.select(every).select(F.year("month").alias("sales_year"), F.month("month").alias("sales_month")).distinct()
    rows = months.join(needed, ["sales_year", "sales_month"])
    return rows.join(since, key).where(F.col(date).between(F.col("since"), F.lit(until)))
