"""The sales, store and future tables derived from the given parquet tables.

Suppliers stand for stores and line items for sales; see FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet")


def store_panel(supplier: DataFrame) -> DataFrame:
    """One row per store."""
    return supplier.selectExpr(
        "s_suppkey AS Store",
        "substring('abcd', s_nationkey % 4 + 1, 1) AS StoreType",
        "substring('abc', CAST(s_suppkey % 3 + 1 AS INT), 1) AS Assortment",
        "IF(s_suppkey % 10 = 3, NULL, CAST(floor((s_acctbal + 1000) / 4) * 10 AS DOUBLE))"
        " AS CompetitionDistance",
        "IF(s_suppkey % 3 = 1, NULL, CAST(s_suppkey % 12 + 1 AS DOUBLE))"
        " AS CompetitionOpenSinceMonth",
        "IF(s_suppkey % 3 = 1, NULL, CAST(1990 + s_suppkey % 12 AS DOUBLE))"
        " AS CompetitionOpenSinceYear",
        "CAST(s_suppkey % 2 AS INT) AS Promo2",
        "IF(s_suppkey % 2 = 1, CAST(s_suppkey % 52 + 1 AS DOUBLE), NULL) AS Promo2SinceWeek",
        "IF(s_suppkey % 2 = 1, CAST(1995 + s_suppkey % 6 AS DOUBLE), NULL) AS Promo2SinceYear",
        "IF(s_suppkey % 2 = 1, element_at(array('Jan,Apr,Jul,Oct', 'Feb,May,Aug,Nov',"
        " 'Mar,Jun,Sept,Dec'), CAST(s_suppkey % 3 + 1 AS INT)), NULL) AS PromoInterval",
    )


def sales_panel(line: DataFrame, spread: bool = False) -> DataFrame:
    """One row per store and day.

    The distinct order count is the only two-step aggregate; Spark drops it
    from the plan wherever ``Customers`` is not used. ``spread`` deals the line
    items by store and day before they are grouped: most groups are single rows,
    so partial groups where they are read save nothing and spill on large tables.
    """
    rows = line.selectExpr(
        "l_suppkey AS Store",
        "CAST(l_shipdate AS DATE) AS Date",
        "l_orderkey",
        "l_quantity",
        "CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS amount",
    )
    if spread:
        rows = rows.repartition("Store", "Date")
    days = rows.groupBy("Store", "Date").agg(
        F.countDistinct("l_orderkey").alias("Customers"),
        F.max("l_quantity").alias("largest"),
        F.sum("amount").alias("amount"),
    )
    return days.selectExpr(
        "Store",
        "weekday(Date) + 1 AS DayOfWeek",
        "Date",
        "IF(largest < 5, 0L, amount) AS Sales",
        "Customers",
        "IF(largest < 5, 0, 1) AS Open",
        "IF(weekday(Date) < 5 AND weekofyear(Date) % 2 = 1, 1, 0) AS Promo",
        "CASE WHEN month(Date) * 100 + day(Date) IN (1225, 1226) THEN 'c'"
        " WHEN month(Date) * 100 + day(Date) IN (401, 402) THEN 'b'"
        " WHEN month(Date) * 100 + day(Date) IN (101, 501, 1003) THEN 'a'"
        " ELSE '0' END AS StateHoliday",
        "IF(month(Date) IN (7, 8), 1, 0) AS SchoolHoliday",
    )


def panel_last_date(line: DataFrame) -> dt.date:
    """Latest sales date, from the one date column of the line items."""
    return line.agg(F.max(F.col("l_shipdate").cast("date"))).first()[0]


def selling_stores(line: DataFrame, store: DataFrame) -> DataFrame:
    """Store rows that occur in the sales table."""
    keys = line.select(F.col("l_suppkey").alias("Store")).distinct()
    return store.join(keys, "Store", "left_semi")


def future_panel(sales: DataFrame, cutoff: dt.date) -> DataFrame:
    """Rows from the cutoff on, without sales; some stores have no open flag."""
    return sales.where(F.col("Date") >= F.lit(cutoff)).selectExpr(
        "Store * 100000 + datediff(Date, DATE'1995-01-01') AS Id",
        "Store",
        "DayOfWeek",
        "Date",
        "IF(Store % 7 = 5, NULL, Open) AS Open",
        "Promo",
        "StateHoliday",
        "SchoolHoliday",
    )
