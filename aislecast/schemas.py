"""Table schemas and the fixed values every layer shares."""

from __future__ import annotations

import re

from pyspark.sql import types as T


def snake_name(name: str) -> str:
    """``Promo2SinceWeek`` -> ``promo2_since_week``."""
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"([a-z\d])([A-Z])", r"\1_\2", name)
    return name.replace("-", "_").lower()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_LONG, _INT, _DOUBLE, _TEXT, _DATE = (
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.StringType(),
    T.DateType(),
)

SALES = _schema(
    ("Store", _LONG),
    ("DayOfWeek", _INT),
    ("Date", _DATE),
    ("Sales", _LONG),
    ("Customers", _LONG),
    ("Open", _INT),
    ("Promo", _INT),
    ("StateHoliday", _TEXT),
    ("SchoolHoliday", _INT),
)

STORE = _schema(
    ("Store", _LONG),
    ("StoreType", _TEXT),
    ("Assortment", _TEXT),
    ("CompetitionDistance", _DOUBLE),
    ("CompetitionOpenSinceMonth", _DOUBLE),
    ("CompetitionOpenSinceYear", _DOUBLE),
    ("Promo2", _INT),
    ("Promo2SinceWeek", _DOUBLE),
    ("Promo2SinceYear", _DOUBLE),
    ("PromoInterval", _TEXT),
)

FUTURE = T.StructType(
    [T.StructField("Id", _LONG, True)]
    + [f for f in SALES.fields if f.name not in ("Sales", "Customers")]
)

# One scoring record: a future row (without Id) joined with its store.
RECORD = T.StructType(
    [f for f in FUTURE.fields if f.name != "Id"]
    + [f for f in STORE.fields if f.name != "Store"]
)

# Engine names of the joined table: sales columns, then store columns.
JOINED_COLUMNS = [snake_name(n) for n in SALES.names + STORE.names if n != "Store"]
JOINED_COLUMNS.insert(0, "store")

HORIZON_DAYS = 42

# --- Fixed values (must equal the specification for equal results) -----------
MONTH_NAMES = {
    1: "Jan", 2: "Fev", 3: "Mar", 4: "Apr", 5: "May", 6: "Jun",
    7: "Jul", 8: "Aug", 9: "Sep", 10: "Oct", 11: "Nov", 12: "Dec",
}
# The same map with the English February, for data that spell it ``Feb``.
ENGLISH_MONTH_NAMES = {**MONTH_NAMES, 2: "Feb"}

ASSORTMENT_NAMES = {"a": "basic", "b": "extra"}
ASSORTMENT_OTHERWISE = "extended"
ASSORTMENT_RANK = {"basic": 1, "extra": 2, "extended": 3}

HOLIDAY_NAMES = {"a": "public_holiday", "b": "easter_holiday", "c": "christmas"}
HOLIDAY_OTHERWISE = "regular_day"

SERVING_DISTANCE = 200000.0

CYCLES = {"day_of_week": 7, "month": 12, "day": 30, "week_of_year": 52}

FEATURES = [
    "store",
    "promo",
    "store_type",
    "assortment",
    "competition_distance",
    "competition_open_since_month",
    "competition_open_since_year",
    "promo2",
    "promo2_since_week",
    "promo2_since_year",
    "competition_time_month",
    "promo_time_week",
    "day_of_week_sin",
    "day_of_week_cos",
    "month_sin",
    "month_cos",
    "day_sin",
    "day_cos",
    "week_of_year_sin",
    "week_of_year_cos",
]
# --- end of fixed values -----------------------------------------------------

TARGET = "sales"
