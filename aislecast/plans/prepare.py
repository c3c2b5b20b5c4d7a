"""Raw joined table -> cleaned -> features -> model-ready rows.

Every step is a pure function of a DataFrame and of parameters that were fitted
before. None of them fits anything, so a batch of one record, a stream and the
training table get the same values.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.encode import (
    assortment_name,
    holiday_name,
    listed,
    month_abbreviation,
)
from ..operators import scaling
from ..operators.columns import cast_integers, parse_dates, rename_snake
from ..operators.nulls import fill, fill_from_date
from ..operators.rows import open_rows, open_with_sales
from ..schemas import JOINED_COLUMNS, MONTH_NAMES, SERVING_DISTANCE, TARGET
from ..session import held
from ..sources.parameters import COLUMNS, Parameters

ROBUST = ["competition_distance", "competition_time_month"]
MINMAX = ["promo_time_week", "year"]
LABELLED = "store_type"
ONE_HOT = "state_holiday"
# Code of a label that is missing or was not there when the levels were fitted.
UNSEEN = -1
STARTS = [
    "competition_open_since_month",
    "competition_open_since_year",
    "promo2_since_week",
    "promo2_since_year",
]


def clean(
    df: DataFrame,
    distance_fill: Column | float | None = SERVING_DISTANCE,
    month_names: Mapping[int, str] = MONTH_NAMES,
) -> DataFrame:
    """Parse dates, fill missing values, mark promotion months, cast to int.

    ``distance_fill=None`` leaves missing distances as they are.
    """
    df = parse_dates(df, "date", strict=False)
    if distance_fill is not None:
        df = fill(df, "competition_distance", distance_fill)
    df = fill_from_date(fill(df, "promo2", 0))
    df = df.withColumn("month_map", month_abbreviation(F.col("date"), month_names))
    df = df.withColumn("is_promo", listed(F.col("month_map"), F.col("promo_interval")))
    return cast_integers(df, *STARTS, strict=False)


def calendar_features(df: DataFrame) -> DataFrame:
    """What follows from the sales columns alone, also before a store is joined."""
    date = F.col("date")
    return df.withColumns(
        {
            **dates.date_parts(date),
            "year_week": dates.year_week(date),
            "state_holiday": holiday_name(F.col("state_holiday")),
        }
    )


def add_features(df: DataFrame) -> DataFrame:
    """Calendar parts, time since competition and promotion began, decoded names."""
    date = F.col("date")
    df = calendar_features(df).withColumns(
        {
            "competition_since": dates.month_start(
                F.col("competition_open_since_year"), F.col("competition_open_since_month")
            ),
            "promo_since": dates.week_before(F.col("promo2_since_year"), F.col("promo2_since_week")),
            "assortment": assortment_name(F.col("assortment")),
        }
    )
    return df.withColumns(
        {
            "competition_time_month": dates.whole_periods(date, F.col("competition_since"), 30),
            "promo_time_week": dates.whole_periods(date, F.col("promo_since"), 7),
        }
    )


def training_rows(df: DataFrame) -> DataFrame:
    """Open days with sales, without columns unknown at forecast time."""
    return open_with_sales(df).drop("customers", "open", "promo_interval", "month_map")


def scoring_rows(df: DataFrame) -> DataFrame:
    return open_rows(df).drop("open", "promo_interval", "month_map")


def fit_parameters(training: DataFrame, distance_fill: DataFrame | None = None) -> DataFrame:
    """Fit every scaler and encoder: ``(feature, method, name, value)``.

    ``training`` holds ``training_rows``; ``distance_fill`` is a one-row frame
    ``(value)`` kept along with the scalers for filling new records. Ranges are
    one aggregate, and only the two columns with quartiles have their values
    counted. An encoder's levels are numbered without limit.
    """
    with held(training.select(*ROBUST, *MINMAX, LABELLED, ONE_HOT)) as kept:
        parts = [
            _scale_rows(scaling.robust_parameters(kept, ROBUST), "robust"),
            _scale_rows(scaling.minmax_parameters(kept, MINMAX), "minmax"),
        ]
        if distance_fill is not None:
            parts.append(
                distance_fill.select(
                    F.lit("competition_distance").alias("feature"),
                    F.lit("fill").alias("method"),
                    F.lit("value").alias("name"),
                    F.col("value").cast("double").alias("value"),
                )
            )
        rows = [tuple(r) for r in reduce(DataFrame.unionByName, parts).collect()]
        large = []
        for feature in (LABELLED, ONE_HOT):
            levels = scaling.few_levels(kept, feature)
            if levels is None:
                # Written by level_codes, so it outlives the held rows.
                large.append((feature, scaling.level_codes(kept, feature)))
            else:
                rows += [(feature, "level", name, float(i)) for i, name in enumerate(levels)]
        table = training.sparkSession.createDataFrame(rows, COLUMNS)
        for feature, codes in large:
            table = table.unionByName(
                codes.select(
                    F.lit(feature).alias("feature"),
                    F.lit("level").alias("method"),
                    F.col(feature).alias("name"),
                    F.col("code").cast("double").alias("value"),
                )
            )
    return table


def _scale_rows(fitted: DataFrame, method: str) -> DataFrame:
    long = fitted.unpivot("feature", ["center", "scale"], "name", "value")
    return long.select("feature", F.lit(method).alias("method"), "name", "value")


def prepare(df: DataFrame, parameters: Parameters) -> DataFrame:
    """Scale, encode and transform with saved parameters."""
    df = df.withColumns(
        {
            name: scaling.scaled(F.col(name).cast("double"), *parameters.scales[name])
            for name in ROBUST + MINMAX
        }
    )
    names = parameters.levels[ONE_HOT]
    df = scaling.one_hot(df, ONE_HOT, None if isinstance(names, DataFrame) else names)
    df = scaling.label_encode(df, LABELLED, parameters.levels[LABELLED], UNSEEN)
    df = scaling.ordinal_encode(df, "assortment")
    if TARGET in df.columns:
        df = scaling.log_target(df)
    return scaling.cyclic_encoding(df)


def model_rows(df: DataFrame) -> DataFrame:
    """Drop the columns that the cyclic pairs and spans have replaced."""
    return df.drop(
        "week_of_year", "day", "month", "day_of_week", "promo_since", "competition_since", "year_week"
    )


def training_features(raw: DataFrame, distance_fill: Column | float) -> DataFrame:
    """Joined sales table (18 columns, any names) -> rows for exploration and fitting."""
    named = raw.toDF(*JOINED_COLUMNS)
    return training_rows(add_features(clean(named, distance_fill)))


def record_features(
    records: DataFrame,
    parameters: Parameters,
    month_names: Mapping[int, str] = MONTH_NAMES,
) -> DataFrame:
    """New records (CamelCase) -> model-ready rows; closed days are left out."""
    distance = parameters.fills.get("competition_distance", SERVING_DISTANCE)
    named = rename_snake(records)
    return prepare(scoring_rows(add_features(clean(named, distance, month_names))), parameters)
