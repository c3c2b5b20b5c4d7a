"""Forecast errors, business scenarios and time-ordered folds."""

from __future__ import annotations

import datetime as dt
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import money
from ..schemas import HORIZON_DAYS

_TINY = sys.float_info.epsilon


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat))


def mape(y: Column, yhat: Column) -> Column:
    """Absolute error over ``max(|y|, eps)``: large, not an error, where ``y`` is 0."""
    return F.avg(F.abs(y - yhat) / F.greatest(F.abs(y), F.lit(_TINY)))


def rmse(y: Column, yhat: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - yhat, F.lit(2.0))))


def error_columns_of(y: str, yhat: str) -> list[Column]:
    a, b = F.col(y).cast("double"), F.col(yhat)
    return [mae(a, b).alias("mae"), mape(a, b).alias("mape"), rmse(a, b).alias("rmse")]


def ml_error(df: DataFrame, model_name: str, y: str = "sales", yhat: str = "predictions") -> DataFrame:
    """One row ``(model_name, mae, mape, rmse)``."""
    return df.agg(*error_columns_of(y, yhat)).select(F.lit(model_name).alias("model_name"), "*")


def mean_percentage_error(df: DataFrame, y: str = "sales", yhat: str = "predictions") -> DataFrame:
    """Signed mean of ``(y - yhat) / y``; rows with ``y = 0`` are left out."""
    return df.agg(F.avg(F.try_divide(F.col(y) - F.col(yhat), F.col(y))).alias("mpe"))


def store_error(df: DataFrame, y: str = "sales", yhat: str = "predictions") -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(yhat)
    return df.groupBy("store").agg(mae(a, b).alias("mae"), mape(a, b).alias("mape"))


def store_scenarios(df: DataFrame, y: str = "sales", yhat: str = "predictions") -> DataFrame:
    """Predicted total per store, with the MAE as the worst and best case.

    One aggregate instead of three grouped results joined on the store.
    """
    a, b = F.col(y).cast("double"), F.col(yhat)
    per_store = df.groupBy("store").agg(
        F.sum(b).alias("predictions"), mae(a, b).alias("mae"), mape(a, b).alias("mape")
    )
    return per_store.select(
        "store",
        "predictions",
        (F.col("predictions") - F.col("mae")).alias("worst_scenario"),
        (F.col("predictions") + F.col("mae")).alias("best_scenario"),
        "mae",
        "mape",
    )


def scenario_totals(scenarios: DataFrame) -> DataFrame:
    names = ["predictions", "worst_scenario", "best_scenario"]
    sums = scenarios.agg(*[F.sum(n).alias(n) for n in names])
    long = sums.unpivot([], names, "scenario", "amount")
    return long.select("scenario", "amount", money(F.col("amount")).alias("values"))


def row_errors(df: DataFrame, y: str = "sales", yhat: str = "predictions") -> DataFrame:
    return df.withColumns(
        {
            "error": F.col(y) - F.col(yhat),
            "error_rate": F.try_divide(F.col(yhat), F.col(y)),
        }
    )


def fold_bounds(last: dt.date, k: int, days: int = HORIZON_DAYS) -> tuple[dt.date, dt.date]:
    """First and last validation day of fold ``k``, counted back from ``last``."""
    return last - dt.timedelta(days=k * days), last - dt.timedelta(days=(k - 1) * days)


def fold_split(
    df: DataFrame, last: dt.date, k: int, days: int = HORIZON_DAYS, date: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Training rows before fold ``k`` and its validation rows (both ends inclusive)."""
    start, end = fold_bounds(last, k, days)
    day = F.col(date)
    return df.where(day < F.lit(start)), df.where(day.between(F.lit(start), F.lit(end)))


def validation_folds(date: Column, last: dt.date, folds: int, days: int = HORIZON_DAYS) -> Column:
    """Array of the folds a row validates: one, two on a shared border day, or none.

    The folds are even steps back from ``last``, so membership is arithmetic on
    the date and needs no range join with a fold table.
    """
    back = F.datediff(F.lit(last), date)
    hits = [
        F.when(back.between((k - 1) * days, k * days), F.lit(k)) for k in range(1, folds + 1)
    ]
    return F.array_compact(F.array(*hits))


def cv_folds(df: DataFrame, last: dt.date, folds: int = 5, days: int = HORIZON_DAYS) -> DataFrame:
    """Dates and sizes of the training and validation part of each fold.

    Rows are counted by date first; the folds are taken from those counts.
    """
    by_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    date, n = F.col("date"), F.col("n")
    parts = []
    for k in range(1, folds + 1):
        start, end = (F.lit(d) for d in fold_bounds(last, k, days))
        train, valid = date < start, date.between(start, end)
        parts.append(
            F.struct(
                F.lit(k).alias("fold"),
                start.alias("validation_start"),
                end.alias("validation_end"),
                F.min(F.when(train, date)).alias("train_min"),
                F.max(F.when(train, date)).alias("train_max"),
                F.coalesce(F.sum(F.when(train, n)), F.lit(0)).alias("train_rows"),
                F.coalesce(F.sum(F.when(valid, n)), F.lit(0)).alias("validation_rows"),
            ).alias(f"fold_{k}")
        )
    names = [f"fold_{k}" for k in range(1, folds + 1)]
    return by_date.agg(*parts).select(F.inline(F.array(*names)))


def cv_summary(per_fold: DataFrame, by: str = "model_name") -> DataFrame:
    """Mean and population std over folds, as numbers and as ``m +/- s`` text."""
    parts, texts = [], []
    for name in ("mae", "mape", "rmse"):
        mean, std = F.avg(name), F.stddev_pop(name)
        parts += [mean.alias(f"{name}_mean"), std.alias(f"{name}_std")]
        texts.append(
            F.concat_ws(
                " +/- ",
                F.round(f"{name}_mean", 2).cast("string"),
                F.round(f"{name}_std", 2).cast("string"),
            ).alias(f"{name}_cv")
        )
    return per_fold.groupBy(by).agg(*parts).select("*", *texts)
