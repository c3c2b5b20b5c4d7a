"""Sales totals behind the business questions, and error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import errors, rows, totals
from ..plans import models
from ..plans.forecast import forecast_message as add_message
from ..session import work_path
from ..sources.tables import rows_since, write_by_month
from .base_sql import sql
from .frames import Frames
from .registry import query, rounded

ASSORTMENTS = ["basic", "extended", "extra"]
STORE_TYPES = ["a", "b", "c", "d"]
# Keys of the sales table: their totals need no join with the stores.
SALES_KEYS = {"year", "month", "day", "day_of_week", "school_holiday", "state_holiday", "year_week"}

_SUM = "CAST(sum(sales) AS BIGINT) AS sales"


def _total_sql(*keys: str, where: str = "") -> str:
    names = ", ".join(keys)
    return sql("train", f"SELECT {names}, {_SUM} FROM train {where} GROUP BY {names}")


def _register_total(name: str, *keys: str) -> None:
    @query(name, _total_sql(*keys))
    def build(f: Frames) -> DataFrame:
        if SALES_KEYS.issuperset(keys):
            return totals.total_by(f.sales_days, *keys)
        rows_of = f.training if "competition_distance" in keys else f.open_days
        return totals.total_by(rows_of, *keys)


_register_total("sales_by_assortment", "assortment")
_register_total("sales_by_week_assortment", "year_week", "assortment")
_register_total("sales_by_competition_distance", "competition_distance")
_register_total("sales_by_promo_pair", "promo", "promo2")
_register_total("sales_by_year", "year")
_register_total("sales_by_day", "day")
_register_total("sales_by_weekday", "day_of_week")
_register_total("sales_by_school_holiday", "school_holiday")
_register_total("sales_by_month_school_holiday", "month", "school_holiday")


_BIN = "CAST(ceil(competition_distance / 1000) AS INTEGER)"
_BINS_SQL = f"""
SELECT CAST(b AS INTEGER) AS distance_bin, CAST(coalesce(sum(t.sales), 0) AS BIGINT) AS sales,
  '(' || CAST((b - 1) * 1000 AS VARCHAR) || ', ' || CAST(b * 1000 AS VARCHAR) || ']' AS interval
FROM range(1, 20) r(b) LEFT JOIN train t
  ON t.competition_distance > (b - 1) * 1000 AND t.competition_distance <= b * 1000
GROUP BY b
"""


@query("sales_by_distance_bin", sql("train", _BINS_SQL))
def sales_by_distance_bin(f: Frames) -> DataFrame:
    return totals.total_by_distance_bin(f.training)


@query(
    "bin_distance",
    sql(
        "train",
        f"""SELECT store, date, competition_distance,
          CASE WHEN {_BIN} BETWEEN 1 AND 19 THEN {_BIN} END AS distance_bin FROM train""",
    ),
)
def bin_distance(f: Frames) -> DataFrame:
    kept = f.training.select("store", "date", "competition_distance")
    return kept.withColumn("distance_bin", totals.distance_bin(F.col("competition_distance")))


@query(
    "sales_by_competition_months",
    _total_sql(
        "competition_time_month",
        where="WHERE competition_time_month < 120 AND competition_time_month <> 0",
    ),
)
def sales_by_competition_months(f: Frames) -> DataFrame:
    return totals.total_by_competition_months(f.open_days)


@query(
    "sales_by_promo_weeks",
    sql(
        "train",
        f"""SELECT promo_time_week, {_SUM},
          CASE WHEN promo_time_week > 0 THEN 'extended' ELSE 'regular' END AS phase
        FROM train WHERE promo_time_week <> 0 GROUP BY promo_time_week""",
    ),
)
def sales_by_promo_weeks(f: Frames) -> DataFrame:
    return totals.total_by_promo_weeks(f.open_days)


@query(
    "weekly_promo_compare",
    sql(
        "train",
        """SELECT year_week,
          CAST(sum(sales) FILTER (promo2 = 1) AS BIGINT) AS traditional_and_extended,
          CAST(sum(sales) FILTER (promo2 = 0) AS BIGINT) AS traditional
        FROM train WHERE promo = 1 GROUP BY year_week""",
    ),
)
def weekly_promo_compare(f: Frames) -> DataFrame:
    return totals.weekly_promo_compare(f.open_days)


@query(
    "sales_by_holiday", _total_sql("state_holiday", where="WHERE state_holiday <> 'regular_day'")
)
def sales_by_holiday(f: Frames) -> DataFrame:
    return totals.total_by_holiday(f.sales_days)


@query(
    "sales_by_year_holiday",
    _total_sql("year", "state_holiday", where="WHERE state_holiday <> 'regular_day'"),
)
def sales_by_year_holiday(f: Frames) -> DataFrame:
    return totals.total_by_holiday(f.sales_days, "year")


@query(
    "sales_by_half_year",
    sql(
        "train",
        f"SELECT CASE WHEN month > 6 THEN 'H2' ELSE 'H1' END AS half, {_SUM} FROM train GROUP BY 1",
    ),
)
def sales_by_half_year(f: Frames) -> DataFrame:
    return totals.total_by_half_year(f.sales_days)


@query(
    "sales_before_after_10th",
    sql(
        "train",
        f"""SELECT CASE WHEN day <= 10 THEN 'before_10_days' ELSE 'after_10_days' END
          AS before_after, {_SUM} FROM train GROUP BY 1""",
    ),
)
def sales_before_after_10th(f: Frames) -> DataFrame:
    return totals.total_around_tenth(f.sales_days)


@query(
    "mean_by_store",
    sql("train", "SELECT store, round(avg(ln(1 + sales)), 6) AS predictions FROM train GROUP BY store"),
)
def mean_by_store(f: Frames) -> DataFrame:
    return rounded(totals.mean_by(f.log_sales, "store", name="predictions"))


@query(
    "cutoff_by_store",
    sql(
        "train",
        "SELECT store, max(date) AS last_date, max(date) - 42 AS cutoff FROM train GROUP BY store",
    ),
)
def cutoff_by_store(f: Frames) -> DataFrame:
    return rows.cutoff_by_store(f.sales_days.select("store", "date"))


@query(
    "sales_since_cutoff",
    sql(
        "train",
        "SELECT r.\"Store\" AS store, CAST(count(*) AS BIGINT) AS days, CAST(sum(r.\"Sales\") AS BIGINT) AS sales "
        "FROM sales_t r JOIN (SELECT store, max(date) - 42 AS cutoff FROM train GROUP BY store) c "
        "ON r.\"Store\" = c.store AND r.\"Date\" >= c.cutoff GROUP BY 1",
    ),
)
def sales_since_cutoff(f: Frames) -> DataFrame:
    """Every store's rows from its own cutoff on, read from the month folders that any store needs."""
    path = work_path(f.spark, "months")
    write_by_month(f.sales, path)
    cutoffs = rows.cutoff_by_store(f.sales_days.select("store", "date"))
    since = cutoffs.select(F.col("store").alias("Store"), F.col("cutoff").alias("since"))
    recent = rows_since(f.spark.read.parquet(path), since, f.last)
    return recent.groupBy(F.col("Store").alias("store")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("Sales").alias("sales")
    )


@query("distinct_values", sql("train", "SELECT DISTINCT state_holiday FROM train"))
def distinct_values(f: Frames) -> DataFrame:
    return totals.distinct_values(f.sales_days, "state_holiday")


_PIVOT_SQL = (
    "SELECT year_week, "
    + ", ".join(
        f"CAST(sum(sales) FILTER (assortment = '{a}') AS BIGINT) AS {a}" for a in ASSORTMENTS
    )
    + " FROM train GROUP BY year_week"
)


@query("pivot_week_assortment", sql("train", _PIVOT_SQL))
def pivot_week_assortment(f: Frames) -> DataFrame:
    return totals.pivot_totals(f.open_days, "year_week", "assortment", ASSORTMENTS)


@query(
    "pivot_week_extra",
    sql(
        "train",
        f"SELECT year_week, {_SUM.replace('AS sales', 'AS extra')} FROM train "
        "WHERE assortment = 'extra' GROUP BY year_week",
    ),
)
def pivot_week_extra(f: Frames) -> DataFrame:
    extra = f.open_days.where(F.col("assortment") == "extra")
    return totals.pivot_totals(extra, "year_week", "assortment", ["extra"])


_CROSS_SQL = (
    "SELECT state_holiday, "
    + ", ".join(f"count(*) FILTER (store_type = '{t}') AS {t}" for t in STORE_TYPES)
    + " FROM train GROUP BY state_holiday"
)


@query("crosstab_holiday_storetype", sql("train", _CROSS_SQL))
def crosstab_holiday_storetype(f: Frames) -> DataFrame:
    return totals.crosstab(f.open_days, "state_holiday", "store_type", STORE_TYPES)


@query(
    "category_counts",
    sql(
        "train",
        """SELECT 'state_holiday' AS attribute, state_holiday AS level, count(*) AS n
          FROM train WHERE state_holiday <> 'regular_day' GROUP BY 2
        UNION ALL SELECT 'store_type', store_type, count(*) FROM train GROUP BY 2
        UNION ALL SELECT 'assortment', assortment, count(*) FROM train GROUP BY 2""",
    ),
)
def category_counts(f: Frames) -> DataFrame:
    """All three counts from one pass; regular days are not charted."""
    names = ["state_holiday", "store_type", "assortment"]
    long = f.open_days.select(*names).unpivot([], names, "attribute", "level")
    return totals.count_by(long.where(F.col("level") != "regular_day"), "attribute", "level")


@query(
    "split_date_range",
    sql(
        "train",
        """SELECT CASE WHEN date < (SELECT max(date) FROM raw) - 42 THEN 'train' ELSE 'test' END
          AS part, min(date) AS first_date, max(date) AS last_date FROM train GROUP BY 1""",
    ),
)
def split_date_range(f: Frames) -> DataFrame:
    """Both ranges from one pass over the training rows."""
    part = F.when(F.col("date") < F.lit(f.cutoff), "train").otherwise("test")
    return f.sales_days.groupBy(part.alias("part")).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


@query(
    "head_rows",
    sql(
        "train",
        f"""SELECT year_week, assortment, {_SUM} FROM train
        GROUP BY year_week, assortment ORDER BY year_week, assortment LIMIT 5""",
    ),
)
def head_rows(f: Frames) -> DataFrame:
    weekly = totals.total_by(f.open_days, "year_week", "assortment")
    return rows.head_rows(weekly, ["year_week", "assortment"])


_DAY = "date_diff('day', DATE '1990-01-01', date)"


@query(
    "sample_rows",
    sql(
        "raw",
        f"""SELECT * EXCLUDE (mark) FROM (
          SELECT *, (((((42 + store) * 48271) % 2147483647 + {_DAY}) * 69621) % 2147483647 * 40014 + 12345)
            % 2147483647 AS mark FROM raw)
        ORDER BY mark, store, date LIMIT 5""",
    ),
)
def sample_rows(f: Frames) -> DataFrame:
    """Five rows of the joined table, by an order of store and day that both engines compute."""
    day = F.datediff("date", F.lit("1990-01-01").cast("date"))
    return rows.sample_rows(f.raw, 5, numbers=[F.col("store"), day])


# --- errors of the average model ---------------------------------------------
def errors_sql(digits: int) -> str:
    return f"""round(avg(abs(sales - predictions)), {digits}) AS mae,
  round(avg(abs(sales - predictions) / greatest(abs(sales), 2.220446049250313e-16)), {digits}) AS mape,
  round(sqrt(avg(pow(sales - predictions, 2))), {digits}) AS rmse"""


_ERRORS = errors_sql(6)


@query("ml_error", sql("scored", f"SELECT 'Average Model' AS model_name, {_ERRORS} FROM scored"))
def ml_error(f: Frames) -> DataFrame:
    return rounded(errors.ml_error(f.scored_by_average(), "Average Model"))


@query(
    "mean_percentage_error",
    sql("scored", "SELECT round(avg((sales - predictions) / sales), 6) AS mpe FROM scored"),
)
def mean_percentage_error(f: Frames) -> DataFrame:
    return rounded(errors.mean_percentage_error(f.scored_by_average()))


_STORE_ERRORS = """SELECT store, sum(predictions) AS predictions,
  avg(abs(sales - predictions)) AS mae,
  avg(abs(sales - predictions) / greatest(abs(sales), 2.220446049250313e-16)) AS mape
  FROM scored GROUP BY store"""


@query(
    "store_error",
    sql("scored", f"SELECT store, round(mae, 4) AS mae, round(mape, 4) AS mape FROM ({_STORE_ERRORS})"),
)
def store_error(f: Frames) -> DataFrame:
    return rounded(errors.store_error(f.scored_by_average()), 4)


_SCENARIOS = f"""SELECT store, round(predictions, 4) AS predictions,
  round(predictions - mae, 4) AS worst_scenario, round(predictions + mae, 4) AS best_scenario,
  round(mae, 4) AS mae, round(mape, 4) AS mape FROM ({_STORE_ERRORS})"""


@query("store_scenarios", sql("scored", _SCENARIOS))
def store_scenarios(f: Frames) -> DataFrame:
    return rounded(errors.store_scenarios(f.scored_by_average()), 4)


@query(
    "worst_stores_topk",
    sql("scored", f"{_SCENARIOS} ORDER BY mape DESC, store LIMIT 5"),
)
def worst_stores_topk(f: Frames) -> DataFrame:
    scenarios = rounded(errors.store_scenarios(f.scored_by_average()), 4)
    return rows.top_rows(scenarios, "mape", ["store"])


_TOTALS = f"""SELECT sum(predictions) AS predictions, sum(predictions - mae) AS worst_scenario,
  sum(predictions + mae) AS best_scenario FROM ({_STORE_ERRORS})"""


@query(
    "scenario_totals",
    sql(
        "scored",
        " UNION ALL ".join(
            f"""SELECT '{n}' AS scenario, round({n}, 4) AS amount,
            'R$' || format('{{:,.2f}}', {n}) AS "values" FROM ({_TOTALS})"""
            for n in ("predictions", "worst_scenario", "best_scenario")
        ),
    ),
)
def scenario_totals(f: Frames) -> DataFrame:
    scenarios = errors.store_scenarios(f.scored_by_average())
    return rounded(errors.scenario_totals(scenarios), 4)


@query(
    "error_columns",
    sql(
        "scored",
        """SELECT store, date, round(sales, 4) AS sales, round(predictions, 4) AS predictions,
          round(sales - predictions, 4) AS error, round(predictions / sales, 4) AS error_rate
        FROM scored""",
    ),
)
def error_columns(f: Frames) -> DataFrame:
    scored = f.scored_by_average().select("store", "date", "sales", "predictions")
    return rounded(errors.row_errors(scored), 4)


@query(
    "forecast_message",
    sql(
        "scored",
        """SELECT store, round(p, 4) AS prediction,
          'Store Number ' || store || ' will sell R$' || format('{:,.2f}', p)
            || ' in the next 6 weeks' AS message
        FROM (SELECT store, sum(predictions) AS p FROM scored GROUP BY store)""",
    ),
)
def forecast_message(f: Frames) -> DataFrame:
    per_store = f.scored_by_average().groupBy("store").agg(F.sum("predictions").alias("prediction"))
    return rounded(add_message(per_store), 4)


# --- folds -------------------------------------------------------------------
_FOLD_CTE = """,
fold_rows AS (SELECT store, date, ln(1 + sales) AS y FROM parts WHERE NOT is_test),
fold_list AS (
  SELECT CAST(k AS INTEGER) AS fold, m - CAST(42 * k AS INTEGER) AS validation_start,
    m - CAST(42 * (k - 1) AS INTEGER) AS validation_end
  FROM range(1, 6) r(k) CROSS JOIN (SELECT max(date) AS m FROM fold_rows)
)"""


def fold_sql(body: str) -> str:
    base = sql("scored", "").rstrip()
    return base + _FOLD_CTE + "\n" + body.strip()


@query(
    "cv_folds",
    fold_sql(
        """SELECT fold, validation_start, validation_end,
          min(date) FILTER (date < validation_start) AS train_min,
          max(date) FILTER (date < validation_start) AS train_max,
          count(*) FILTER (date < validation_start) AS train_rows,
          count(*) FILTER (date BETWEEN validation_start AND validation_end) AS validation_rows
        FROM fold_list CROSS JOIN fold_rows GROUP BY 1, 2, 3"""
    ),
)
def cv_folds(f: Frames) -> DataFrame:
    train, _ = rows.split_by_date(f.sales_days.select("date"), f.cutoff)
    return errors.cv_folds(train, rows.last_date(train))


_FOLD_ERRORS = """,
fold_means AS (
  SELECT fold, store, avg(y) AS m FROM fold_list JOIN fold_rows ON date < validation_start
  GROUP BY fold, store
),
fold_scored AS (
  SELECT l.fold, exp(r.y) - 1 AS sales, exp(m.m) - 1 AS predictions
  FROM fold_list l JOIN fold_rows r ON r.date BETWEEN l.validation_start AND l.validation_end
  LEFT JOIN fold_means m ON m.fold = l.fold AND m.store = r.store
),
fold_errors AS (
  SELECT fold, avg(abs(sales - predictions)) AS mae,
    avg(abs(sales - predictions) / greatest(abs(sales), 2.220446049250313e-16)) AS mape,
    sqrt(avg(pow(sales - predictions, 2))) AS rmse
  FROM fold_scored GROUP BY fold
)
"""


def _cv_text(name: str) -> str:
    return (
        f"CAST(round(avg({name}), 2) AS VARCHAR) || ' +/- ' || "
        f"CAST(round(stddev_pop({name}), 2) AS VARCHAR) AS {name}_cv"
    )


def cv_columns(digits: int) -> str:
    return ", ".join(
        f"round(avg({n}), {digits}) AS {n}_mean, round(stddev_pop({n}), {digits}) AS {n}_std, {_cv_text(n)}"
        for n in ("mae", "mape", "rmse")
    )


_CV_COLUMNS = cv_columns(6)


def _average_folds(f: Frames) -> DataFrame:
    train, _ = rows.split_by_date(f.log_sales, f.cutoff)
    return models.cross_validate_average(train, rows.last_date(train.select("date")))


@query(
    "cv_summary",
    fold_sql("").rstrip() + _FOLD_ERRORS + f"SELECT 'Average Model' AS model_name, {_CV_COLUMNS} FROM fold_errors",
)
def cv_summary(f: Frames) -> DataFrame:
    return rounded(errors.cv_summary(_average_folds(f)))


@query(
    "union_results",
    fold_sql("").rstrip()
    + _FOLD_ERRORS
    + f"""SELECT 'Average Model' AS model_name, {_ERRORS}, NULL AS mae_cv, NULL AS mape_cv,
      NULL AS rmse_cv FROM scored
    UNION ALL SELECT 'Average Model', NULL, NULL, NULL, mae_cv, mape_cv, rmse_cv
    FROM (SELECT {_CV_COLUMNS} FROM fold_errors)""",
)
def union_results(f: Frames) -> DataFrame:
    single = rounded(errors.ml_error(f.scored_by_average(), "Average Model"))
    folds = errors.cv_summary(_average_folds(f)).select("model_name", "mae_cv", "mape_cv", "rmse_cv")
    return totals.stack(single, folds)
