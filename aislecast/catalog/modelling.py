"""Models, cross-validation, feature selection, scoring and the stream.

Every query runs on the whole prepared table. Queries named ``..._small`` fit
fewer or shallower trees than the operators' defaults, which take long here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import errors, rows
from ..plans import models
from ..plans.forecast import Forecaster, future_records, save_forecaster, six_week_forecast as six_weeks
from ..plans.selection import boruta_select as boruta
from ..session import held, work_path
from ..sources.models import load_model, save_model
from ..sources.records import read_records, write_records
from ..streaming.scoring import score_stream, scored_batches, stream_batches
from .base_sql import sql
from .business import cv_columns, errors_sql, fold_sql
from .frames import Frames
from .registry import query, rounded

# Sizes for the small queries.
TREES, DEPTH, ROUNDS, BINS = 20, 8, 20, 64


def _split(f: Frames, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.split_by_date(kept, f.cutoff)


def _holdout(f: Frames, name: str, model) -> DataFrame:
    """Fit on the rows before the cutoff, held in memory; error on the rest."""

    def work(kept: DataFrame) -> DataFrame:
        return models.holdout_error(name, model, *_split(f, kept))

    return models.with_held(f.feature_rows, work)


@query("linear_regression")
def linear_regression(f: Frames) -> DataFrame:
    return _holdout(f, "Linear Regression", models.linear())


@query("lasso_regression")
def lasso_regression(f: Frames) -> DataFrame:
    return _holdout(f, "Lasso", models.lasso())


@query("random_forest_small")
def random_forest_small(f: Frames) -> DataFrame:
    return _holdout(f, "Random Forest", models.forest(TREES, DEPTH, BINS))


@query("random_forest")
def random_forest(f: Frames) -> DataFrame:
    """The forest at its full size: 100 trees of unlimited depth."""
    return _holdout(f, "Random Forest", models.forest())


@query("gbt_regression")
def gbt_regression(f: Frames) -> DataFrame:
    """The first boosted model at its full size: 100 rounds of depth 10."""
    return _holdout(f, "Boosted Trees", models.boosted(**models.FIRST_BOOSTED))


@query("final_model_small")
def final_model_small(f: Frames) -> DataFrame:
    """The tuned parameters with fewer rounds."""
    tuned = {**models.TUNED, "n_estimators": ROUNDS}
    return _holdout(f, "Boosted Trees, tuned", models.boosted(**tuned, bins=BINS))


_ONE_FEATURE = """
SELECT '{f}' AS feature, round({intercept}, 6) AS intercept, round({slope}, 8) AS slope
FROM (SELECT ln(1 + sales) AS y, CAST({f} AS DOUBLE) AS x FROM train)
"""


def _one_feature(f: Frames, feature: str, model) -> DataFrame:
    kept = f.open_days.select(F.col(feature).cast("double").alias(feature), F.log1p("sales").alias("sales"))
    intercept, slope = models.line(models.fit(model, kept))
    table = [(feature, intercept, slope)]
    line = f.spark.createDataFrame(table, "feature string, intercept double, slope double")
    return rounded(rounded(line, 6, ["intercept"]), 8, ["slope"])


@query(
    "linear_regression_one_feature",
    sql(
        "train",
        _ONE_FEATURE.format(f="competition_time_month", intercept="regr_intercept(y, x)", slope="regr_slope(y, x)"),
    ),
)
def linear_regression_one_feature(f: Frames) -> DataFrame:
    name = "competition_time_month"
    return _one_feature(f, name, models.linear([name]))


_SOFT = "sign(covar_pop(y, x)) * greatest(abs(covar_pop(y, x)) - 0.01, 0) / var_pop(x)"


@query(
    "lasso_one_feature",
    sql(
        "train",
        _ONE_FEATURE.format(f="competition_time_month", intercept=f"avg(y) - ({_SOFT}) * avg(x)", slope=_SOFT),
    ),
)
def lasso_one_feature(f: Frames) -> DataFrame:
    """With one feature the lasso is the soft-thresholded covariance."""
    name = "competition_time_month"
    return _one_feature(f, name, models.lasso(features=[name]))


def _month_rows(f: Frames) -> DataFrame:
    """Rows of the one-feature model before and after the cutoff."""
    return f.open_days.select(
        "store",
        "date",
        F.col("competition_time_month").cast("double").alias("competition_time_month"),
        F.log1p("sales").alias("sales"),
    )


_LINE_HOLDOUT = f"""
SELECT 'Linear Regression' AS model_name, {errors_sql(4)} FROM (
  SELECT sales, exp(a + b * competition_time_month) - 1 AS predictions
  FROM (SELECT * FROM parts WHERE is_test) CROSS JOIN (
    SELECT regr_intercept(log_sales, CAST(competition_time_month AS DOUBLE)) AS a,
      regr_slope(log_sales, CAST(competition_time_month AS DOUBLE)) AS b
    FROM parts WHERE NOT is_test))
"""


@query("linear_regression_holdout", sql("scored", _LINE_HOLDOUT))
def linear_regression_holdout(f: Frames) -> DataFrame:
    """Fit, predict and measure with one feature: the exact check of the model path."""

    def work(kept: DataFrame) -> DataFrame:
        model = models.linear(["competition_time_month"])
        return models.holdout_error("Linear Regression", model, *_split(f, kept))

    return rounded(models.with_held(_month_rows(f), work), 4)


_LINE_FOLDS = """,
line_rows AS (
  SELECT date, CAST(competition_time_month AS DOUBLE) AS x, log_sales AS y
  FROM parts WHERE NOT is_test
),
line_fits AS (
  SELECT fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b
  FROM fold_list JOIN line_rows ON date < validation_start GROUP BY fold
),
fold_errors AS (
  SELECT fold, avg(abs(s - p)) AS mae, avg(abs(s - p) / greatest(abs(s), 2.220446049250313e-16)) AS mape,
    sqrt(avg(pow(s - p, 2))) AS rmse
  FROM (
    SELECT l.fold, exp(r.y) - 1 AS s, exp(t.a + t.b * r.x) - 1 AS p
    FROM fold_list l JOIN line_rows r ON r.date BETWEEN l.validation_start AND l.validation_end
    JOIN line_fits t ON t.fold = l.fold)
  GROUP BY fold
)
"""


@query(
    "cross_validate_one_feature",
    fold_sql("").rstrip() + _LINE_FOLDS + f"SELECT 'Linear Regression' AS model_name, {cv_columns(4)} FROM fold_errors",
)
def cross_validate_one_feature(f: Frames) -> DataFrame:
    """Five folds of the one-feature model: the exact check of cross-validation."""

    def work(kept: DataFrame) -> DataFrame:
        train, _ = _split(f, kept)
        model = models.linear(["competition_time_month"])
        return models.cross_validate(train, rows.last_date(train), 5, "Linear Regression", model)

    return rounded(models.with_held(_month_rows(f), work), 4)


@query(
    "model_roundtrip",
    sql("scored", "SELECT CAST(0 AS DOUBLE) AS largest_gap, count(*) AS n_rows FROM parts WHERE is_test"),
)
def model_roundtrip(f: Frames) -> DataFrame:
    """Largest difference between predictions of a model and of its saved copy."""
    train, test = (models.feature_rows(part) for part in _split(f, f.prepared))
    model = models.fit(models.linear(), train)
    path = work_path(f.spark, "model")
    save_model(model, path)
    both = models.predict(model, test).withColumnRenamed("predictions", "before")
    both = both.withColumn("sales", F.log1p("sales"))
    gap = F.abs(F.col("predictions") - F.col("before"))
    again = models.predict(load_model(path), both)
    return again.agg(F.max(gap).alias("largest_gap"), F.count(gap).alias("n_rows"))


@query("cross_validate")
def cross_validate(f: Frames) -> DataFrame:
    def work(kept: DataFrame) -> DataFrame:
        train, _ = _split(f, kept)
        return models.cross_validate_linear(train, rows.last_date(train), 5, "Linear Regression")

    return models.with_held(f.feature_rows, work)


@query("cross_validate_lasso")
def cross_validate_lasso(f: Frames) -> DataFrame:
    def work(kept: DataFrame) -> DataFrame:
        train, _ = _split(f, kept)
        return models.cross_validate_linear(train, rows.last_date(train), 5, "Lasso", models.LASSO_ALPHA)

    return models.with_held(f.feature_rows, work)


_TWO_FOLDS = """,
two_rows AS (
  SELECT date, CAST(competition_time_month AS DOUBLE) AS x, CAST(promo AS DOUBLE) AS z, log_sales AS y
  FROM parts WHERE NOT is_test
),
two_sums AS (
  SELECT fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz,
    covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy
  FROM fold_list JOIN two_rows ON date < validation_start GROUP BY fold
),
two_fits AS (
  SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM two_sums
),
fold_errors AS (
  SELECT fold, avg(abs(s - p)) AS mae, avg(abs(s - p) / greatest(abs(s), 2.220446049250313e-16)) AS mape,
    sqrt(avg(pow(s - p, 2))) AS rmse
  FROM (
    SELECT l.fold, exp(r.y) - 1 AS s, exp(my + bx * (r.x - mx) + bz * (r.z - mz)) - 1 AS p
    FROM fold_list l JOIN two_rows r ON r.date BETWEEN l.validation_start AND l.validation_end
    JOIN two_fits t ON t.fold = l.fold)
  GROUP BY fold
)
"""


@query(
    "cross_validate_two_features",
    fold_sql("").rstrip() + _TWO_FOLDS + f"SELECT 'Linear Regression' AS model_name, {cv_columns(4)} FROM fold_errors",
)
def cross_validate_two_features(f: Frames) -> DataFrame:
    """Five folds of least squares on two features, from the cross-products of one scan."""
    names = ["competition_time_month", "promo"]
    kept = f.open_days.select("store", "date", *[F.col(n).cast("double").alias(n) for n in names], F.log1p("sales").alias("sales"))

    def work(held_rows: DataFrame) -> DataFrame:
        train, _ = _split(f, held_rows)
        return models.cross_validate_linear(train, rows.last_date(train), 5, "Linear Regression", features=names)

    return rounded(models.with_held(kept, work), 4)


@query("random_search")
def random_search(f: Frames) -> DataFrame:
    """The search at its full size: ten draws on five folds."""

    def work(kept: DataFrame) -> DataFrame:
        train, _ = _split(f, kept)
        return models.random_search(train, rows.last_date(train))

    return models.with_held(f.feature_rows, work)


@query("random_search_small")
def random_search_small(f: Frames) -> DataFrame:
    """The first two draws of the full search, on two folds."""

    def work(kept: DataFrame) -> DataFrame:
        train, _ = _split(f, kept)
        return models.random_search(train, rows.last_date(train), folds=2, draws=2, bins=BINS)

    return models.with_held(f.feature_rows, work)


@query("compare_models_small")
def compare_models_small(f: Frames) -> DataFrame:
    """Single split and cross-validated error of the models, each ranked by RMSE."""

    def work(kept: DataFrame) -> DataFrame:
        train, test = _split(f, kept)
        last = rows.last_date(train)
        average = errors.ml_error(models.average_model(train, test), "Average Model")
        zoo = {
            "Linear Regression": models.linear(),
            "Lasso": models.lasso(),
            "Random Forest": models.forest(TREES, 5, BINS),
            "Boosted Trees": models.boosted(n_estimators=5, max_depth=5, bins=BINS),
        }
        single = models.compare_models(
            [average] + [models.holdout_error(n, m, train, test) for n, m in zoo.items()]
        )
        folds = models.compare_models(
            [
                models.cross_validate(train, last, 5, n, zoo[n])
                for n in zoo
            ],
            by="rmse_mean",
        )
        left = single.select(F.lit("single split").alias("table"), "*")
        right = folds.select(
            F.lit("5 folds").alias("table"),
            "model_name",
            F.col("mae_mean").alias("mae"),
            F.col("mape_mean").alias("mape"),
            F.col("rmse_mean").alias("rmse"),
            "mae_cv",
            "mape_cv",
            "rmse_cv",
        )
        return left.unionByName(right, allowMissingColumns=True).orderBy("table", "rmse")

    return models.with_held(f.feature_rows, work)


@query("boruta_select_small")
def boruta_select_small(f: Frames) -> DataFrame:
    """At most 20 rounds of trees of depth 5."""
    train, _ = _split(f, f.prepared)
    names = [c for c in train.columns if c not in ("date", "sales")]
    return boruta(train, names, "sales", max_iter=20, depth=5)


def _forecaster(f: Frames) -> Forecaster:
    """Fit the parameters and the first boosted model in full, save both and load them back."""
    with held(f.feature_rows) as kept:
        train, _ = _split(f, kept)
        model = models.fit(models.boosted(**models.FIRST_BOOSTED), train)
    path = work_path(f.spark, "forecaster")
    save_forecaster(f.parameter_table, model, path)
    return Forecaster.load(f.spark, path)


@query("score_batch")
def score_batch(f: Frames) -> DataFrame:
    """All future rows of open days with their prediction."""
    return rounded(_forecaster(f).score(future_records(f.future, f.store)))


@query("six_week_forecast")
def six_week_forecast(f: Frames) -> DataFrame:
    """Report for every store."""
    return rounded(six_weeks(_forecaster(f), f.future, f.store), 4)


@query("stream_scoring")
def stream_scoring(f: Frames) -> DataFrame:
    """The future rows as arriving JSON files, scored by the stream."""
    forecaster = _forecaster(f)
    source, sink, checkpoint = (work_path(f.spark, n) for n in ("records", "scored", "checkpoint"))
    write_records(future_records(f.future, f.store), source)
    stream = score_stream(f.spark, forecaster, source, sink, checkpoint)
    stream.awaitTermination()
    schema = forecaster.score(read_records(f.spark, source)).schema
    return rounded(read_records(f.spark, sink, schema))


# The scoring path with a model that SQL can fit: a straight line on one feature.
_LINE_SCORES = """,
line_fit AS (
  SELECT regr_intercept(log_sales, CAST(competition_time_month AS DOUBLE)) AS a,
    regr_slope(log_sales, CAST(competition_time_month AS DOUBLE)) AS b
  FROM parts WHERE NOT is_test
),
line_scores AS (
  SELECT store, date, exp(a + b * competition_time_month) - 1 AS prediction
  FROM feat CROSS JOIN line_fit
  WHERE date >= (SELECT max(date) FROM raw) - 42 AND open <> 0 AND store % 7 <> 5
)
"""


def _line_scores(body: str) -> str:
    return sql("scored", "").rstrip() + _LINE_SCORES + body


def _line_forecaster(f: Frames) -> Forecaster:
    with held(f.feature_rows) as kept:
        train, _ = _split(f, kept)
        model = models.fit(models.linear(["competition_time_month"]), train)
    path = work_path(f.spark, "forecaster")
    save_forecaster(f.parameter_table, model, path)
    return Forecaster.load(f.spark, path)


@query("score_batch_line", _line_scores("SELECT store, date, round(prediction, 4) AS prediction FROM line_scores"))
def score_batch_line(f: Frames) -> DataFrame:
    """The exact check of batch scoring."""
    scored = _line_forecaster(f).score(future_records(f.future, f.store))
    return rounded(scored.select("store", "date", "prediction"), 4)


@query(
    "six_week_forecast_line",
    _line_scores("SELECT store, round(sum(prediction), 3) AS prediction FROM line_scores GROUP BY store"),
)
def six_week_forecast_line(f: Frames) -> DataFrame:
    """The exact check of the report's totals."""
    return rounded(six_weeks(_line_forecaster(f), f.future, f.store).select("store", "prediction"), 3)


@query(
    "stream_accounts",
    _line_scores(
        "SELECT CAST(count(*) AS BIGINT) AS records, "
        "CAST(count(*) FILTER (store % 10 <> 3) AS BIGINT) AS scored, "
        "CAST(count(*) FILTER (store % 10 = 3) AS BIGINT) AS refused FROM line_scores"
    ),
)
def stream_accounts(f: Frames) -> DataFrame:
    """Arriving records, some of an unknown store type, and what the stream made of them."""
    forecaster = _line_forecaster(f)
    source, out, checkpoint = (work_path(f.spark, n) for n in ("records", "batches", "checkpoint"))
    odd = F.when(F.col("Store") % 10 == 3, F.lit("z")).otherwise(F.col("StoreType"))
    write_records(future_records(f.future, f.store).withColumn("StoreType", odd), source)
    stream_batches(f.spark, forecaster, source, out, checkpoint).awaitTermination()
    count = F.count(F.lit(1))
    scored, refused = (scored_batches(f.spark, out, kind).agg(count.alias(kind)) for kind in ("scored", "refused"))
    records = read_records(f.spark, source).agg(count.alias("records"))
    return records.join(scored).join(refused)


@query("stream_scoring_line", _line_scores("SELECT store, date, round(prediction, 4) AS prediction FROM line_scores"))
def stream_scoring_line(f: Frames) -> DataFrame:
    """The exact check of the stream: the same records as files, scored as they arrive."""
    forecaster = _line_forecaster(f)
    source, sink, checkpoint = (work_path(f.spark, n) for n in ("records", "scored", "checkpoint"))
    write_records(future_records(f.future, f.store), source)
    score_stream(f.spark, forecaster, source, sink, checkpoint).awaitTermination()
    schema = forecaster.score(read_records(f.spark, source)).schema
    return rounded(read_records(f.spark, sink, schema).select("store", "date", "prediction"), 4)
