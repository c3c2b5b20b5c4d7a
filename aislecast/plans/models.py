"""Regression models, cross-validation, random search and model comparison."""

from __future__ import annotations

import datetime as dt
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spreading import salted_join
from ..operators import errors
from ..operators.joins import attach_mean
from ..operators.moments import Moments, pair_moments
from ..schemas import FEATURES, HORIZON_DAYS, TARGET
from ..session import held, importable_by_workers
from .boosting import BlockBoosting, BlockForest, TreeModel, fit_in_step

# --- Fixed values: the search grid and the tuned parameters ------------------
SEARCH_GRID = {
    "n_estimators": [15, 17, 25, 30, 35],
    "eta": [0.01, 0.03],
    "max_depth": [3, 5, 9],
    "subsample": [0.1, 0.5, 0.7],
    "colsample_bytree": [0.3, 0.7, 0.9],
    "min_child_weight": [3, 8, 15],
}
MAX_EVAL = 10
TUNED = {
    "n_estimators": 3000,
    "eta": 0.03,
    "max_depth": 5,
    "subsample": 0.7,
    "colsample_bytree": 0.7,
    "min_child_weight": 3,
}
LASSO_ALPHA = 0.01
FOREST_TREES = 100
FIRST_BOOSTED = {
    "n_estimators": 100,
    "eta": 0.01,
    "max_depth": 10,
    "subsample": 0.7,
    "colsample_bytree": 0.9,
}
BASE_SCORE = 0.5
SEED = 42
# --- end of fixed values -----------------------------------------------------

Estimator = Pipeline | BlockBoosting | BlockForest
Model = PipelineModel | TreeModel

# Folds of one model that are fitted at the same time.
PARALLEL_FITS = 4


def estimator(regressor, features: Sequence[str] = FEATURES) -> Pipeline:
    """Assemble ``features`` and fit ``regressor`` on the log target."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    regressor.setFeaturesCol("features").setLabelCol(TARGET).setPredictionCol("log_prediction")
    return Pipeline(stages=[vector, regressor])


def linear(features: Sequence[str] = FEATURES) -> Pipeline:
    """Ordinary least squares by the normal equations: one pass over the rows."""
    return estimator(LinearRegression(regParam=0.0, solver="normal"), features)


def lasso(alpha: float = LASSO_ALPHA, features: Sequence[str] = FEATURES) -> Pipeline:
    """L1 penalty on the features as they are (no standardisation)."""
    model = LinearRegression(
        regParam=alpha, elasticNetParam=1.0, standardization=False, solver="normal",
        maxIter=1000, tol=1e-10,
    )
    return estimator(model, features)


def forest(
    trees: int = FOREST_TREES,
    depth: int | None = None,
    bins: int = 256,
    seed: int = SEED,
    features: Sequence[str] = FEATURES,
) -> BlockForest:
    """Trees on bootstraps of the rows, of unlimited depth by default."""
    return BlockForest(trees, depth, bins, seed, tuple(features))


def boosted(
    n_estimators: int = 100,
    eta: float = 0.3,
    max_depth: int = 6,
    subsample: float = 1.0,
    colsample_bytree: float = 1.0,
    min_child_weight: int = 1,
    bins: int = 256,
    seed: int = SEED,
    features: Sequence[str] = FEATURES,
    base_score: float = BASE_SCORE,
) -> BlockBoosting:
    """Gradient-boosted trees for squared error, with an L2 term of 1 in every leaf."""
    return BlockBoosting(
        n_estimators, eta, max_depth, subsample, colsample_bytree, min_child_weight, 1.0, base_score, bins, seed, tuple(features)
    )


def fit(model: Estimator, train: DataFrame) -> Model:
    importable_by_workers(train.sparkSession)
    return model.fit(train)


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """Rows with ``predictions`` in sales units and, if known, ``sales`` too.

    The prediction is a column of the row it belongs to, so keys stay attached.
    """
    scored = model.transform(rows)
    scored = scored.withColumn("predictions", F.expm1("log_prediction"))
    if TARGET in rows.columns:
        scored = scored.withColumn(TARGET, F.expm1(TARGET))
    return scored.drop("features", "log_prediction")


def average_model(
    train: DataFrame, test: DataFrame, fit_on: str = "train", key: str = "store"
) -> DataFrame:
    """Test rows with the per-store mean of log sales as prediction, in sales units."""
    if fit_on not in ("train", "test"):
        raise ValueError("fit_on is 'train' or 'test'")
    source = train if fit_on == "train" else None
    joined = attach_mean(test, TARGET, "predictions", key, source)
    return joined.withColumns({TARGET: F.expm1(TARGET), "predictions": F.expm1("predictions")})


def holdout_error(name: str, model: Estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit on ``train``; error of the predictions for ``test``."""
    return errors.ml_error(predict(fit(model, train), test), name)


def fold_predictions(
    rows: DataFrame,
    last: dt.date,
    folds: int,
    fit_predict: Callable[[DataFrame, DataFrame], DataFrame],
    days: int = HORIZON_DAYS,
    parallelism: int = PARALLEL_FITS,
) -> DataFrame:
    """Validation rows of every fold with predictions and their fold number.

    Folds go back from ``last`` in equal steps, each trained on all rows before
    its window. The folds, not the rows, are looped over; every fit is a
    distributed job and ``parallelism`` of them share the cluster.
    """

    def one_fold(k: int) -> DataFrame:
        train, valid = errors.fold_split(rows, last, k, days)
        scored = fit_predict(train, valid)
        return scored.select(F.lit(k).alias("fold"), "store", "date", TARGET, "predictions")

    return reduce(DataFrame.unionByName, in_threads(one_fold, range(folds, 0, -1), parallelism))


def in_threads(work: Callable, items: Iterable, parallelism: int) -> list:
    """Results of ``work`` for each item, in order, from a few driver threads."""
    target = inheritable_thread_target(SparkSession.active())(work)
    with ThreadPool(parallelism) as pool:
        return pool.map(target, list(items))


def fold_errors(predicted: DataFrame, model_name: str) -> DataFrame:
    """Error per fold, all folds in one aggregation."""
    grouped = predicted.groupBy("fold").agg(*errors.error_columns_of(TARGET, "predictions"))
    return grouped.select(F.lit(model_name).alias("model_name"), "*")


def cross_validate(
    rows: DataFrame,
    last: dt.date,
    folds: int,
    model_name: str,
    model: Estimator,
    days: int = HORIZON_DAYS,
) -> DataFrame:
    """One row: mean and std over time-ordered folds of MAE, MAPE and RMSE.

    Boosted models of all folds grow in the same jobs.
    """
    if isinstance(model, BlockBoosting):
        per_fold = staged_fold_errors(rows, last, folds, {model_name: model}, days)
        return errors.cv_summary(per_fold.withColumnRenamed("draw", "model_name"))

    def fit_predict(train: DataFrame, valid: DataFrame) -> DataFrame:
        return predict(fit(model, train), valid)

    predicted = fold_predictions(rows, last, folds, fit_predict, days)
    return errors.cv_summary(fold_errors(predicted, model_name))


def cross_validate_linear(
    rows: DataFrame,
    last: dt.date,
    folds: int,
    model_name: str,
    alpha: float = 0.0,
    features: Sequence[str] = FEATURES,
    days: int = HORIZON_DAYS,
) -> DataFrame:
    """``cross_validate`` of least squares, or of the lasso for ``alpha`` above 0, with one scan for all fits.

    The rows are cut at the folds' starts into time segments; the sums of the
    segments before a fold give its cross-products, hence its fit. A second
    scan, of the validation rows alone, takes the errors of all folds.
    """
    numbers = list(range(folds, 0, -1))
    starts = [errors.fold_bounds(last, k, days)[0] for k in numbers]
    passed = reduce(Column.__add__, [(F.col("date") >= F.lit(s)).cast("int") for s in starts])
    complete = rows.where(F.col("date") < F.lit(starts[-1])).dropna(subset=[*features, TARGET])
    segments = pair_moments(complete, [*features, TARGET], passed)
    day, cells, total = F.col("date"), [], None
    for at, k in enumerate(numbers):
        if at in segments:
            total = segments[at] if total is None else total.merged(segments[at])
        if total is None:
            raise ValueError(f"no rows before fold {k}")
        intercept, weights = solve(total, alpha)
        value = reduce(Column.__add__, [F.col(f) * w for f, w in zip(features, weights.tolist())], F.lit(intercept))
        start, end = errors.fold_bounds(last, k, days)
        cell = F.struct(F.lit(k).alias("fold"), F.expm1(value).alias("predictions"))
        cells.append(F.when(day.between(F.lit(start), F.lit(end)), cell))
    valid = rows.where(day >= F.lit(starts[0])).select(F.expm1(TARGET).alias(TARGET), F.inline(F.array_compact(F.array(*cells))))
    return errors.cv_summary(fold_errors(valid, model_name))


def solve(moments: Moments, alpha: float = 0.0, rounds: int = 10_000) -> tuple[float, np.ndarray]:
    """Intercept and weights of the last column on the others: least squares, or coordinate descent for the lasso."""
    products, means, n = moments.covariance_sums(), moments.means(), moments.count[0, 0]
    gram, with_label = products[:-1, :-1], products[:-1, -1]
    if alpha == 0:
        scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
        weights = np.linalg.lstsq(gram / np.outer(scale, scale), with_label / scale, rcond=1e-12)[0] / scale
    else:
        weights = np.zeros(len(gram))
        for _ in range(rounds):
            before = weights.copy()
            for j in np.flatnonzero(np.diag(gram) > 0):
                rest = with_label[j] - gram[j] @ weights + gram[j, j] * weights[j]
                weights[j] = np.sign(rest) * max(abs(rest) - alpha * n, 0.0) / gram[j, j]
            if np.abs(weights - before).max() <= 1e-12 * max(1.0, np.abs(weights).max()):
                break
    return float(means[-1] - means[:-1] @ weights), weights


def staged_fold_errors(
    rows: DataFrame, last: dt.date, folds: int, models: Mapping[int | str, BlockBoosting], days: int = HORIZON_DAYS
) -> DataFrame:
    """Error of every model, named by ``draw``, on every fold.

    Models that differ in the number of rounds alone share one fit for each
    fold, and all fits grow in step: a round of all of them takes as many jobs as
    one of a single model. A fold's rows are scored once, for all models and
    numbers of rounds.
    """
    importable_by_workers(rows.sparkSession)
    shared: dict[BlockBoosting, dict[int | str, int]] = {}
    for draw, model in models.items():
        shared.setdefault(replace(model, rounds=0), {})[draw] = model.rounds
    longest = [replace(m, rounds=max(r.values())) for m, r in shared.items()]
    numbers = range(folds, 0, -1)
    starts = [errors.fold_bounds(last, k, days)[0] for k in numbers]
    train = rows.where(F.col("date") < F.lit(starts[-1]))
    fitted = fit_in_step(train, longest * folds, [start for start in starts for _ in longest])
    parts = []
    for at, k in enumerate(numbers):
        _, valid = errors.fold_split(rows, last, k, days)
        cells = []
        for i, rounds in enumerate(shared.values()):
            counts = sorted(set(rounds.values()))
            valid = fitted[at * len(longest) + i].staged(valid, counts, f"staged_{i}")
            cells += [
                F.struct(F.lit(draw).alias("draw"), F.expm1(F.col(f"staged_{i}")[counts.index(n)]).alias("predictions"))
                for draw, n in rounds.items()
            ]
        parts.append(valid.select(F.lit(k).alias("fold"), F.expm1(TARGET).alias(TARGET), F.inline(F.array(*cells))))
    scored = reduce(DataFrame.unionByName, parts)
    return scored.groupBy("draw", "fold").agg(*errors.error_columns_of(TARGET, "predictions"))


def cross_validate_average(
    rows: DataFrame, last: dt.date, folds: int = 5, days: int = HORIZON_DAYS
) -> DataFrame:
    """Fold errors of the average model, without a fit per fold.

    The means of all folds come from one aggregate per store, and each
    validation row takes the mean of its own fold.
    """
    day = F.col("date")
    means = [
        F.avg(F.when(day < F.lit(errors.fold_bounds(last, k, days)[0]), F.col(TARGET))).alias(f"m{k}")
        for k in range(1, folds + 1)
    ]
    per_store = rows.groupBy("store").agg(*means)
    first, _ = errors.fold_bounds(last, folds, days)
    valid = rows.where(day >= F.lit(first)).withColumn(
        "fold", F.explode(errors.validation_folds(day, last, folds, days))
    )
    joined = salted_join(valid, per_store, ["store"], ["date"], "left", salts=8)
    mean = F.element_at(F.array(*[F.col(f"m{k}") for k in range(1, folds + 1)]), F.col("fold"))
    predicted = joined.select(
        "fold", "store", "date", F.expm1(TARGET).alias(TARGET), F.expm1(mean).alias("predictions")
    )
    return fold_errors(predicted, "Average Model")


def draw_parameters(
    grid: Mapping[str, Sequence] = SEARCH_GRID, draws: int = MAX_EVAL, seed: int = SEED
) -> list[dict]:
    """``draws`` random combinations, one value per parameter each."""
    source = random.Random(seed)
    return [{name: source.choice(list(values)) for name, values in grid.items()} for _ in range(draws)]


def random_search(
    rows: DataFrame,
    last: dt.date,
    folds: int = 5,
    draws: int = MAX_EVAL,
    grid: Mapping[str, Sequence] = SEARCH_GRID,
    seed: int = SEED,
    bins: int = 256,
) -> DataFrame:
    """Cross-validated error of each drawn combination, best RMSE first.

    All draws and folds are fitted in step; see ``staged_fold_errors``.
    """
    drawn = draw_parameters(grid, draws, seed)
    models = {draw: boosted(**values, bins=bins, seed=seed) for draw, values in enumerate(drawn)}
    summary = errors.cv_summary(staged_fold_errors(rows, last, folds, models), by="draw")
    table = [(draw, *map(float, values.values())) for draw, values in enumerate(drawn)]
    settings = rows.sparkSession.createDataFrame(table, "draw int, " + ", ".join(f"{n} double" for n in grid))
    for name, values in grid.items():
        if all(isinstance(v, int) for v in values):
            settings = settings.withColumn(name, F.col(name).cast("int"))
    named = settings.withColumn("model_name", F.lit("Boosted Trees"))
    return named.join(summary, "draw").orderBy("rmse_mean", "draw")


def compare_models(results: Sequence[DataFrame], by: str = "rmse") -> DataFrame:
    """Result rows of several models, best first."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    return stacked.orderBy(F.asc_nulls_last(by), "model_name")


def fixed(df: DataFrame) -> DataFrame:
    """Evaluate a table of metrics (a few rows) now, while its inputs are held."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def with_held(rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a training loop over rows kept in executor memory; return its metrics."""
    with held(rows) as kept:
        return fixed(work(kept))


def feature_rows(prepared: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Only what training reads: the features, ``date`` and the log target of complete rows.

    The test for complete rows names the partition, so that it stays behind the
    features. Pushed below them it would repeat the expressions of all in one
    method, too long for the JVM to compile: seven times the time.
    """
    names = [*features, "date", TARGET]
    made = prepared.select(*names, F.spark_partition_id().alias("_part"))
    return made.where("_part >= 0").dropna(subset=names).drop("_part")


def incomplete_rows(prepared: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """The rows that ``feature_rows`` leaves out, plus ``reason``."""
    missing = F.concat_ws(", ", *[F.when(F.col(n).isNull(), F.lit(n)) for n in [*features, "date", TARGET]])
    return prepared.where(missing != "").withColumn("reason", F.concat(F.lit("no value for "), missing))


def one_feature(prepared: DataFrame, feature: str) -> DataFrame:
    return prepared.select(F.col(feature).cast("double").alias(feature), TARGET)


def line(model: PipelineModel) -> tuple[float, float]:
    """Intercept and slope of a fitted one-feature linear model."""
    fitted = model.stages[-1]
    return fitted.intercept, float(fitted.coefficients[0])
