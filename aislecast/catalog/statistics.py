"""Descriptive statistics, correlation, association and chart data."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rows, shapes, statistics, totals
from ..operators.errors import row_errors
from .base_sql import sql
from .basics import NUMERIC
from .frames import Frames
from .registry import query, rounded

CATEGORIES = ["state_holiday", "store_type", "assortment"]
TREND_KEYS = ["competition_distance", "competition_time_month", "promo_time_week", "year", "day", "day_of_week"]

_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, CAST({c} AS DOUBLE) AS x FROM clean" for c in NUMERIC
)
_DESCRIBE_SQL = f"""
SELECT attribute, min(x) AS min, max(x) AS max, max(x) - min(x) AS range, round(avg(x), 4) AS mean,
  quantile_cont(x, 0.5) AS median, round(stddev_pop(x), 4) AS std,
  round(skewness(x), 4) + 0.0 AS skew, round(kurtosis(x), 4) + 0.0 AS kurtosis
FROM ({_LONG}) GROUP BY attribute
"""


@query("describe_numeric", sql("clean", _DESCRIBE_SQL))
def describe_numeric(f: Frames) -> DataFrame:
    table = statistics.describe_numeric(f.clean, NUMERIC)
    return rounded(table, 4, ["mean", "std", "skew", "kurtosis"])


_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
    f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0 AS r FROM clean"
    for a, b in product(NUMERIC, NUMERIC)
)


@query("corr_matrix", sql("clean", _CORR_SQL))
def corr_matrix(f: Frames) -> DataFrame:
    return rounded(statistics.corr_matrix(f.clean, NUMERIC))


_KEY_TOTALS = " UNION ALL ".join(
    f"SELECT '{k}' AS attribute, CAST({k} AS DOUBLE) AS key, CAST(sum(sales) AS DOUBLE) AS sales "
    f"FROM train GROUP BY {k}"
    for k in TREND_KEYS
)


@query(
    "corr_after_agg",
    sql(
        "train",
        f"SELECT attribute, round(corr(key, sales), 6) AS r FROM ({_KEY_TOTALS}) GROUP BY attribute",
    ),
)
def corr_after_agg(f: Frames) -> DataFrame:
    return rounded(statistics.corr_with(totals.totals_per_key(f.training, TREND_KEYS)))


_TREND_SQL = f"""
SELECT attribute, round(regr_slope(sales, key), 2) AS slope,
  round(regr_intercept(sales, key), 2) AS intercept, round(regr_r2(sales, key), 6) AS r2,
  CAST(regr_count(sales, key) AS BIGINT) AS n_keys
FROM (
  SELECT CASE WHEN attribute = 'promo_time_week' AND key > 0 THEN 'promo_time_week_extended'
      WHEN attribute = 'promo_time_week' AND key < 0 THEN 'promo_time_week_regular'
      WHEN attribute = 'competition_time_month' AND (key >= 120 OR key = 0) THEN NULL
      WHEN attribute IN ('promo_time_week', 'competition_distance') THEN NULL
      ELSE attribute END AS attribute, key, sales
  FROM ({_KEY_TOTALS})
  UNION ALL SELECT 'half_year', CASE WHEN month > 6 THEN 2.0 ELSE 1.0 END, CAST(sum(sales) AS DOUBLE)
  FROM train GROUP BY 2
) WHERE attribute IS NOT NULL GROUP BY attribute
"""


@query("trend_line", sql("train", _TREND_SQL))
def trend_line(f: Frames) -> DataFrame:
    """Straight lines of the charted totals: long-open rivals and week 0 are left out."""
    half = F.when(F.col("month") > 6, 2).otherwise(1)
    keyed = f.open_days.withColumn("half_year", half)
    sums = totals.totals_per_key(keyed, [*TREND_KEYS[1:], "half_year"])
    attribute, key = F.col("attribute"), F.col("key")
    weeks, months = attribute == "promo_time_week", attribute == "competition_time_month"
    charted = sums.where(~(months & ((key >= 120) | (key == 0))) & ~(weeks & (key == 0)))
    name = (
        F.when(weeks & (key > 0), "promo_time_week_extended")
        .when(weeks, "promo_time_week_regular")
        .otherwise(attribute)
    )
    lines = statistics.trend_line(charted.withColumn("attribute", name))
    return rounded(rounded(lines, 2, ["slope", "intercept"]), 6, ["r2"])


def _cramers_sql(x: str, y: str) -> str:
    """Cramér's V over the full grid of levels, as the textbook formula."""
    return f"""
SELECT '{x}' AS x, '{y}' AS y, round(sqrt((c2 / n) / least(
    (k - (k - 1) ** 2 / (n - 1)) - 1, (r - (r - 1) ** 2 / (n - 1)) - 1)), 6) AS v
FROM (
  SELECT greatest(sum((o - e) ** 2 / e) - (any_value(k) - 1) * (any_value(r) - 1)
      / (any_value(n) - 1), 0) AS c2, any_value(n) AS n, any_value(r) AS r, any_value(k) AS k
  FROM (
    SELECT coalesce(c.o, 0) AS o, CAST(a.rt AS DOUBLE) * b.ct / t.n AS e, t.n AS n,
      (SELECT CAST(count(DISTINCT {x}) AS DOUBLE) FROM train) AS r,
      (SELECT CAST(count(DISTINCT {y}) AS DOUBLE) FROM train) AS k
    FROM (SELECT {x} AS xl, count(*) AS rt FROM train GROUP BY 1) a
    CROSS JOIN (SELECT {y} AS yl, count(*) AS ct FROM train GROUP BY 1) b
    CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM train) t
    LEFT JOIN (SELECT {x} AS xl, {y} AS yl, CAST(count(*) AS DOUBLE) AS o FROM train GROUP BY 1, 2) c
      ON c.xl = a.xl AND c.yl = b.yl
  )
)"""


@query("cramers_v", sql("train", _cramers_sql("state_holiday", "store_type")))
def cramers_v(f: Frames) -> DataFrame:
    return rounded(statistics.cramers_v(f.open_days, "state_holiday", "store_type"))


@query(
    "cramers_v_matrix",
    sql("train", " UNION ALL ".join(_cramers_sql(x, y) for x, y in product(CATEGORIES, CATEGORIES))),
)
def cramers_v_matrix(f: Frames) -> DataFrame:
    return rounded(statistics.cramers_v_matrix(f.open_days, CATEGORIES))


_HISTOGRAM_SQL = " UNION ALL ".join(
    f"""
SELECT '{c}' AS attribute, CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 25), 6) AS lower,
  round(lo + (b + 1) * ((hi - lo) / 25), 6) AS upper, count(x) AS n
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM clean)
CROSS JOIN range(0, 25) r(b)
LEFT JOIN (
  SELECT {c} AS x, least(CAST(floor((CAST({c} AS DOUBLE) - lo) / ((hi - lo) / 25)) AS BIGINT), 24) AS xb
  FROM clean CROSS JOIN
    (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM clean)
) ON xb = b
GROUP BY b, lo, hi"""
    for c in NUMERIC
)


@query("histogram", sql("clean", _HISTOGRAM_SQL))
def histogram(f: Frames) -> DataFrame:
    return rounded(shapes.histogram(f.clean, NUMERIC, bins=25))


_KDE_SQL = """
SELECT store_type, CAST(p AS INTEGER) AS point, round(lo - 3 * h + p * step, 4) AS at,
  round(1e6 * sum(exp(-0.5 * (((lo - 3 * h + p * step) - x) / h) ** 2))
    / (n * h * sqrt(2 * pi())), 4) AS density
FROM (
  SELECT *, (hi - lo + 6 * h) / 199 AS step FROM (
    SELECT store_type, CAST(count(sales) AS DOUBLE) AS n, min(sales) AS lo, max(sales) AS hi,
      stddev_samp(CAST(sales AS DOUBLE)) * pow(CAST(count(sales) AS DOUBLE), -0.2) AS h
    FROM train GROUP BY store_type)
) g JOIN (SELECT store_type AS t, CAST(sales AS DOUBLE) AS x FROM train) ON t = store_type
CROSS JOIN range(0, 200) r(p)
GROUP BY store_type, p, lo, h, step, n
"""


@query("kernel_density", sql("train", _KDE_SQL))
def kernel_density(f: Frames) -> DataFrame:
    """Density of sales per store type, in millionths."""
    curve = shapes.kernel_density(f.open_days, "store_type", "sales")
    return rounded(curve.withColumn("density", F.col("density") * 1e6), 4)


def _binned_sql(dimension: str) -> str:
    return f"""
SELECT '{dimension}' AS dimension, level, CAST(p AS INTEGER) AS point, round(lo - 3 * h + p * step, 4) AS at,
  round(1e6 * sum(w * exp(-0.5 * (((lo - 3 * h + p * step) - (lo - 3 * h + node * width)) / h) ** 2))
    / (n * h * sqrt(2 * pi())), 4) AS density
FROM (
  SELECT level, lo, h, step, n, width, unnest([floor(spot), floor(spot) + 1]) AS node,
    unnest([1 - (spot - floor(spot)), spot - floor(spot)]) AS w
  FROM (
    SELECT *, (x - (lo - 3 * h)) / width AS spot FROM (
      SELECT *, step / ceil(step / (h * sqrt(8 * 1e-4))) AS width FROM (
        SELECT *, (hi - lo + 6 * h) / 199 AS step FROM (
          SELECT {dimension} AS level, CAST(count(sales) AS DOUBLE) AS n, min(sales) AS lo, max(sales) AS hi,
            stddev_samp(CAST(sales AS DOUBLE)) * pow(CAST(count(sales) AS DOUBLE), -0.2) AS h
          FROM train GROUP BY 1) WHERE h > 0)
    ) JOIN (SELECT {dimension} AS t, CAST(sales AS DOUBLE) AS x FROM train) ON t = level))
CROSS JOIN range(0, 200) r(p)
GROUP BY level, p, lo, h, step, n
"""


DENSITY_DIMENSIONS = ["state_holiday", "assortment"]


@query("kernel_density_binned", sql("train", " UNION ALL ".join(map(_binned_sql, DENSITY_DIMENSIONS))))
def kernel_density_binned(f: Frames) -> DataFrame:
    """Density of sales by holiday and assortment, in millionths, from linearly binned rows."""
    curves = [
        shapes.binned_density(f.open_days, d, "sales").select(
            F.lit(d).alias("dimension"), F.col(d).alias("level"), "point", "at", (F.col("density") * 1e6).alias("density")
        )
        for d in DENSITY_DIMENSIONS
    ]
    return rounded(curves[0].unionByName(curves[1]), 4)


def _box_sql(dimension: str, level: str, value: str, source: str) -> str:
    return f"""
SELECT '{dimension}' AS dimension, level, q1, median, q3,
  min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
  max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
  count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers,
  count(*) AS n
FROM (SELECT {level} AS level, CAST({value} AS DOUBLE) AS x FROM {source}) JOIN (
  SELECT {level} AS l, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1,
    quantile_cont(CAST({value} AS DOUBLE), 0.5) AS median,
    quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3
  FROM {source} GROUP BY 1) ON l = level
GROUP BY level, q1, median, q3"""


_HOLIDAY_ROWS = "(SELECT * FROM clean WHERE state_holiday <> '0' AND sales > 0)"


@query(
    "box_stats",
    sql(
        "train",
        _box_sql("state_holiday", "state_holiday", "sales", _HOLIDAY_ROWS)
        + " UNION ALL "
        + _box_sql("store_type", "store_type", "sales", _HOLIDAY_ROWS)
        + " UNION ALL "
        + _box_sql("all", "'all'", "competition_distance", "train"),
    ),
)
def box_stats(f: Frames) -> DataFrame:
    """Sales on holidays by holiday and store type, and the competition distance."""
    sales = shapes.box_stats(rows.holiday_sales(f.clean), ["state_holiday", "store_type"], "sales")
    distance = shapes.box_stats(f.training, [], "competition_distance")
    return sales.unionByName(distance)


@query(
    "daily_mean_error",
    sql(
        "scored",
        """SELECT date, round(avg(sales), 4) AS mean_sales, round(avg(predictions), 4) AS mean_predictions,
          round(avg(predictions / sales), 4) AS mean_error_rate,
          round(stddev_samp(sales), 4) AS std_sales, round(stddev_samp(predictions), 4) AS std_predictions,
          round(stddev_samp(predictions / sales), 4) AS std_error_rate, count(*) AS n
        FROM scored GROUP BY date""",
    ),
)
def daily_mean_error(f: Frames) -> DataFrame:
    scored = row_errors(f.scored_by_average())
    return rounded(shapes.daily_means(scored, "sales", "predictions", "error_rate"), 4)
