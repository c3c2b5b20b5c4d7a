"""Sources, columns, missing values, filters, joins, scalars and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, encode
from ..operators import columns, joins, nulls, rows, scaling, totals
from ..plans import prepare
from ..schemas import ASSORTMENT_RANK, FEATURES, JOINED_COLUMNS, MONTH_NAMES, RECORD, SALES
from ..session import work_path
from ..sources.records import records_in, records_out
from ..sources.tables import read_csv, refused_csv, write_csv
from .base_sql import sql
from .frames import Frames
from .registry import query, rounded

_RECORD_COLUMNS = ", ".join(f'"{n}"' for n in RECORD.names)
_RECORDS_SQL = f"""
SELECT {_RECORD_COLUMNS} FROM (
  SELECT f.*, t.* EXCLUDE ("Store") FROM future_t f LEFT JOIN store_t t ON f."Store" = t."Store")
"""


# --- sources and sinks -------------------------------------------------------
@query("scan_sales", sql("sales_t", "SELECT * FROM sales_t"))
def scan_sales(f: Frames) -> DataFrame:
    return f.sales


@query("scan_store", sql("store_t", "SELECT * FROM store_t"))
def scan_store(f: Frames) -> DataFrame:
    return f.store


@query("scan_future", sql("future_t", "SELECT * FROM future_t"))
def scan_future(f: Frames) -> DataFrame:
    return f.future


def _spoiled_csv(f: Frames) -> str:
    """The sales table as CSV files in which some cells cannot be read."""
    path = work_path(f.spark, "csv")
    bad = (F.col("Store") % 10 == 3) & (F.dayofmonth("Date") == 15)
    write_csv(f.sales.withColumn("Sales", F.when(bad, F.lit("n/a")).otherwise(F.col("Sales").cast("string"))), path)
    return path


_SPOILED = '"Store" % 10 = 3 AND day("Date") = 15'


@query("csv_round_trip", sql("sales_t", f"SELECT * FROM sales_t WHERE NOT ({_SPOILED})"))
def csv_round_trip(f: Frames) -> DataFrame:
    """The lines that can be read in full, with their types."""
    return read_csv(f.spark, _spoiled_csv(f), SALES)


@query(
    "csv_accounts",
    sql(
        "sales_t",
        "SELECT CAST(count(*) AS BIGINT) AS lines, "
        f"CAST(count(*) FILTER (NOT ({_SPOILED})) AS BIGINT) AS rows_read, "
        f"CAST(count(*) FILTER ({_SPOILED}) AS BIGINT) AS refused FROM sales_t",
    ),
)
def csv_accounts(f: Frames) -> DataFrame:
    """Lines written, rows read and lines refused."""
    path = _spoiled_csv(f)
    read = read_csv(f.spark, path, SALES).select(F.lit("rows_read").alias("kind"), "Store")
    odd = refused_csv(f.spark, path, SALES).select(F.lit("refused").alias("kind"), F.length("line").alias("Store"))
    kinds = read.unionByName(odd).unionByName(f.sales.select(F.lit("lines").alias("kind"), "Store"))
    return kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("lines", "rows_read", "refused")])


def _future_records(f: Frames) -> DataFrame:
    return joins.attach_store(f.future, f.store).select(*RECORD.names)


@query("json_records_in", sql("future_t", _RECORDS_SQL))
def json_records_in(f: Frames) -> DataFrame:
    """Future rows as JSON objects and one-element arrays, parsed back to columns."""
    texts = records_out(_future_records(f), "body")
    array = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    mixed = texts.select(F.when(F.xxhash64("body") % 2 == 0, F.col("body")).otherwise(array).alias("body"))
    return records_in(mixed, "body")


_JSON_PAIRS = ", ".join(f"'{n}', \"{n}\"" for n in RECORD.names)


@query(
    "json_records_out",
    sql("future_t", f"SELECT CAST(json_object({_JSON_PAIRS}) AS VARCHAR) AS record FROM ({_RECORDS_SQL})"),
)
def json_records_out(f: Frames) -> DataFrame:
    return records_out(_future_records(f))


_SCALER_ROWS = """
SELECT * FROM (
  SELECT 'competition_distance' AS feature, 'robust' AS method, 'center' AS name, cd_c AS value FROM scales
  UNION ALL SELECT 'competition_distance', 'robust', 'scale', cd_s FROM scales
  UNION ALL SELECT 'competition_time_month', 'robust', 'center', ct_c FROM scales
  UNION ALL SELECT 'competition_time_month', 'robust', 'scale', ct_s FROM scales
  UNION ALL SELECT 'promo_time_week', 'minmax', 'center', pw_c FROM scales
  UNION ALL SELECT 'promo_time_week', 'minmax', 'scale', pw_s FROM scales
  UNION ALL SELECT 'year', 'minmax', 'center', yr_c FROM scales
  UNION ALL SELECT 'year', 'minmax', 'scale', yr_s FROM scales
  UNION ALL SELECT 'store_type', 'level', level, CAST(code AS DOUBLE) FROM types
  UNION ALL SELECT 'state_holiday', 'level', level, CAST(row_number() OVER (ORDER BY level) - 1 AS DOUBLE)
    FROM (SELECT DISTINCT state_holiday AS level FROM train)
  UNION ALL SELECT 'competition_distance', 'fill', 'value',
    (SELECT max(competition_distance) * 10 FROM raw)
)
"""


@query("scaler_params", sql("scales", _SCALER_ROWS))
def scaler_params(f: Frames) -> DataFrame:
    return f.parameter_table


# --- columns -----------------------------------------------------------------
@query("rename_positional", sql("raw", "SELECT * FROM raw"))
def rename_positional(f: Frames) -> DataFrame:
    return columns.rename_positional(f.joined, JOINED_COLUMNS)


@query("rename_snake", sql("raw", "SELECT * FROM raw"))
def rename_snake(f: Frames) -> DataFrame:
    return columns.rename_snake(f.joined)


@query(
    "drop_columns",
    sql("feat", "SELECT * EXCLUDE (customers, open, promo_interval, month_map) FROM feat"),
)
def drop_columns(f: Frames) -> DataFrame:
    return columns.drop_columns(f.features, "customers", "open", "promo_interval", "month_map")


_CYCLES_SQL = ", ".join(
    f"round({fn}({c} * (2 * pi() / {p})), 6) + 0.0 AS {c}_{fn}"
    for c, p in (("day_of_week", 7), ("month", 12), ("day", 30), ("week_of_year", 52))
    for fn in ("sin", "cos")
)
_PREPARED_SQL = f"""
SELECT t.store, t.promo, CAST(y.code AS INTEGER) AS store_type,
  CASE assortment WHEN 'basic' THEN 1 WHEN 'extra' THEN 2 ELSE 3 END AS assortment,
  round((competition_distance - cd_c) / coalesce(nullif(cd_s, 0), 1), 6) + 0.0 AS competition_distance,
  competition_open_since_month, competition_open_since_year, promo2, promo2_since_week,
  promo2_since_year,
  round((competition_time_month - ct_c) / coalesce(nullif(ct_s, 0), 1), 6) + 0.0
    AS competition_time_month,
  round((promo_time_week - pw_c) / coalesce(nullif(pw_s, 0), 1), 6) + 0.0 AS promo_time_week,
  {_CYCLES_SQL}, date, round(ln(1 + sales), 6) + 0.0 AS sales
  {{extra}}
FROM train t CROSS JOIN scales s LEFT JOIN types y ON t.store_type = y.level
"""
_FEATURE_CHAIN_EXTRA = """
  , school_holiday, is_promo, round((year - yr_c) / coalesce(nullif(yr_s, 0), 1), 6) + 0.0 AS year,
  CASE WHEN state_holiday = 'christmas' THEN 1 ELSE 0 END AS state_holiday_christmas,
  CASE WHEN state_holiday = 'easter_holiday' THEN 1 ELSE 0 END AS state_holiday_easter_holiday,
  CASE WHEN state_holiday = 'public_holiday' THEN 1 ELSE 0 END AS state_holiday_public_holiday,
  CASE WHEN state_holiday = 'regular_day' THEN 1 ELSE 0 END AS state_holiday_regular_day
"""


@query("select_features", sql("scales", _PREPARED_SQL.format(extra="")))
def select_features(f: Frames) -> DataFrame:
    return rounded(columns.select_features(f.prepared, ["date", "sales"]))


@query("feature_chain", sql("scales", _PREPARED_SQL.format(extra=_FEATURE_CHAIN_EXTRA)))
def feature_chain(f: Frames) -> DataFrame:
    """Cleaning, features and preparation of the whole training table."""
    return rounded(f.prepared)


NUMERIC = [
    "store", "day_of_week", "sales", "customers", "open", "promo", "school_holiday",
    "competition_distance", "competition_open_since_month", "competition_open_since_year", "promo2",
    "promo2_since_week", "promo2_since_year", "is_promo",
]


@query("numeric_columns", sql("clean", f"SELECT {', '.join(NUMERIC)} FROM clean"))
def numeric_columns(f: Frames) -> DataFrame:
    return columns.numeric_columns(f.clean)


@query(
    "text_columns",
    sql("train", "SELECT state_holiday, store_type, assortment, year_week FROM train"),
)
def text_columns(f: Frames) -> DataFrame:
    return columns.text_columns(f.open_days)


@query(
    "cast_types",
    sql("clean", "SELECT store, date, " + ", ".join(prepare.STARTS) + " FROM clean"),
)
def cast_types(f: Frames) -> DataFrame:
    filled = nulls.fill_from_date(f.raw)
    return columns.cast_integers(filled, *prepare.STARTS).select("store", "date", *prepare.STARTS)


@query("parse_date", sql("raw", "SELECT store, date, sales FROM raw"))
def parse_date(f: Frames) -> DataFrame:
    texts = f.named_sales.select("store", F.date_format("date", "yyyy-MM-dd").alias("date"), "sales")
    return columns.parse_dates(texts, "date")


@query(
    "table_shape",
    sql("raw", "SELECT count(*) AS n_rows, CAST(18 AS BIGINT) AS n_columns FROM raw"),
)
def table_shape(f: Frames) -> DataFrame:
    return columns.table_shape(f.raw)


# The types of the joined table.
_RAW_TYPES = {
    "store": "bigint", "day_of_week": "int", "date": "date", "sales": "bigint", "customers": "bigint", "open": "int",
    "promo": "int", "state_holiday": "string", "school_holiday": "int", "store_type": "string", "assortment": "string",
    "competition_distance": "double", "competition_open_since_month": "double", "competition_open_since_year": "double",
    "promo2": "int", "promo2_since_week": "double", "promo2_since_year": "double", "promo_interval": "string",
}


@query(
    "table_dtypes",
    sql(
        "raw",
        " UNION ALL ".join(
            f"SELECT '{n}' AS column_name, '{t}' AS column_type, count({n}) AS present FROM raw"
            for n, t in _RAW_TYPES.items()
        ),
    ),
)
def table_dtypes(f: Frames) -> DataFrame:
    return columns.column_types(f.raw)


_NOT_SELECTED = [
    "school_holiday", "is_promo", "year", "state_holiday_christmas",
    "state_holiday_easter_holiday", "state_holiday_public_holiday", "state_holiday_regular_day",
]


@query(
    "features_rejected",
    sql(
        "train",
        " UNION ALL ".join(
            f"SELECT '{n}' AS feature WHERE EXISTS (SELECT 1 FROM train)" for n in _NOT_SELECTED
        ),
    ),
)
def features_rejected(f: Frames) -> DataFrame:
    """Prepared columns that are not in the fixed feature list."""
    return columns.names_difference(f.prepared.drop("date", "sales"), FEATURES)


# --- missing values ----------------------------------------------------------
@query(
    "null_counts",
    sql(
        "raw",
        " UNION ALL ".join(
            f"SELECT '{n}' AS attribute, count(*) FILTER ({n} IS NULL) AS nulls FROM raw"
            for n in JOINED_COLUMNS
        ),
    ),
)
def null_counts(f: Frames) -> DataFrame:
    return nulls.null_counts(f.raw)


@query(
    "fill_max10",
    sql(
        "raw",
        """SELECT store, date, coalesce(competition_distance,
             (SELECT max(competition_distance) * 10 FROM raw)) AS competition_distance FROM raw""",
    ),
)
def fill_max10(f: Frames) -> DataFrame:
    return nulls.fill_max10(f.raw.select("store", "date", "competition_distance"), "competition_distance")


@query(
    "fill_constant",
    sql(
        "raw",
        "SELECT store, date, coalesce(competition_distance, 200000.0) AS competition_distance FROM raw",
    ),
)
def fill_constant(f: Frames) -> DataFrame:
    kept = f.raw.select("store", "date", "competition_distance")
    return nulls.fill(kept, "competition_distance", prepare.SERVING_DISTANCE)


@query(
    "fill_from_date",
    sql(
        "raw",
        """SELECT store, date,
          CAST(coalesce(competition_open_since_month, month(date)) AS DOUBLE)
            AS competition_open_since_month,
          CAST(coalesce(competition_open_since_year, year(date)) AS DOUBLE)
            AS competition_open_since_year,
          CAST(coalesce(promo2_since_week, week(date)) AS DOUBLE) AS promo2_since_week,
          CAST(coalesce(promo2_since_year, year(date)) AS DOUBLE) AS promo2_since_year
        FROM raw""",
    ),
)
def fill_from_date(f: Frames) -> DataFrame:
    return nulls.fill_from_date(f.raw.select("store", "date", *prepare.STARTS))


# --- filters -----------------------------------------------------------------
@query("filter_open_sales", sql("raw", "SELECT * FROM raw WHERE open <> 0 AND sales > 0"))
def filter_open_sales(f: Frames) -> DataFrame:
    return rows.open_with_sales(f.raw)


@query(
    "filter_open_nullsafe",
    sql("future_t", 'SELECT * FROM future_t WHERE "Open" IS DISTINCT FROM 0'),
)
def filter_open_nullsafe(f: Frames) -> DataFrame:
    return rows.open_rows(f.future, "Open")


@query(
    "filter_holiday_sales",
    sql("raw", "SELECT * FROM raw WHERE state_holiday <> '0' AND sales > 0"),
)
def filter_holiday_sales(f: Frames) -> DataFrame:
    return rows.holiday_sales(f.raw)


@query("filter_isin", sql("future_t", 'SELECT * FROM future_t WHERE "Store" IN (7, 3, 9)'))
def filter_isin(f: Frames) -> DataFrame:
    return rows.members(f.future, "Store", [7, 3, 9])


@query(
    "filter_not_null",
    sql("future_t", 'SELECT * FROM future_t WHERE "Open" IS NOT NULL AND "Open" <> 0'),
)
def filter_not_null(f: Frames) -> DataFrame:
    return rows.present(rows.open_rows(f.future, "Open"), "Open")


@query(
    "time_split",
    sql(
        "raw",
        """SELECT store, date, sales,
          CASE WHEN date < (SELECT max(date) FROM raw) - 42 THEN 'train' ELSE 'test' END AS part
        FROM raw""",
    ),
)
def time_split(f: Frames) -> DataFrame:
    part = F.when(F.col("date") < F.lit(f.cutoff), "train").otherwise("test")
    return f.named_sales.select("store", "date", "sales", part.alias("part"))


# --- joins -------------------------------------------------------------------
@query(
    "join_sales_store",
    sql("raw", 'SELECT s.*, t.* EXCLUDE ("Store") FROM sales_t s LEFT JOIN store_t t ON s."Store" = t."Store"'),
)
def join_sales_store(f: Frames) -> DataFrame:
    return f.joined


@query(
    "join_store_metrics",
    sql(
        "train",
        """SELECT a.store, a.sales, b.mean_sales, c.last_date
        FROM (SELECT store, CAST(sum(sales) AS BIGINT) AS sales FROM train GROUP BY store) a
        JOIN (SELECT store, round(avg(sales), 6) AS mean_sales FROM train GROUP BY store) b
          ON a.store = b.store
        JOIN (SELECT store, max(date) AS last_date FROM train GROUP BY store) c
          ON a.store = c.store""",
    ),
)
def join_store_metrics(f: Frames) -> DataFrame:
    t = f.sales_days
    latest = t.groupBy("store").agg(F.max("date").alias("last_date"))
    return rounded(
        joins.join_metrics(
            totals.total_by(t, "store"), totals.mean_by(t, "store", name="mean_sales"), latest
        )
    )


@query(
    "join_agg_back",
    sql(
        "train",
        """SELECT t.store, t.date, t.sales, m.mean_sales FROM train t
        LEFT JOIN (SELECT store, round(avg(sales), 6) AS mean_sales FROM train GROUP BY store) m
          ON t.store = m.store""",
    ),
)
def join_agg_back(f: Frames) -> DataFrame:
    kept = f.sales_days.select("store", "date", "sales")
    return rounded(joins.attach_mean(kept, "sales", "mean_sales"))


@query(
    "map_lookup",
    sql("clean", "SELECT store, date, month_map FROM clean"),
)
def map_lookup(f: Frames) -> DataFrame:
    kept = f.named_sales.select("store", "date")
    return joins.map_lookup(kept, "month_map", F.month("date"), MONTH_NAMES)


# --- scalars -----------------------------------------------------------------
@query(
    "date_parts",
    sql("feat", "SELECT store, date, year, month, day, week_of_year FROM feat"),
)
def date_parts(f: Frames) -> DataFrame:
    return f.named_sales.select("store", "date").withColumns(dates.date_parts(F.col("date")))


@query("year_week", sql("feat", "SELECT store, date, year_week FROM feat"))
def year_week(f: Frames) -> DataFrame:
    return f.named_sales.select("store", "date", dates.year_week(F.col("date")).alias("year_week"))


@query(
    "competition_since",
    sql("feat", "SELECT store, date, competition_since, competition_time_month FROM feat"),
)
def competition_since(f: Frames) -> DataFrame:
    return f.dated.select("store", "date", "competition_since", "competition_time_month")


@query("promo_since", sql("feat", "SELECT store, date, promo_since, promo_time_week FROM feat"))
def promo_since(f: Frames) -> DataFrame:
    return f.dated.select("store", "date", "promo_since", "promo_time_week")


@query("is_promo", sql("clean", "SELECT store, date, promo_interval, month_map, is_promo FROM clean"))
def is_promo(f: Frames) -> DataFrame:
    return f.dated.select("store", "date", "promo_interval", "month_map", "is_promo")


@query("decode_categories", sql("feat", "SELECT store, date, assortment, state_holiday FROM feat"))
def decode_categories(f: Frames) -> DataFrame:
    return f.raw.select(
        "store",
        "date",
        encode.assortment_name(F.col("assortment")).alias("assortment"),
        encode.holiday_name(F.col("state_holiday")).alias("state_holiday"),
    )


@query(
    "log_target",
    sql(
        "train",
        """SELECT store, date, round(ln(1 + sales), 6) AS sales,
          round(exp(ln(1 + sales)) - 1, 4) AS restored FROM train""",
    ),
)
def log_target(f: Frames) -> DataFrame:
    logged = scaling.log_target(f.sales_days.select("store", "date", "sales"))
    both = logged.withColumn("restored", F.round(scaling.unlog(F.col("sales")), 4))
    return rounded(both, 6, ["sales"])


@query("cyclic_encoding", sql("train", f"SELECT store, date, {_CYCLES_SQL} FROM train"))
def cyclic_encoding(f: Frames) -> DataFrame:
    parts = f.sales_days.select("store", "date", "day_of_week", "month", "day", "week_of_year")
    return rounded(
        scaling.cyclic_encoding(parts).drop("day_of_week", "month", "day", "week_of_year")
    )


# --- scaling and encoding ----------------------------------------------------
@query(
    "robust_scale",
    sql(
        "scales",
        """SELECT store, date,
          round((competition_distance - cd_c) / coalesce(nullif(cd_s, 0), 1), 6) + 0.0
            AS competition_distance,
          round((competition_time_month - ct_c) / coalesce(nullif(ct_s, 0), 1), 6) + 0.0
            AS competition_time_month
        FROM train CROSS JOIN scales""",
    ),
)
def robust_scale(f: Frames) -> DataFrame:
    kept = f.training.select("store", "date", *prepare.ROBUST)
    parameters = scaling.robust_parameters(kept, prepare.ROBUST)
    return rounded(scaling.scale_columns(kept, parameters))


@query(
    "minmax_scale",
    sql(
        "scales",
        """SELECT store, date,
          round((promo_time_week - pw_c) / coalesce(nullif(pw_s, 0), 1), 6) + 0.0 AS promo_time_week,
          round((year - yr_c) / coalesce(nullif(yr_s, 0), 1), 6) + 0.0 AS year
        FROM train CROSS JOIN scales""",
    ),
)
def minmax_scale(f: Frames) -> DataFrame:
    kept = f.open_days.select("store", "date", *prepare.MINMAX)
    parameters = scaling.minmax_parameters(kept, prepare.MINMAX)
    return rounded(scaling.scale_columns(kept, parameters))


@query(
    "label_encode",
    sql(
        "scales",
        """SELECT store, date, CAST(code AS INTEGER) AS store_type
        FROM train JOIN types ON store_type = level""",
    ),
)
def label_encode(f: Frames) -> DataFrame:
    return scaling.label_encode(f.open_days.select("store", "date", "store_type"), "store_type")


@query(
    "one_hot",
    sql(
        "train",
        "SELECT store, date, "
        + ", ".join(
            f"CASE WHEN state_holiday = '{v}' THEN 1 ELSE 0 END AS state_holiday_{v}"
            for v in ("christmas", "easter_holiday", "public_holiday", "regular_day")
        )
        + " FROM train",
    ),
)
def one_hot(f: Frames) -> DataFrame:
    kept = f.sales_days.select("store", "date", "state_holiday")
    return scaling.one_hot(kept, "state_holiday", scaling.few_levels(kept, "state_holiday"))


@query(
    "ordinal_encode",
    sql(
        "train",
        """SELECT store, date, CASE assortment WHEN 'basic' THEN 1 WHEN 'extra' THEN 2
          WHEN 'extended' THEN 3 END AS assortment FROM train""",
    ),
)
def ordinal_encode(f: Frames) -> DataFrame:
    kept = f.open_days.select("store", "date", "assortment")
    return scaling.ordinal_encode(kept, "assortment", ASSORTMENT_RANK)


@query(
    "average_model",
    sql(
        "scored",
        "SELECT store, date, round(sales, 4) AS sales, round(predictions, 4) AS predictions FROM scored",
    ),
)
def average_model(f: Frames) -> DataFrame:
    return rounded(f.scored_by_average().select("store", "date", "sales", "predictions"), 4)


@query(
    "average_model_on_test",
    sql(
        "scored",
        """SELECT p.store, p.date, round(exp(p.log_sales) - 1, 4) AS sales,
          round(exp(m.mean_log) - 1, 4) AS predictions
        FROM parts p JOIN (SELECT store, avg(log_sales) AS mean_log FROM parts WHERE is_test
          GROUP BY store) m ON p.store = m.store WHERE p.is_test""",
    ),
)
def average_model_on_test(f: Frames) -> DataFrame:
    """The baseline with its means taken from the test rows themselves."""
    scored = f.scored_by_average("test")
    return rounded(scored.select("store", "date", "sales", "predictions"), 4)
