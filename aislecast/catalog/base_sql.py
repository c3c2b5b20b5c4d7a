"""The panel, cleaning and feature steps in DuckDB SQL, as chained CTEs."""

from __future__ import annotations

STORE_T = """
store_t AS (
  SELECT s_suppkey AS "Store",
    substr('abcd', CAST(s_nationkey % 4 + 1 AS INTEGER), 1) AS "StoreType",
    substr('abc', CAST(s_suppkey % 3 + 1 AS INTEGER), 1) AS "Assortment",
    CASE WHEN s_suppkey % 10 = 3 THEN NULL
         ELSE CAST(floor((s_acctbal + 1000) / 4) AS DOUBLE) * 10 END AS "CompetitionDistance",
    CASE WHEN s_suppkey % 3 = 1 THEN NULL
         ELSE CAST(s_suppkey % 12 + 1 AS DOUBLE) END AS "CompetitionOpenSinceMonth",
    CASE WHEN s_suppkey % 3 = 1 THEN NULL
         ELSE CAST(1990 + s_suppkey % 12 AS DOUBLE) END AS "CompetitionOpenSinceYear",
    CAST(s_suppkey % 2 AS INTEGER) AS "Promo2",
    CASE WHEN s_suppkey % 2 = 0 THEN NULL
         ELSE CAST(s_suppkey % 52 + 1 AS DOUBLE) END AS "Promo2SinceWeek",
    CASE WHEN s_suppkey % 2 = 0 THEN NULL
         ELSE CAST(1995 + s_suppkey % 6 AS DOUBLE) END AS "Promo2SinceYear",
    CASE WHEN s_suppkey % 2 = 0 THEN NULL
         WHEN s_suppkey % 3 = 0 THEN 'Jan,Apr,Jul,Oct'
         WHEN s_suppkey % 3 = 1 THEN 'Feb,May,Aug,Nov'
         ELSE 'Mar,Jun,Sept,Dec' END AS "PromoInterval"
  FROM supplier
)"""

SALES_T = """
days_t AS (
  SELECT l_suppkey AS store, CAST(l_shipdate AS DATE) AS d,
    count(DISTINCT l_orderkey) AS customers,
    max(l_quantity) AS largest,
    CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)) AS BIGINT) AS amount
  FROM lineitem GROUP BY 1, 2
),
sales_t AS (
  SELECT store AS "Store", CAST(isodow(d) AS INTEGER) AS "DayOfWeek", d AS "Date",
    CASE WHEN largest < 5 THEN CAST(0 AS BIGINT) ELSE amount END AS "Sales",
    customers AS "Customers",
    CASE WHEN largest < 5 THEN 0 ELSE 1 END AS "Open",
    CASE WHEN isodow(d) <= 5 AND week(d) % 2 = 1 THEN 1 ELSE 0 END AS "Promo",
    CASE WHEN strftime(d, '%m-%d') IN ('12-25', '12-26') THEN 'c'
         WHEN strftime(d, '%m-%d') IN ('04-01', '04-02') THEN 'b'
         WHEN strftime(d, '%m-%d') IN ('01-01', '05-01', '10-03') THEN 'a'
         ELSE '0' END AS "StateHoliday",
    CASE WHEN month(d) IN (7, 8) THEN 1 ELSE 0 END AS "SchoolHoliday"
  FROM days_t
)"""

FUTURE_T = """
future_t AS (
  SELECT CAST("Store" * 100000 + date_diff('day', DATE '1995-01-01', "Date") AS BIGINT) AS "Id",
    "Store", "DayOfWeek", "Date",
    CASE WHEN "Store" % 7 = 5 THEN NULL ELSE "Open" END AS "Open",
    "Promo", "StateHoliday", "SchoolHoliday"
  FROM sales_t
  WHERE "Date" >= (SELECT max("Date") FROM sales_t) - 42
)"""

RAW = """
raw AS (
  SELECT s."Store" AS store, "DayOfWeek" AS day_of_week, "Date" AS date, "Sales" AS sales,
    "Customers" AS customers, "Open" AS open, "Promo" AS promo, "StateHoliday" AS state_holiday,
    "SchoolHoliday" AS school_holiday, "StoreType" AS store_type, "Assortment" AS assortment,
    "CompetitionDistance" AS competition_distance,
    "CompetitionOpenSinceMonth" AS competition_open_since_month,
    "CompetitionOpenSinceYear" AS competition_open_since_year, "Promo2" AS promo2,
    "Promo2SinceWeek" AS promo2_since_week, "Promo2SinceYear" AS promo2_since_year,
    "PromoInterval" AS promo_interval
  FROM sales_t s LEFT JOIN store_t t ON s."Store" = t."Store"
)"""

MONTHS = (
    "['Jan','Fev','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month(date)]"
)

CLEAN = f"""
filled AS (
  SELECT * REPLACE (
    coalesce(competition_distance, (SELECT max(competition_distance) * 10 FROM raw))
      AS competition_distance,
    CAST(coalesce(competition_open_since_month, month(date)) AS INTEGER)
      AS competition_open_since_month,
    CAST(coalesce(competition_open_since_year, year(date)) AS INTEGER)
      AS competition_open_since_year,
    CAST(coalesce(promo2_since_week, week(date)) AS INTEGER) AS promo2_since_week,
    CAST(coalesce(promo2_since_year, year(date)) AS INTEGER) AS promo2_since_year),
    {MONTHS} AS month_map
  FROM raw
),
clean AS (
  SELECT *, CASE WHEN promo_interval IS NOT NULL
      AND list_contains(string_split(promo_interval, ','), month_map)
    THEN 1 ELSE 0 END AS is_promo
  FROM filled
)"""

FEAT = """
dated AS (
  SELECT * REPLACE (
    CASE assortment WHEN 'a' THEN 'basic' WHEN 'b' THEN 'extra' ELSE 'extended' END AS assortment,
    CASE state_holiday WHEN 'a' THEN 'public_holiday' WHEN 'b' THEN 'easter_holiday'
      WHEN 'c' THEN 'christmas' ELSE 'regular_day' END AS state_holiday),
    CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
    CAST(day(date) AS INTEGER) AS day, CAST(week(date) AS INTEGER) AS week_of_year,
    strftime(date, '%Y-%W') AS year_week,
    make_date(competition_open_since_year, competition_open_since_month, 1) AS competition_since,
    make_date(promo2_since_year, 1, 1)
      + CAST((8 - isodow(make_date(promo2_since_year, 1, 1))) % 7
             + 7 * (promo2_since_week - 2) AS INTEGER) AS promo_since
  FROM clean
),
feat AS (
  SELECT *,
    CAST(floor(date_diff('day', competition_since, date) / 30.0) AS INTEGER)
      AS competition_time_month,
    CAST(floor(date_diff('day', promo_since, date) / 7.0) AS INTEGER) AS promo_time_week
  FROM dated
)"""

TRAIN = """
train AS (
  SELECT * EXCLUDE (customers, open, promo_interval, month_map)
  FROM feat WHERE open <> 0 AND sales > 0
)"""

PARAMS = """
scales AS (
  SELECT quantile_cont(competition_distance, 0.5) AS cd_c,
    quantile_cont(competition_distance, 0.75) - quantile_cont(competition_distance, 0.25) AS cd_s,
    quantile_cont(CAST(competition_time_month AS DOUBLE), 0.5) AS ct_c,
    quantile_cont(CAST(competition_time_month AS DOUBLE), 0.75)
      - quantile_cont(CAST(competition_time_month AS DOUBLE), 0.25) AS ct_s,
    CAST(min(promo_time_week) AS DOUBLE) AS pw_c,
    CAST(max(promo_time_week) - min(promo_time_week) AS DOUBLE) AS pw_s,
    CAST(min(year) AS DOUBLE) AS yr_c, CAST(max(year) - min(year) AS DOUBLE) AS yr_s
  FROM train
),
types AS (
  SELECT store_type AS level, row_number() OVER (ORDER BY store_type) - 1 AS code
  FROM (SELECT DISTINCT store_type FROM train)
)"""

# Average model: mean log sales per store before the last six weeks.
AVERAGE = """
parts AS (
  SELECT *, ln(1 + sales) AS log_sales,
    date >= (SELECT max(date) FROM raw) - 42 AS is_test
  FROM train
),
store_means AS (
  SELECT store, avg(log_sales) AS mean_log FROM parts WHERE NOT is_test GROUP BY store
),
scored AS (
  SELECT p.store, p.date, exp(p.log_sales) - 1 AS sales, exp(m.mean_log) - 1 AS predictions
  FROM parts p LEFT JOIN store_means m ON p.store = m.store
  WHERE p.is_test
)"""

_CHAIN = [
    ("store_t", STORE_T),
    ("sales_t", SALES_T),
    ("future_t", FUTURE_T),
    ("raw", RAW),
    ("clean", CLEAN),
    ("feat", FEAT),
    ("train", TRAIN),
    ("scales", PARAMS),
    ("scored", AVERAGE),
]
_SKIP = {"future_t"}


def sql(upto: str, body: str) -> str:
    """``body`` after the CTEs up to and including ``upto``."""
    parts = []
    for name, text in _CHAIN:
        if name == upto or name not in _SKIP and not (name == "scales" and upto == "scored"):
            parts.append(text.strip())
        if name == upto:
            break
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
