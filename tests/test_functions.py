"""Date, encoding and quantile functions against plain Python."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aislecast.functions import dates, encode
from aislecast.functions import quantiles as q
from aislecast.functions.spreading import salted_join
from aislecast.schemas import ENGLISH_MONTH_NAMES, snake_name


@pytest.fixture(scope="module")
def days(spark):
    first = dt.date(1990, 1, 1)
    rows = [(first + dt.timedelta(days=i),) for i in range(15000)]
    return spark.createDataFrame(rows, "d date")


def test_year_week_is_strftime(days):
    for day, text in days.select("d", dates.year_week(F.col("d"))).collect():
        assert text == day.strftime("%Y-%W")


def test_week_of_year_is_iso(days):
    part = dates.date_parts(F.col("d"))["week_of_year"]
    for day, week in days.select("d", part).collect():
        assert week == day.isocalendar().week


def test_week_before_is_strptime(spark):
    rows = [(y, w) for y in range(1990, 2031) for w in range(1, 54)]
    frame = spark.createDataFrame(rows, "y int, w int")
    found = frame.select("y", "w", dates.week_before(F.col("y"), F.col("w"))).collect()
    for year, week, day in found:
        monday = dt.datetime.strptime(f"{year}-{week}-1", "%Y-%W-%w").date()
        assert day == monday - dt.timedelta(days=7)


def test_whole_periods_floor_below_zero(spark):
    base = dt.date(2015, 1, 1)
    rows = [(base + dt.timedelta(days=i), base) for i in range(-200, 200)]
    frame = spark.createDataFrame(rows, "a date, b date")
    for a, b, months, weeks in frame.select(
        "a", "b", dates.whole_periods(F.col("a"), F.col("b"), 30), dates.whole_periods(F.col("a"), F.col("b"), 7)
    ).collect():
        assert months == ((a - b) / 30).days and weeks == ((a - b) / 7).days


def test_listed_matches_whole_items(spark):
    rows = [
        (None, dt.date(2015, 1, 5)),
        ("Feb,May,Aug,Nov", dt.date(2015, 2, 5)),
        ("Mar,Jun,Sept,Dec", dt.date(2015, 9, 5)),
        ("Jan,Apr,Jul,Oct", dt.date(2015, 1, 5)),
        ("Mayor", dt.date(2015, 5, 5)),
    ]
    frame = spark.createDataFrame(rows, "i string, d date")
    month = encode.month_abbreviation(F.col("d"))
    english = encode.month_abbreviation(F.col("d"), ENGLISH_MONTH_NAMES)
    found = frame.select(encode.listed(month, F.col("i")), encode.listed(english, F.col("i"))).collect()
    assert [r[0] for r in found] == [0, 0, 0, 1, 0]
    assert [r[1] for r in found] == [0, 1, 0, 1, 0]


def test_decode_sends_the_rest_to_the_default(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("c",), ("0",), (None,)], "c string")
    found = frame.select(encode.assortment_name(F.col("c")), encode.holiday_name(F.col("c"))).collect()
    assert [r[0] for r in found] == ["basic", "extra", "extended", "extended", "extended"]
    assert [r[1] for r in found] == [
        "public_holiday", "easter_holiday", "christmas", "regular_day", "regular_day",
    ]


def test_lookup_quotes_text(spark):
    frame = spark.createDataFrame([("it's",), ("a\\b",), ("x",)], "c string")
    found = frame.select(encode.lookup(F.col("c"), {"it's": 1, "a\\b": 2})).collect()
    assert [r[0] for r in found] == [1, 2, None]


def test_snake_names():
    assert snake_name("CompetitionOpenSinceMonth") == "competition_open_since_month"
    assert snake_name("Promo2SinceWeek") == "promo2_since_week"


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(5)
    groups = {
        "hot": np.round(rng.normal(size=3000), 2),
        "tied": np.repeat([1.0, 2.0, 9.0], [500, 3, 1]),
        "one": np.array([7.0]),
        "two": np.array([1.0, 4.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    counts = q.value_counts(frame, ["g"], "v")
    narrowed = q.exact_quantiles(counts, ["g"], probs, few_groups=few, bracket_rows=7)
    direct = q.exact_quantiles(counts, ["g"], probs, few_groups=few)
    for found in (narrowed, direct):
        table = {r["g"]: r for r in found.collect()}
        assert set(table) == set(groups)
        for name, values in groups.items():
            assert table[name]["total"] == len(values)
            np.testing.assert_allclose(table[name]["q"], np.quantile(values, probs), atol=1e-12)


def test_quantiles_of_many_distinct_values(spark):
    """One group of 250,000 distinct values, in brackets of a size that takes two passes."""
    frame = spark.range(250_000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 250_000).cast("double").alias("v"))
    probs = [0.1, 0.5, 0.75]
    row = q.exact_quantiles(q.value_counts(frame, ["g"], "v"), ["g"], probs, bracket_rows=400).first()
    assert row["total"] == 250_000
    np.testing.assert_allclose(row["q"], np.quantile(np.arange(250_000.0), probs))


def test_approximate_quantiles_are_near(spark):
    frame = spark.range(10001).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    row = q.quantiles(frame, ["g"], "v", [0.5], approx=True).first()
    assert abs(row["q"][0] - 5000) < 5


def test_salted_join_is_the_plain_join(spark):
    rows = spark.range(2000).select((F.col("id") % 7 % 3).alias("k"), F.col("id").alias("v"))
    per_key = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    plain = rows.join(per_key, "k", "left")
    salted = salted_join(rows, per_key, ["k"], ["v"], "left")
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


@settings(max_examples=20, deadline=None)
@given(st.dates(dt.date(1900, 1, 1), dt.date(2100, 12, 31)))
def test_year_week_of_any_date(spark, day):
    frame = spark.range(1).select(dates.year_week(F.lit(day)))
    assert frame.first()[0] == day.strftime("%Y-%W")
