"""Operators on hand-made rows, one test per trap."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislecast.catalog import QUERIES
from aislecast.operators import columns, errors, joins, nulls, rows, scaling, shapes, statistics, totals
from aislecast.plans import models, prepare
from aislecast.sources import panel


def values(frame, name):
    return [r[name] for r in frame.collect()]


def test_open_filter_keeps_missing_flag(spark):
    frame = spark.createDataFrame([(None, 5), (0, 5), (1, 5), (1, 0)], "open int, sales long")
    assert values(rows.open_rows(frame), "open") == [None, 1, 1]
    assert rows.open_with_sales(frame).count() == 2


def test_fill_from_date_takes_iso_week_and_calendar_year(spark):
    days = [dt.date(2012, 1, 1), dt.date(2014, 12, 29), dt.date(2015, 12, 31), dt.date(2016, 1, 3)]
    frame = spark.createDataFrame(
        [(d, None, None, None, 1999.0) for d in days],
        "date date, competition_open_since_month double, competition_open_since_year double,"
        "promo2_since_week double, promo2_since_year double",
    )
    filled = nulls.fill_from_date(frame)
    assert values(filled, "promo2_since_week") == [52.0, 1.0, 53.0, 53.0]
    assert values(filled, "competition_open_since_year") == [2012.0, 2014.0, 2015.0, 2016.0]
    assert set(values(filled, "promo2_since_year")) == {1999.0}


def test_fill_max10(spark):
    frame = spark.createDataFrame([(1.0,), (None,), (7.0,)], "x double")
    assert values(nulls.fill_max10(frame, "x"), "x") == [1.0, 70.0, 7.0]


def test_distance_bins_are_right_closed(spark):
    cases = [(0.0, None), (500.0, 1), (1000.0, 1), (1001.0, 2), (19000.0, 19), (19001.0, None), (None, None)]
    frame = spark.createDataFrame([(d,) for d, _ in cases], "d double")
    found = frame.select(totals.distance_bin(F.col("d")).alias("b"))
    assert values(found, "b") == [b for _, b in cases]


def test_empty_distance_bins_are_zero(spark):
    frame = spark.createDataFrame([(500.0, 3), (900.0, 4), (None, 9), (25000.0, 9)], "competition_distance double, sales long")
    found = {r["distance_bin"]: r["sales"] for r in totals.total_by_distance_bin(frame).collect()}
    assert found == {b: 7 if b == 1 else 0 for b in range(1, 20)}


def test_untrusted_text_casts_to_null(spark):
    frame = spark.createDataFrame([("7",), ("x",)], "n string")
    assert values(columns.cast_integers(frame, "n", strict=False), "n") == [7, None]


def test_stack_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3, 4)], "a int, c int")
    assert sorted(map(tuple, totals.stack(a, b).collect())) == [(1, 2, None), (3, None, 4)]


def test_sample_is_repeatable_and_whole_rows(spark):
    frame = spark.range(1000)
    first = sorted(values(rows.sample_rows(frame, 20), "id"))
    again = sorted(values(rows.sample_rows(frame.repartition(5), 20), "id"))
    assert first == again and len(set(first)) == 20
    assert rows.sample_share(frame, 0.1).count() < 300


def test_attach_mean_from_other_rows(spark):
    train = spark.createDataFrame([(1, 2.0), (1, 4.0)], "store long, sales double")
    test = spark.createDataFrame(
        [(1, dt.date(2015, 1, 1), 9.0), (2, dt.date(2015, 1, 1), 9.0)], "store long, date date, sales double"
    )
    found = {r["store"]: r["m"] for r in joins.attach_mean(test, "sales", "m", source=train).collect()}
    assert found == {1: 3.0, 2: None}


def test_describe_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2.0, size=500), 3)
    frame = spark.createDataFrame([(float(v), 3) for v in x], "x double, flat int")
    table = {r["attribute"]: r for r in statistics.describe_numeric(frame).collect()}
    n, m = len(x), x.mean()
    m2, m3, m4 = (((x - m) ** p).mean() for p in (2, 3, 4))
    g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
    row = table["x"]
    assert row["std"] == pytest.approx(x.std()) and row["median"] == pytest.approx(np.median(x))
    assert row["skew"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert table["flat"]["std"] == 0 and table["flat"]["skew"] is None


def test_corr_matrix_both_ways(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 7))
    data[:, 1] += data[:, 0]
    names = [f"c{i}" for i in range(7)]
    frame = spark.createDataFrame(data.tolist(), names)
    expected = np.corrcoef(data.T)
    for chosen in (names, names[:4]):
        for r in statistics.corr_matrix(frame, chosen).collect():
            assert r["r"] == pytest.approx(expected[int(r["col_a"][1]), int(r["col_b"][1])])


def test_corr_matrix_with_gaps_uses_complete_pairs(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(50, 7))
    table = [[None if (i, j) == (0, 0) else float(v) for j, v in enumerate(row)] for i, row in enumerate(data)]
    names = [f"c{i}" for i in range(7)]
    frame = spark.createDataFrame(table, ", ".join(f"{n} double" for n in names))
    found = {(r["col_a"], r["col_b"]): r["r"] for r in statistics.corr_matrix(frame).collect()}
    assert len(found) == 49
    assert found["c0", "c1"] == pytest.approx(np.corrcoef(data[1:, 0], data[1:, 1])[0, 1])
    assert found["c2", "c1"] == pytest.approx(np.corrcoef(data[:, 2], data[:, 1])[0, 1])


def brute_cramers_v(table):
    table = np.array(table, dtype=float)
    n, (r, k) = table.sum(), table.shape
    e = np.outer(table.sum(1), table.sum(0)) / n
    gap = np.abs(table - e)
    if r == k == 2:
        gap = gap - np.minimum(0.5, gap)
    chi2 = max(0, (gap**2 / e).sum() - (k - 1) * (r - 1) / (n - 1))
    kc, rc = k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)
    return math.sqrt(chi2 / n / min(kc - 1, rc - 1))


@pytest.mark.parametrize("table", [[[10, 3], [2, 12]], [[0, 5], [7, 1]], [[8, 0, 3], [1, 9, 2]], [[5, 0], [0, 5]]])
def test_cramers_v_equals_brute_force(spark, table):
    pairs = [(f"r{i}", f"c{j}") for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    assert statistics.cramers_v(frame, "a", "b").first()["v"] == pytest.approx(brute_cramers_v(table))
    matrix = {(r["x"], r["y"]): r["v"] for r in statistics.cramers_v_matrix(frame, ["a", "b"]).collect()}
    assert matrix["a", "b"] == matrix["b", "a"] == pytest.approx(brute_cramers_v(table))


def test_cramers_v_of_one_level_is_null(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "y")], "a string, b string")
    assert statistics.cramers_v(frame, "a", "b").first()["v"] is None
    assert statistics.cramers_v(frame, "a", "b", published=True).first()["v"] is None


def test_histogram_closes_the_last_bin(spark):
    frame = spark.createDataFrame([(0.0, 1), (1.0, 1), (9.0, 1), (10.0, 1), (None, 1)], "x double, flat int")
    found = {(r["attribute"], r["bin"]): r["n"] for r in shapes.histogram(frame, bins=5).collect()}
    assert [found["x", b] for b in range(5)] == [2, 0, 0, 0, 2]
    assert found["flat", 0] == 5 and len(found) == 10


def test_binned_density_is_as_near_as_stated(spark):
    rng = np.random.default_rng(4)
    data = [("a", float(v)) for v in rng.normal(5, 2, 3000)] + [("b", float(v)) for v in rng.lognormal(0, 2, 2000)]
    data += [("few", 1.0), ("few", 4.0), ("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", None), (None, 1.0), (None, 9.0)]
    df = spark.createDataFrame(data, "g string, v double")
    exact = {(r["g"], r["point"]): r for r in shapes.kernel_density(df, "g", "v").collect()}
    for tolerance in (1e-2, 1e-4):
        binned = {(r["g"], r["point"]): r for r in shapes.binned_density(df, "g", "v", tolerance=tolerance).collect()}
        assert binned.keys() == exact.keys() and {g for g, _ in binned} == {"a", "b", "few"}
        for g in ("a", "b", "few"):
            values = np.array([v for group, v in data if group == g])
            kernel = 1 / (values.std(ddof=1) * len(values) ** -0.2 * np.sqrt(2 * np.pi))
            off = max(abs(binned[g, p]["density"] - exact[g, p]["density"]) for p in range(200))
            assert off <= tolerance * kernel and all(np.isclose(binned[g, p]["at"], exact[g, p]["at"]) for p in range(200))


def test_kernel_density_integrates_to_one(spark):
    rng = np.random.default_rng(4)
    data = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.normal(5, 2, size=100)]
    curve = shapes.kernel_density(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()
    for name in "ab":
        part = sorted((r["at"], r["density"]) for r in curve if r["g"] == name)
        x, y = np.array(part).T
        assert np.trapezoid(y, x) == pytest.approx(1.0, abs=0.01)


def test_box_stats(spark):
    data = [("a", float(v)) for v in [1, 2, 3, 4, 100]]
    row = shapes.box_stats(spark.createDataFrame(data, "g string, v double"), ["g"], "v").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["low"], row["high"], row["outliers"], row["n"]) == (1.0, 4.0, 1, 5)


def test_constant_column_scales_to_zero(spark):
    frame = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (5.0, 8.0)], "c double, v double")
    for fit in (scaling.robust_parameters, scaling.minmax_parameters):
        scaled = scaling.scale_columns(frame, fit(frame, ["c", "v"]))
        assert values(scaled, "c") == [0.0, 0.0, 0.0]
        center, scale = fit(frame, ["v"]).first()[1:]
        back = scaled.select(scaling.unscaled(F.col("v"), center, scale).alias("v"))
        assert values(back, "v") == pytest.approx([1.0, 3.0, 8.0])


def test_label_codes_of_many_levels(spark):
    levels = [f"k{i:05d}" for i in range(3000)]
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(levels)] * 2 + [(None, -1)], "k string, i int")
    coded = scaling.label_encode(frame, "k")
    assert coded.columns == ["k", "i"] and coded.count() == 6001
    assert coded.where("k <> i").count() == 0 and coded.where("k IS NULL").count() == 1


def test_few_levels_take_the_literal_way(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string")
    assert values(scaling.label_encode(frame, "k"), "k") == [1, 0, 2, 0]
    assert scaling.one_hot(frame, "k", ["a", "b", "c"]).columns == ["k_a", "k_b", "k_c"]


def test_zero_sales_do_not_break_errors(spark):
    frame = spark.createDataFrame([(0.0, 1.0), (10.0, 8.0)], "sales double, predictions double")
    row = errors.ml_error(frame, "m").first()
    assert row["mae"] == 1.5 and row["mape"] > 1e10 and row["rmse"] == pytest.approx(math.sqrt(2.5))
    assert errors.mean_percentage_error(frame).first()["mpe"] == pytest.approx(0.2)
    assert values(errors.row_errors(frame), "error_rate") == [None, 0.8]


def test_scenarios_are_ordered(spark):
    frame = spark.createDataFrame([(1, 10.0, 12.0), (1, 10.0, 7.0), (2, 5.0, 5.0)], "store long, sales double, predictions double")
    for r in errors.store_scenarios(frame).collect():
        assert r["worst_scenario"] <= r["predictions"] <= r["best_scenario"]
    texts = {r["scenario"]: r["values"] for r in errors.scenario_totals(errors.store_scenarios(frame)).collect()}
    assert texts["predictions"] == "R$24.00" and texts["best_scenario"] == "R$26.50"


def test_folds_share_their_border_day(spark):
    last = dt.date(2015, 7, 31)
    frame = spark.createDataFrame([(last - dt.timedelta(days=i),) for i in range(300)], "date date")
    folds = errors.cv_folds(frame, last, 5).collect()
    assert [r["validation_rows"] for r in folds] == [43] * 5
    assert [r["train_rows"] for r in folds] == [299 - 42 * k for k in range(1, 6)]
    hits = frame.select(F.explode(errors.validation_folds(F.col("date"), last, 5)).alias("fold"))
    assert {r["fold"]: r["count"] for r in hits.groupBy("fold").count().collect()} == {k: 43 for k in range(1, 6)}
    for k in range(1, 6):
        train, valid = errors.fold_split(frame, last, k)
        assert (train.count(), valid.count()) == (299 - 42 * k, 43)


def test_cv_summary_text(spark):
    frame = spark.createDataFrame([("m", 1.0, 0.1, 2.0), ("m", 3.0, 0.3, 4.0)], "model_name string, mae double, mape double, rmse double")
    row = errors.cv_summary(frame).first()
    assert row["mae_cv"] == "2.0 +/- 1.0" and row["mape_cv"] == "0.2 +/- 0.1"


def test_average_folds_equal_the_plain_loop(spark):
    last = dt.date(2015, 7, 31)
    data = [(s, last - dt.timedelta(days=i), float(3 + s + i % 5)) for s in (1, 2) for i in range(300)]
    frame = spark.createDataFrame(data, "store long, date date, sales double")

    def fit_predict(train, valid):
        return models.average_model(train, valid)

    loop = models.fold_errors(models.fold_predictions(frame, last, 3, fit_predict), "Average Model")
    fast = models.cross_validate_average(frame, last, 3)
    a = sorted(map(tuple, loop.collect()))
    b = sorted(map(tuple, fast.collect()))
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])


def test_features_before_and_after_the_start(spark):
    day = dt.date(2015, 3, 1)
    frame = spark.createDataFrame(
        [(d, 2015, 3, 2015, 10) for d in (day - dt.timedelta(days=1), day)],
        "date date, competition_open_since_year int, competition_open_since_month int,"
        "promo2_since_year int, promo2_since_week int",
    ).withColumns({"assortment": F.lit("a"), "state_holiday": F.lit("0")})
    found = prepare.add_features(frame).collect()
    assert [r["competition_time_month"] for r in found] == [-1, 0]
    assert {r["promo_since"] for r in found} == {dt.date(2015, 3, 2)}
    assert [r["promo_time_week"] for r in found] == [-1, -1]


def odd_lines(spark):
    """Line items with several a day, closed days, negative amounts and nulls."""
    days = ["1995-12-25", "1996-12-26", "1995-04-01", "1997-04-02", "1995-01-01", "1996-05-01", "1998-10-03", "1996-02-29", None]
    numbers = [(10, 100.5), (3, 50.0), (None, 10.0), (7, -20.0), (6, None)]
    lines = [
        (store, i % 5, None if quantity is None else float(quantity), price, 0.1, day)
        for store in (1, 2, None)
        for i, day in enumerate(days)
        for quantity, price in numbers[: 1 + (i + (store or 0)) % 5]
    ]
    schema = "l_suppkey long, l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, day string"
    return spark.createDataFrame(lines, schema).selectExpr("*", "CAST(day AS TIMESTAMP) AS l_shipdate").drop("day")


def test_sales_dealt_by_store_and_day_are_the_same_rows(spark):
    plain, spread = (panel.sales_panel(odd_lines(spark), spread=s) for s in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))
    codes = {r["StateHoliday"] + ("" if r["Date"] is None else f"{r['Date']:%m-%d}") for r in spread.collect()}
    assert codes == {"c12-25", "c12-26", "b04-01", "b04-02", "a01-01", "a05-01", "a10-03", "002-29", "0"}


def test_distinct_values_groups_no_line_items_before_they_are_dealt(spark, tmp_path):
    odd_lines(spark).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["distinct_values"](spark, str(tmp_path))
    names = {"christmas", "easter_holiday", "public_holiday", "regular_day"}
    assert {r["state_holiday"] for r in found.collect()} == names
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan.rpartition("REPARTITION_BY_COL")
    assert below[1] and "Aggregate" not in below[2] and "l_orderkey" not in plan
