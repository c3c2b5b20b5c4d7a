"""Models on a planted signal, feature selection, scoring and the stream."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislecast.catalog.frames import Frames
from aislecast.operators import errors, rows
from aislecast.plans import models, selection
from aislecast.plans.forecast import Forecaster, future_records, save_forecaster, six_week_forecast
from aislecast.plans.prepare import fit_parameters, prepare
from aislecast.schemas import FUTURE, RECORD, SALES, STORE
from aislecast.session import work_path
from aislecast.sources import records, tables, versions
from aislecast.sources.parameters import Parameters, load_parameters, save_parameters
from aislecast.streaming import scoring
from aislecast.streaming.scoring import refuse_stream, score_stream

SMALL = "/root/testdata/sf0.001"
NAMES = ["lin_a", "lin_b", "step", "noise_a", "noise_b"]
LAST = dt.date(2015, 10, 27)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 5))
    y = 8 + 0.5 * x[:, 0] - 0.3 * x[:, 1] + 0.6 * (x[:, 2] > 0) + rng.normal(scale=0.05, size=2000)
    table = [
        (i % 10, LAST - dt.timedelta(days=int(i % 300)), *map(float, x[i]), float(y[i])) for i in range(2000)
    ]
    schema = "store long, date date, " + ", ".join(f"{n} double" for n in NAMES) + ", sales double"
    frame = spark.createDataFrame(table, schema).persist()
    yield frame
    frame.unpersist()


def plain_lasso(x, y, alpha, rounds=2000):
    """Coordinate descent for 1/(2n) RSS + alpha L1 on centred data."""
    x, y = x - x.mean(0), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(w)):
            rest = y - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ rest / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (x[:, j] @ x[:, j] / len(y))
    return w


def test_least_squares_recovers_the_plane(planted):
    fitted = models.fit(models.linear(NAMES[:2]), planted).stages[-1]
    assert fitted.coefficients.toArray() == pytest.approx([0.5, -0.3], abs=0.03)


def test_lasso_equals_coordinate_descent(planted):
    local = planted.select(*NAMES, "sales").toPandas().to_numpy()
    fitted = models.fit(models.lasso(0.05, NAMES), planted).stages[-1]
    assert fitted.coefficients.toArray() == pytest.approx(plain_lasso(local[:, :5], local[:, 5], 0.05), abs=1e-5)


def test_trees_beat_the_average(planted):
    train, test = rows.split_by_date(planted, rows.holdout_start(LAST))
    average = errors.ml_error(models.average_model(train, test), "a").first()["rmse"]
    for model in (
        models.forest(20, 6, 32, features=NAMES),
        models.boosted(15, 0.3, 4, 0.7, 0.9, 3, bins=32, features=NAMES),
    ):
        assert models.holdout_error("m", model, train, test).first()["rmse"] < 0.6 * average


def test_cross_validation_and_search(planted):
    table = models.cross_validate(planted, LAST, 3, "ols", models.linear(NAMES)).first()
    assert table["model_name"] == "ols" and table["rmse_std"] >= 0
    draws = models.draw_parameters(draws=10)
    assert len(draws) == 10 and draws == models.draw_parameters(draws=10)
    assert all(d[k] in v for d in draws for k, v in models.SEARCH_GRID.items())


def test_staged_errors_equal_separate_fits(planted):
    """Draws that differ in rounds alone share a fit; its stages are the fits with fewer rounds."""
    few, many = (models.boosted(n, 0.3, 3, 0.7, 0.9, 3, bins=32, features=NAMES) for n in (4, 9))
    other = models.boosted(5, 0.1, 2, bins=32, features=NAMES)
    draws = {0: few, 1: many, 2: other}
    together = {(r["draw"], r["fold"]): r for r in models.staged_fold_errors(planted, LAST, 2, draws).collect()}
    assert len(together) == 6
    for draw, model in draws.items():
        for row in models.staged_fold_errors(planted, LAST, 2, {draw: model}).collect():
            assert row["rmse"] == pytest.approx(together[draw, row["fold"]]["rmse"], rel=1e-9)
    # A fold by hand: bins are those of all rows before the last fold.
    train, valid = errors.fold_split(planted, LAST, 1)
    alone = models.holdout_error("m", few, train, valid).first()["rmse"]
    assert together[0, 1]["rmse"] == pytest.approx(alone, rel=1e-9)


def test_random_search_ranks_by_error(spark):
    f = Frames(spark, SMALL)
    grid = {**models.SEARCH_GRID, "n_estimators": [2], "max_depth": [2]}
    kept = f.feature_rows.persist()
    found = models.random_search(kept, f.last, folds=2, draws=2, grid=grid, bins=16).collect()
    kept.unpersist()
    assert sorted(r["draw"] for r in found) == [0, 1]
    assert found[0]["rmse_mean"] <= found[1]["rmse_mean"]


def test_comparison_is_ranked(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "model_name string, rmse double")
    b = spark.createDataFrame([("z", 2.0, 1.0)], "model_name string, rmse double, mae double")
    assert [r["model_name"] for r in models.compare_models([a, b]).collect()] == ["y", "z", "x"]


def test_selection_keeps_the_planted_features(planted):
    found = selection.boruta_select(planted, NAMES, "sales", max_iter=15, depth=5).collect()
    decided = {r["feature"]: r["decision"] for r in found}
    assert {n for n, d in decided.items() if d == "accepted"} == {"lin_a", "lin_b", "step"}
    assert decided["noise_a"] != "accepted" and decided["noise_b"] != "accepted"


def test_shadows_are_permutations(planted):
    spread = selection.spread_rows(planted, NAMES, "sales")
    both = selection.with_shadows(spread, NAMES, 1).toPandas()
    assert len(both) == 2000
    for name in NAMES:
        assert np.allclose(np.sort(both[name]), np.sort(both[selection.SHADOW + name]))
        assert abs(np.corrcoef(both[name], both[selection.SHADOW + name])[0, 1]) < 0.2


def test_shadows_of_clustered_rows_lose_their_link(spark):
    """Rows that lie together in the source, with an advisory size that makes Spark split partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        rows = spark.range(0, 200_000, 1, 8).select(
            F.floor(F.col("id") / 5000).cast("double").alias("store"), F.rand(3).alias("sales")
        )
        spread = selection.spread_rows(rows, ["store"], "sales", part_rows=10_000)
        assert spread.rdd.getNumPartitions() == 20
        both = selection.with_shadows(spread, ["store"], 5)
        assert both.select(F.spark_partition_id().alias("p"), "store").distinct().count() == 20 * 40
        assert abs(both.agg(F.corr("store", "shadow_store")).first()[0]) < 0.05
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_registered_selection_decides(spark):
    from aislecast.catalog import QUERIES

    decisions = {r["feature"]: r["decision"] for r in QUERIES["boruta_select_small"](spark, SMALL).collect()}
    assert {"accepted", "rejected"} & set(decisions.values())


@pytest.mark.parametrize("name", ["score_batch", "six_week_forecast", "stream_scoring"])
def test_scoring_queries_score_every_open_record(spark, name):
    from aislecast.catalog import QUERIES

    f = Frames(spark, SMALL)
    found = QUERIES[name](spark, SMALL).collect()
    records = future_records(f.future, f.store)
    expected = records.count() if name != "six_week_forecast" else records.select("Store").distinct().count()
    assert len(found) == expected > 0
    assert all(r["prediction"] > 0 for r in found)


def test_scoring_queries_fit_the_first_boosted_model_in_full():
    model = models.boosted(**models.FIRST_BOOSTED)
    assert (model.rounds, model.depth, model.rate, model.l2, model.base) == (100, 10, 0.01, 1.0, 0.5)
    tuned = models.boosted(**models.TUNED)
    assert (tuned.rounds, tuned.depth, tuned.bins, len(tuned.columns(7))) == (3000, 5, 256, 14)


def test_selection_runs_until_all_rounds_are_used(planted, monkeypatch):
    depths = []

    def importances(rows, inputs, label, seed, depth, bins):
        depths.append(depth)
        # Every feature beats its shadow in every second round, so none is decided.
        half = np.arange(len(inputs)) * 2 < len(inputs)
        return (half if len(depths) % 2 else ~half).astype(float)

    monkeypatch.setattr(selection, "importances", importances)
    found = selection.boruta_select(planted, NAMES, "sales", max_iter=30).collect()
    assert depths == [None] * 30
    assert {r["decision"] for r in found} == {"tentative"}


def test_coin_tails_and_false_discovery():
    assert selection.upper_tail(0, 10) == 1 and selection.lower_tail(10, 10) == 1
    assert selection.upper_tail(9, 10) == pytest.approx(11 / 1024)
    assert selection.false_discovery([0.001, 0.04, 0.9], 0.05) == [True, False, False]
    assert selection.false_discovery([0.001, 0.03, 0.9], 0.05) == [True, True, False]


# --- sources -----------------------------------------------------------------
def test_csv_with_header_and_missing_values(spark, tmp_path):
    (tmp_path / "store.csv").write_text(
        ",".join(STORE.names) + "\n1,a,c,1270.0,9,2008,0,,,\n2,b,a,,,,1,13,2010,\"Jan,Apr,Jul,Oct\"\n"
    )
    first, second = tables.read_store(spark, str(tmp_path / "store.csv")).orderBy("Store").collect()
    assert first["CompetitionDistance"] == 1270.0 and first["PromoInterval"] is None
    assert second["CompetitionDistance"] is None and second["PromoInterval"] == "Jan,Apr,Jul,Oct"
    (tmp_path / "sales.csv").write_text(",".join(SALES.names) + "\n1,5,2015-07-31,5263,555,1,1,0,1\n")
    row = tables.read_sales(spark, str(tmp_path / "sales.csv")).first()
    assert row["Date"] == dt.date(2015, 7, 31) and row["StateHoliday"] == "0"
    (tmp_path / "future.csv").write_text(",".join(FUTURE.names) + "\n1,1,4,2015-09-17,,1,0,0\n")
    assert tables.read_future(spark, str(tmp_path / "future.csv")).first()["Open"] is None


def test_month_folders_are_pruned(spark, tmp_path):
    f = Frames(spark, SMALL)
    tables.write_by_month(f.sales, str(tmp_path / "sales"))
    back = spark.read.parquet(str(tmp_path / "sales"))
    assert back.count() == f.sales.count()
    since = f.sales.groupBy("Store").agg(F.date_sub(F.max("Date"), 42).alias("since"))
    recent = tables.rows_since(back, since, f.last)
    plan = recent._sc._jvm.PythonSQLUtils.explainString(recent._jdf.queryExecution(), "formatted")
    assert "dynamicpruning" in plan
    expected = f.sales.join(since, "Store").where("Date >= since")
    assert recent.select(*f.sales.columns).exceptAll(expected.select(*f.sales.columns)).count() == 0
    assert recent.count() == expected.count() > 0


def test_csv_lines_read_and_refused_are_all_lines(spark, tmp_path):
    good = "1,5,2015-07-31,5263,555,1,1,0,1"
    odd = ["2,5,2015-07-31,many,555,1,1,0,1", "3,5,2015-31-07,5263,555,1,1,0,1", "x", "4,5,2015-07-31,1,1,1,1,0,1,9,9"]
    (tmp_path / "sales.csv").write_text("\n".join([",".join(SALES.names), good, *odd, good.replace("5263", "")]) + "\n")
    path = str(tmp_path / "sales.csv")
    rows_read = tables.read_sales(spark, path)
    assert rows_read.columns == SALES.names
    assert sorted(str(r["Sales"]) for r in rows_read.collect()) == ["5263", "None"]
    assert sorted(r["line"] for r in tables.refused_csv(spark, path, SALES).collect()) == sorted(odd)


def test_readers_get_whole_versions(spark):
    path = work_path(spark, "versions")
    with pytest.raises(FileNotFoundError):
        versions.published(spark, path)
    frame = spark.range(3)

    def half_done(folder):
        frame.write.parquet(f"{folder}/a")
        raise RuntimeError("the writer dies")

    def whole(number):
        def write(folder):
            frame.withColumn("v", F.lit(number)).write.parquet(f"{folder}/a")
            if number > 1:  # a reader during the second save still gets the first
                assert read() == 1
            frame.withColumn("v", F.lit(number)).write.parquet(f"{folder}/b")

        return write

    def read():
        folder = versions.published(spark, path)
        (one,), (two,) = ({r["v"] for r in spark.read.parquet(f"{folder}/{n}").collect()} for n in "ab")
        assert one == two
        return one

    assert versions.publish(spark, path, whole(1)) == 1 and read() == 1
    with pytest.raises(RuntimeError):
        versions.publish(spark, path, half_done)
    assert read() == 1
    assert versions.publish(spark, path, whole(2)) == 2 and read() == 2
    assert versions.published(spark, path, 1) != versions.published(spark, path)
    versions.drop_versions(spark, path, keep=1)
    assert read() == 2
    with pytest.raises(FileNotFoundError):
        versions.published(spark, path, 1)


def test_json_object_array_and_empty(spark):
    texts = [
        '{"Store": 1, "Date": "2015-09-17", "Open": 1}',
        '[{"Store": 2}, {"Store": 3, "Open": null}]',
        "{}",
        "[ ]",
        "",
    ]
    found = records.records_in(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert found.columns == RECORD.names
    assert sorted(r["Store"] for r in found.collect()) == [1, 2, 3]


def test_records_out_name_every_field(spark):
    frame = spark.createDataFrame([(1, None, dt.date(2015, 1, 2))], "a int, b string, d date")
    text = records.records_out(frame).first()["record"]
    assert json.loads(text) == {"a": 1, "b": None, "d": "2015-01-02"}


def test_parameters_survive_saving(spark):
    f = Frames(spark, SMALL)
    path = work_path(spark, "parameters")
    save_parameters(f.parameter_table, path)
    assert load_parameters(spark, path) == f.parameters
    assert f.parameters.levels["store_type"] == ["a", "b", "c", "d"]
    assert f.parameters.fills["competition_distance"] == f.distance_fill.first()[0]


def test_any_number_of_labels_is_fitted_and_applied(spark):
    f = Frames(spark, SMALL)
    many = f.training.withColumn("store_type", F.concat("store_type", "store", F.col("date").cast("string")))
    levels = sorted(r[0] for r in many.select("store_type").distinct().collect())
    assert len(levels) > 4000
    table = fit_parameters(many)
    path = work_path(spark, "parameters")
    save_parameters(table, path)
    parameters = load_parameters(spark, path)
    assert not isinstance(parameters.levels["store_type"], list)
    coded = prepare(many.withColumn("label", F.col("store_type")), parameters).select("label", "store_type").distinct()
    assert {r["label"]: r["store_type"] for r in coded.collect()} == {v: i for i, v in enumerate(levels)}
    wide = f.training.withColumn("state_holiday", F.concat("store", F.col("date").cast("string")))
    with pytest.raises(ValueError, match="state_holiday"):
        prepare(wide, Parameters.from_table(fit_parameters(wide)))


# --- scoring -----------------------------------------------------------------
@pytest.fixture(scope="module")
def served(spark):
    f = Frames(spark, SMALL)
    train, _ = rows.split_by_date(f.feature_rows, f.cutoff)
    model = models.fit(models.linear(), train)
    path = work_path(spark, "forecaster")
    save_forecaster(f.parameter_table, model, path)
    return f, Forecaster.load(spark, path)


def test_score_of_one_record_equals_its_score_in_the_batch(served):
    f, forecaster = served
    batch = future_records(f.future, f.store)
    scored = {(r["store"], r["date"]): r["prediction"] for r in forecaster.score(batch).collect()}
    assert len(scored) == batch.count() > 0
    (store, date), value = sorted(scored.items())[0]
    one = batch.where((F.col("Store") == store) & (F.col("Date") == F.lit(date)))
    assert forecaster.score(one).first()["prediction"] == pytest.approx(value, rel=1e-12)


def test_closed_days_get_no_score_but_missing_flags_do(served):
    f, forecaster = served
    base = future_records(f.future, f.store).limit(1)
    flags = [base.withColumn("Open", F.lit(v).cast("int")) for v in (0, 1, None)]
    kept = flags[0].unionByName(flags[1]).unionByName(flags[2])
    assert sorted(r["open"] is None for r in forecaster.score(kept).collect()) == [False, True]


def odd_payloads(f):
    """Ten good records, a closed day, and one record of each kind that cannot be scored."""
    good = [json.loads(r["record"]) for r in records.records_out(future_records(f.future, f.store).limit(10)).collect()]
    store = [n for n in RECORD.names if n in STORE.names and n != "Store"]
    odd = [
        {**good[0], "StoreType": "z"},
        {**good[1], **dict.fromkeys(store)},
        {**good[2], "CompetitionOpenSinceMonth": 0},
        {**good[3], "Promo2SinceWeek": 99},
        {**good[4], "Date": "2015-02-30"},
        {**good[5], "Store": "seven"},
    ]
    texts = [json.dumps(good), json.dumps({**good[6], "Open": 0}), *map(json.dumps, odd)]
    return texts + ["not json", json.dumps(good[7])[:40], "[]"]


REASONS = sorted(
    ["unknown store_type"] * 2
    + ["no value for competition_time_month", "no value for promo_time_week", "not a JSON record", "not a JSON record"]
    + ["unreadable: Date", "unreadable: Store"]
)


def test_records_that_cannot_be_scored_are_named(spark, served):
    f, forecaster = served
    payloads = spark.createDataFrame([(t,) for t in odd_payloads(f)], "value string")
    read = records.records_in(payloads, "value")
    broken = records.records_refused(payloads, "value")
    odd = forecaster.refused(read)
    assert forecaster.score(read).count() == 10
    assert sorted(r["reason"] for r in broken.select("reason").union(odd.select("reason")).collect()) == REASONS
    # One closed day is neither: scored, refused and closed make up the input.
    assert read.count() + broken.count() == 10 + len(REASONS) + 1


def test_stream_sends_odd_records_to_a_place_of_their_own(spark, served, tmp_path):
    f, forecaster = served
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(odd_payloads(f)))
    score_stream(spark, forecaster, str(source), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    refuse_stream(spark, forecaster, str(source), str(tmp_path / "no"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 10
    reasons = [json.loads(r["value"])["reason"] for r in spark.read.text(str(tmp_path / "no")).collect()]
    assert sorted(reasons) == REASONS


def test_a_batch_repeated_after_a_crash_counts_once(spark, served, tmp_path, monkeypatch):
    f, forecaster = served
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(odd_payloads(f)))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    honest, calls = scoring._refused, []

    def crash(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("between the two outputs")
        return honest(*args)

    # The scored rows of the first batch are written before its refused ones are made.
    def scored_then_crash(forecaster_, kept):
        if not calls:
            text = records.records_out(forecaster_.score(records.records_in(kept, "value", RECORD)), "value")
            text.write.mode("overwrite").text(f"{out}/scored/batch=0")
        return crash(forecaster_, kept)

    monkeypatch.setattr(scoring, "_refused", scored_then_crash)
    with pytest.raises(Exception, match="between the two outputs"):
        scoring.stream_batches(spark, forecaster, str(source), out, check).awaitTermination()
    scoring.stream_batches(spark, forecaster, str(source), out, check).awaitTermination()
    (source / "b.txt").write_text(odd_payloads(f)[0])
    scoring.stream_batches(spark, forecaster, str(source), out, check).awaitTermination()
    scored = scoring.scored_batches(spark, out)
    assert sorted((r["batch"], r["count"]) for r in scored.groupBy("batch").count().collect()) == [(0, 10), (1, 10)]
    refused = scoring.scored_batches(spark, out, "refused").collect()
    assert sorted(json.loads(r["value"])["reason"] for r in refused) == REASONS


def test_training_rows_without_a_feature_are_set_aside(served):
    f, _ = served
    odd = f.prepared.withColumn("promo2", F.when(F.col("store") != 3, F.col("promo2")))
    aside = models.incomplete_rows(odd)
    assert models.feature_rows(odd).count() + aside.count() == odd.count()
    assert {r[0] for r in aside.select("reason").distinct().collect()} == {"no value for promo2"}


def test_report_for_chosen_stores(served):
    f, forecaster = served
    report = six_week_forecast(forecaster, f.future, f.store, [7, 3, 9]).collect()
    assert {r["store"] for r in report} == {7, 3, 9}
    for r in report:
        assert r["message"] == f"Store Number {r['store']} will sell R${r['prediction']:,.2f} in the next 6 weeks"


def test_stream_equals_batch_and_survives_a_restart(spark, served):
    f, forecaster = served
    batch = future_records(f.future, f.store)
    source, sink, checkpoint = (work_path(spark, n) for n in ("in", "out", "check"))
    half = F.col("Store") % 2 == 0
    records.write_records(batch.where(half), source)
    score_stream(spark, forecaster, source, sink, checkpoint, files_per_trigger=1).awaitTermination()
    batch.where(~half).write.mode("append").option("ignoreNullFields", False).json(source)
    score_stream(spark, forecaster, source, sink, checkpoint).awaitTermination()

    expected = forecaster.score(batch)
    streamed = records.read_records(spark, sink, expected.schema)
    key = ["store", "date"]
    a = [tuple(r) for r in expected.orderBy(*key).collect()]
    b = [tuple(r) for r in streamed.select(*expected.columns).orderBy(*key).collect()]
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:-1] == y[:-1] and x[-1] == pytest.approx(y[-1], rel=1e-12)


def test_parameter_value_from_a_table(spark):
    table = spark.createDataFrame(
        [("x", "robust", "center", 1.0), ("x", "robust", "scale", 2.0), ("k", "level", "b", 1.0), ("k", "level", "a", 0.0)],
        "feature string, method string, name string, value double",
    )
    assert Parameters.from_table(table) == Parameters({"x": (1.0, 2.0)}, {"k": ["a", "b"]}, {})


def test_features_are_not_repeated_in_the_test_for_complete_rows(spark):
    """Pushed below the features that test held the expressions of all of them: a method the JVM does not compile."""
    table = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "x int, name string")
    made = table.selectExpr("sin(x) AS store", "upper(name) AS promo", "DATE'2015-01-01' AS date", "log1p(x) AS sales")
    kept = models.feature_rows(made, ["store", "promo"])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    tests = [part for part in plan.splitlines() if "Filter" in part]
    assert tests and not any("sin" in t.lower() or "upper" in t for t in tests)
    assert kept.columns == ["store", "promo", "date", "sales"] and [r["promo"] for r in kept.collect()] == ["A"]


def test_prepared_rows_group_the_lines_once(spark, tmp_path):
    """Parameters and features read the written sales rows, not the line items again."""
    from aislecast.catalog.frames import Frames

    lines = spark.range(400).selectExpr(
        "id AS l_orderkey", "id % 5 + 1 AS l_suppkey", "CAST(id % 9 + 1 AS DOUBLE) AS l_quantity",
        "CAST(id * 10 + 50 AS DOUBLE) AS l_extendedprice", "0.1D AS l_discount",
        "CAST(date_add(DATE'1996-01-01', CAST(id % 200 AS INT)) AS TIMESTAMP) AS l_shipdate",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = spark.range(5).selectExpr("id + 1 AS s_suppkey", "CAST(id AS INT) AS s_nationkey", "CAST(id * 100 AS DOUBLE) AS s_acctbal")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    frames = Frames(spark, str(tmp_path))
    assert "lineitem" not in "".join(frames.prepared.inputFiles()) and frames.prepared.inputFiles()
    assert frames.stored_training.columns == frames.training.columns
    assert sorted(map(tuple, frames.stored_training.collect()), key=str) == sorted(map(tuple, frames.training.collect()), key=str)
