"""Boosted trees and forests on blocks against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislecast.plans import boosting, models
from aislecast.plans.trees import Growth, Tree, grow
from aislecast.session import importable_by_workers, work_path
from aislecast.sources.models import load_model, save_model

NAMES = ("a", "b", "c", "d")


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.random(n).round(2), rng.integers(0, 2, n)])
    y = 3 + np.sin(2 * x[:, 0]) + 0.4 * x[:, 1] * (x[:, 3] > 0) + rng.normal(scale=0.1, size=n)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    importable_by_workers(spark)
    x, y = made(500)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, sales double").repartition(3)


def plain_tree(x, g, depth, l2, least):
    """A tree by trying every cut of every feature, one node at a time: (cut) or leaf value."""

    def score(part):
        return part.sum() ** 2 / (len(part) + l2)

    best = (1e-9, None, None)
    for j in range(x.shape[1] if depth else 0):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = score(g[left]) + score(g[~left]) - score(g)
            if gain > best[0] + 1e-12:
                best = (gain, j, cut)
    if best[1] is None:
        return -g.sum() / (len(g) + l2)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], *(plain_tree(x[s], g[s], depth - 1, l2, least) for s in (left, ~left))


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def predicted(model, frame):
    return {tuple(r[n] for n in NAMES): r["p"] for r in model.transform(frame, "p").collect()}


@pytest.mark.parametrize("finish_rows", [10_000, 60, 0])
def test_boosting_equals_a_plain_booster(table, finish_rows, monkeypatch):
    """Whole trees in groups, from nodes of 60 rows on, and never."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 90)
    monkeypatch.setattr(boosting, "RENEW", 2)
    x, y = made(500)
    booster = boosting.BlockBoosting(5, 0.3, 3, least_weight=4, bins=256, features=NAMES, finish_rows=finish_rows)
    # Few enough values for every one to have a bin of its own.
    x[:, 0] = x[:, 0].round(1)
    monkeypatch.setattr(boosting, "bin_edges", lambda *_: [np.unique(x[:, j])[:-1] for j in range(4)])
    rounded = table.withColumn("a", F.round("a", 1))
    at = np.full(len(y), 0.5)
    for _ in range(5):
        tree = plain_tree(x, at - y, 3, 1.0, 4)
        at += 0.3 * np.array([plain_value(tree, r) for r in x])
    found = predicted(booster.fit(rounded), rounded)
    for row, value in zip(x, at):
        assert found[tuple(row)] == pytest.approx(value, abs=1e-9)


def test_grown_tree_fits_every_row():
    x, y = made(300, 4)
    codes = boosting.coded(x, [np.unique(c)[:-1][:255] for c in x.T])
    tree = grow(codes, -y, np.ones(300), Growth(), np.arange(4))
    assert np.abs(tree.value[tree.leaves(codes)] - y).max() < 0.5
    assert grow(codes, -y, np.ones(300), Growth(2), np.arange(4)).feature.size <= 7
    one = grow(codes[:, :1], -y[:1], np.ones(1), Growth(), np.arange(4))
    assert one.feature.tolist() == [-1] and one.value[0] == y[0]


def test_draws_repeat_and_differ_by_tree():
    draw, days = boosting.Draw(3, 0.7), np.arange(10_000)
    one = draw.weights(5, 9, days)
    assert np.array_equal(one, draw.weights(5, 9, days)) and 0.68 < one.mean() < 0.72
    assert not np.array_equal(one, draw.weights(6, 9, days))
    assert boosting.Draw(3, bootstrap=True).weights(1, 1, days).mean() == pytest.approx(1, abs=0.05)
    assert boosting.Draw(3, before=100).weights(0, 0, days).sum() == 100


def test_forest_of_unlimited_depth(table):
    forest = boosting.BlockForest(12, features=NAMES, finish_rows=100).fit(table)
    assert len(forest.trees) == 12
    scored = forest.transform(table).agg(F.corr("sales", "log_prediction")).first()[0]
    assert scored > 0.95
    assert np.argsort(forest.importances())[-1] == 0 and forest.importances().sum() == pytest.approx(1)


def test_models_in_step_equal_separate_fits(table):
    """Three models at once, one of them with other rows and fewer rounds."""
    dated = table.withColumn("date", F.date_add(F.lit("2015-01-01").cast("date"), (F.col("c") * 100).cast("int")))
    one = boosting.BlockBoosting(6, 0.3, 3, 0.8, 0.5, features=NAMES, finish_rows=80)
    two = boosting.BlockBoosting(3, 0.1, 5, 0.5, 1.0, features=NAMES, finish_rows=80)
    limit = dated.selectExpr("percentile_approx(date, 0.6)").first()[0]
    together = boosting.fit_in_step(dated, [one, two, one], [None, None, limit])
    assert [len(m.trees) for m in together] == [6, 3, 6]
    for found, alone in ((together[0], one.fit(dated)), (together[1], two.fit(dated))):
        a, b = predicted(found, dated), predicted(alone, dated)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert predicted(together[2], dated) != predicted(together[0], dated)
    staged = {tuple(r[n] for n in NAMES): r["s"] for r in together[0].staged(dated, [3, 6], "s").collect()}
    full = predicted(together[0], dated)
    three = predicted(boosting.TreeModel(NAMES, together[0].trees[:3], together[0].edges, 0.5, 0.3), dated)
    assert all(staged[k] == [three[k], full[k]] for k in full)


def test_saved_ensemble_predicts_the_same(spark, table):
    model = boosting.BlockBoosting(4, 0.3, 4, 0.7, 0.7, features=NAMES).fit(table)
    path = work_path(spark, "ensemble")
    save_model(model, path)
    again = load_model(path)
    assert isinstance(again, boosting.TreeModel) and predicted(again, table) == predicted(model, table)
    assert again.nodes(spark).count() == sum(len(t.feature) for t in model.trees)


def test_a_constant_label_and_few_rows(spark):
    rows = [(float(i), 1.0, 2.0, 3.0, 7.0) for i in range(5)]
    flat = spark.createDataFrame(rows, "a double, b double, c double, d double, sales double")
    model = boosting.BlockForest(3, features=NAMES).fit(flat)
    assert list(predicted(model, flat).values()) == [pytest.approx(7.0)] * 5
    assert isinstance(model.trees[0], Tree) and models.forest().depth is None


def test_blocks_are_few_and_whole_however_many_rows(spark, monkeypatch):
    """Beyond the bound partitions hold several larger blocks, and every row is in one of them."""
    importable_by_workers(spark)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 5)
    monkeypatch.setattr(boosting, "PARTS", 4)
    rows = spark.range(5_000).selectExpr("CAST(id % 7 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS sales")
    edges = [np.arange(6.0)]
    blocks = boosting.to_blocks(rows, ["a"], "sales", edges, [0.0], 5_000)
    assert blocks.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    held = blocks.collect()
    labels = np.concatenate([np.frombuffer(b["target"]) for b in held])
    codes = np.concatenate([np.frombuffer(b["codes"], np.uint8) for b in held])
    assert np.array_equal(np.sort(labels), np.arange(5_000)) and np.array_equal(codes, labels % 7)
    assert len({b["block"] for b in held}) == len(held)
    assert max(len(b["codes"]) for b in held) == 5 * boosting.LARGE


def test_histograms_hold_the_bins_of_each_feature_alone(spark, table):
    width, edges = 4, [np.array([0.0]), np.arange(4.0), np.array([0.5]), np.array([])]
    blocks = boosting.to_blocks(table, NAMES, "sales", edges, [0.0], 500)
    growing = [boosting.Growing(0, np.array([1, 2, 3]), boosting.Draw(), Growth())]
    sizes = boosting.bin_counts(edges)
    rows = boosting._summed(blocks, sizes, growing, {(0, 0): -1}).collect()
    sums = sum(np.frombuffer(r["sums"]).reshape(2, -1) for r in rows)
    assert width == len(sizes) and sums.shape == (2, 5 + 2 + 1)
    assert sums[1].tolist()[:5] == [table.where(f"b = {i}").count() for i in range(5)]
    assert sums[1, 5:7].sum() == sums[1, 7] == 500


def test_predictions_are_taken_once_a_round(table, monkeypatch):
    """A round's jobs get no trees of earlier rounds; the blocks hold what these predict."""
    seen, plain = [], boosting.grow_together

    def watched(blocks, count, sizes, growing, finish_rows):
        seen.append(np.concatenate([np.frombuffer(r["base"]) for r in blocks.select("base").collect()]))
        return plain(blocks, count, sizes, growing, finish_rows)

    monkeypatch.setattr(boosting, "grow_together", watched)
    model = boosting.BlockBoosting(4, 0.3, 3, features=NAMES).fit(table)
    for k, held in enumerate(seen):
        part = boosting.TreeModel(NAMES, model.trees[:k], model.edges, 0.5, 0.3)
        assert np.allclose(np.sort(held), sorted(r["p"] for r in part.transform(table, "p").collect()))


def test_groups_grow_with_the_table_up_to_a_bound():
    assert boosting.group_rows(500_000, boosting.FINISH_ROWS) == boosting.FINISH_ROWS
    assert boosting.group_rows(3_200_000, boosting.FINISH_ROWS) == 50_000
    assert boosting.group_rows(10**10, boosting.FINISH_ROWS) == boosting.MOST_FINISH_ROWS


def test_feature_selection_takes_the_bins_once(table, monkeypatch):
    """Shuffled copies have the values of their features: no round asks for bins again."""
    from aislecast.plans import selection

    asked = []
    monkeypatch.setattr(selection, "bin_edges", lambda rows, names, bins: asked.append(names) or boosting_edges(rows, names, bins))
    monkeypatch.setattr(boosting, "bin_edges", lambda *_: pytest.fail("a round asked for bins"))
    found = selection.boruta_select(table, list(NAMES), "sales", max_iter=2, depth=3)
    assert asked == [list(NAMES)] and {r["feature"] for r in found.collect()} == set(NAMES)


boosting_edges = boosting.bin_edges


def test_models_beyond_a_bound_are_fitted_in_groups(table, monkeypatch):
    """Blocks hold the predictions of few models at a time, and every model is what it is alone."""
    seen, plain = [], boosting.grow_together

    def watched(blocks, count, sizes, growing, finish_rows):
        seen.append(max(len(r["base"]) // len(r["target"]) for r in blocks.select("base", "target").collect()))
        return plain(blocks, count, sizes, growing, finish_rows)

    makers = [boosting.BlockBoosting(n, 0.3, 3, 0.8, 0.5, base=b, features=NAMES, finish_rows=80) for n, b in ((3, 0.5), (1, 0.0), (2, 1.0))]
    alone = [predicted(m.fit(table), table) for m in makers]
    monkeypatch.setattr(boosting, "HELD_BYTES", 2 * 8 * boosting.BLOCK_ROWS)
    monkeypatch.setattr(boosting, "grow_together", watched)
    found = boosting.fit_in_step(table, makers)
    assert max(seen) == 2 and [len(m.trees) for m in found] == [3, 1, 2]
    assert [predicted(m, table) for m in found] == alone


def test_levels_in_parts_and_features_counted_together(table, monkeypatch):
    """Passes with few histograms each, and joint histograms of large blocks, give the same trees."""
    forest = boosting.BlockForest(5, 4, features=NAMES, finish_rows=0)
    whole = predicted(forest.fit(table), table)
    monkeypatch.setattr(boosting, "LEVEL_BYTES", 1)
    assert predicted(forest.fit(table), table) == whole
    x, y = made(9_000, 3)
    edges = [np.quantile(x[:, 0], np.arange(1, 30) / 30), np.arange(4.0), np.quantile(x[:, 2], [0.2, 0.6]), np.array([0.5])]
    codes, sizes = boosting.coded(x, edges), boosting.bin_counts(edges)
    row = {"block": 0, "codes": codes.tobytes(), "target": y.tobytes(), "days": np.zeros(9_000, np.int32).tobytes(), "base": np.zeros(9_000).tobytes()}
    block, at = boosting.Block(row, 4), np.arange(9_000) % 3
    tables = [boosting.Histograms(sizes, [0, 2, 3], 3, joint) for joint in (False, True)]
    for t in tables:
        t.add(block, np.arange(9_000), at, y, None)
    assert [len(t.groups) for t in tables] == [3, 1]
    assert np.allclose(tables[0].of_features(), tables[1].of_features(), rtol=1e-12)
    assert tables[1].of_features().shape == (3, 2, 30 + 3 + 2)


def test_selection_of_a_large_table_makes_blocks_once(table, monkeypatch):
    """Bins are shuffled inside blocks; the rows are not dealt anew for each round."""
    from aislecast.plans import selection

    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    monkeypatch.setattr(boosting, "PARTS", 3)
    monkeypatch.setattr(selection, "with_shadows", lambda *_: pytest.fail("rows were dealt anew"))
    made_blocks, plain = [], boosting.to_blocks
    for module in (boosting, selection):
        monkeypatch.setattr(module, "to_blocks", lambda *a, **k: made_blocks.append(plain(*a, **k)) or made_blocks[-1])
    found = {r["feature"]: r for r in selection.boruta_select(table, list(NAMES), "sales", max_iter=8, depth=4).collect()}
    assert len(made_blocks) == 1 and found["a"]["decision"] == "accepted"
    assert found["c"]["decision"] != "accepted" and found["c"]["hits"] < found["a"]["hits"] == found["a"]["trials"]
    one = made_blocks[0].collect()
    both = {r["block"]: np.frombuffer(r["codes"], np.uint8) for r in selection.shadow_blocks(made_blocks[0], NAMES, ("a", "c"), ("b", "a"), 5).collect()}
    for row in one:
        codes, new = np.frombuffer(row["codes"], np.uint8).reshape(4, -1), both[row["block"]].reshape(4, -1)
        assert np.array_equal(new[:2], codes[[0, 2]])
        assert np.array_equal(np.sort(new[2:]), np.sort(codes[[1, 0]]))


def test_poisson_numbers_by_table():
    drawn = np.bincount(boosting.poisson(np.random.default_rng(1), 2_000_000), minlength=9) / 2_000_000
    wanted = np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720, 5040])
    assert np.allclose(drawn[:8], wanted, atol=5 * np.sqrt(wanted / 2_000_000))


def test_a_large_forest_stays_in_files_and_predicts_the_same(spark, table, monkeypatch):
    """No lower node comes to the driver; predictions, importances and the saved copy are those of the trees in memory."""
    forest = boosting.BlockForest(7, features=NAMES, finish_rows=100)
    whole = forest.fit(table)
    monkeypatch.setattr(boosting, "MOST_NODES", 100)
    monkeypatch.setattr(boosting, "END_ROWS", 1_500)
    stored = forest.fit(table)
    assert isinstance(stored, boosting.StoredForest) and not isinstance(whole, boosting.StoredForest)
    upper, all_nodes = (sum(len(t.feature) for t in m.trees) for m in (stored, whole))
    below = sum(len(r["feature"]) // 2 - 1 for r in stored.parts.collect())
    assert upper < all_nodes / 4 and upper + below == all_nodes
    assert predicted(stored, table) == predicted(whole, table)
    assert np.allclose(stored.importances(), whole.importances(), rtol=1e-12)
    twice = stored.transform(table.union(table), "p")
    assert twice.columns == [*table.columns, "p"] and twice.count() == 1_000
    path = work_path(spark, "forest")
    save_model(stored, path)
    assert predicted(load_model(path), table) == predicted(whole, table)


def test_plans_of_deep_levels_stay_short(table, monkeypatch):
    """Each level reads the histograms of the last one; their plans are not nested without end."""
    lengths, plain = [], boosting._splits

    def watched(*args):
        found = plain(*args)
        lengths.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        return found

    monkeypatch.setattr(boosting, "_splits", watched)
    boosting.BlockForest(2, 9, features=NAMES, finish_rows=0).fit(table)
    assert len(lengths) >= 8 and max(lengths[5:]) < 2 * max(lengths[:4])


def test_trees_without_a_split_do_not_renew_the_blocks(spark, monkeypatch):
    """They add one number to all rows, and the model is what it is with blocks renewed in each round."""
    importable_by_workers(spark)
    x, y = made(400, 2)
    rows = [(*map(float, r), 9 + 0.5 * float(t)) for r, t in zip(x, y)]
    far = spark.createDataFrame(rows, "a double, b double, c double, d double, sales double").repartition(2)
    renewed, plain = [], boosting._renewed
    monkeypatch.setattr(boosting, "_renewed", lambda *a: renewed.append(a) or plain(*a))
    makers = [boosting.BlockBoosting(8, 0.3, 3, 0.8, features=NAMES, l2=l2, finish_rows=50) for l2 in (40.0, 20.0)]
    found = boosting.fit_in_step(far, makers)
    single = [all(len(m.trees[k].feature) == 1 for m in found) for k in range(8)]
    assert any(single[:7]) and not all(single) and len(renewed) == 7 - sum(single[:7])
    monkeypatch.setattr(boosting, "RENEW", 1)
    again = boosting.fit_in_step(far, makers)
    assert len(renewed) == 14 - sum(single[:7])
    assert [predicted(m, far) for m in again] == [predicted(m, far) for m in found]
