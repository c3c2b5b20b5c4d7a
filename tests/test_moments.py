"""Co-moment arrays, and the fold fits that rest on them."""

import datetime as dt

import numpy as np
import pytest

from aislecast.operators import errors
from aislecast.operators.moments import Moments, pair_moments
from aislecast.operators.statistics import corr_matrix
from aislecast.plans import models

from test_models import plain_lasso


def made(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 1.0, (n, 4))
    x[:, 1] = x[:, 0] * 0.5 + rng.normal(size=n)
    x[:, 3] = 7.0
    x[rng.random((n, 4)) < 0.2] = np.nan
    return x


def test_moments_merge_to_those_of_all_rows():
    x = made()
    parts = [Moments.of(p) for p in np.array_split(x, [3, 50, 51, 200])]
    total = parts[0]
    for part in parts[1:]:
        total = total.merged(Moments.from_bytes(part.to_bytes()))
    r = total.correlations()
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 3 in (i, j):
                assert np.isnan(r[i, j])
            else:
                assert r[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert total.means() == pytest.approx(np.nanmean(x, axis=0), rel=1e-12)


def test_correlation_matrix_of_gaps_and_no_rows(spark):
    x = made()
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x] + [(None, float("nan"), None, None)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    found = {(r["col_a"], r["col_b"]): r["r"] for r in corr_matrix(frame).collect()}
    both = ~np.isnan(x[:, 0]) & ~np.isnan(x[:, 1])
    assert found["a", "b"] == pytest.approx(np.corrcoef(x[both, 0], x[both, 1])[0, 1], abs=1e-9)
    assert found["a", "a"] == 1.0 and found["d", "d"] is None and found["a", "d"] is None and len(found) == 16
    assert {r["r"] for r in corr_matrix(frame.limit(0)).collect()} == {None}


def test_moments_by_unit(spark):
    frame = spark.createDataFrame([(i % 3, float(i), float(i * i)) for i in range(90)], "u int, x double, y double")
    found = pair_moments(frame.repartition(7), ["x", "y"], frame["u"])
    assert sorted(found) == [0, 1, 2]
    for unit, moments in found.items():
        own = [float(i) for i in range(90) if i % 3 == unit]
        assert moments.count[0, 1] == 30 and moments.means()[0] == pytest.approx(np.mean(own))


@pytest.fixture(scope="module")
def dated(spark):
    rng = np.random.default_rng(8)
    last = dt.date(2015, 7, 31)
    x = rng.normal(size=(900, 3)) + [5, 100, 0]
    y = 2 + x @ [0.3, 0.01, 0.0] + rng.normal(scale=0.2, size=900)
    rows = [(i % 9, last - dt.timedelta(days=int(i % 300)), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "store int, date date, a double, b double, c double, sales double"), last


@pytest.mark.parametrize("alpha", [0.0, 0.05])
def test_fold_fits_equal_separate_fits(dated, alpha):
    frame, last = dated
    names = ["a", "b", "c"]
    found = models.cross_validate_linear(frame, last, 4, "m", alpha, names).first()
    local = frame.toPandas()
    maes = []
    for k in range(4, 0, -1):
        start, end = errors.fold_bounds(last, k)
        train, valid = local[local["date"] < start], local[(local["date"] >= start) & (local["date"] <= end)]
        x, y = train[names].to_numpy(), train["sales"].to_numpy()
        if alpha:
            w = plain_lasso(x, y, alpha)
        else:
            w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
        at = y.mean() + (valid[names].to_numpy() - x.mean(0)) @ w
        maes.append(np.abs(np.expm1(at) - np.expm1(valid["sales"])).mean())
    assert found["mae_mean"] == pytest.approx(np.mean(maes), rel=1e-8)
    assert found["mae_std"] == pytest.approx(np.std(maes), rel=1e-6)
    pipeline = models.lasso(alpha, names) if alpha else models.linear(names)
    slow = models.cross_validate(frame, last, 4, "m", pipeline).first()
    assert found["rmse_mean"] == pytest.approx(slow["rmse_mean"], rel=1e-6)
