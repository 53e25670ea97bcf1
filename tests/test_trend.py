"""The trend optimiser against a plain recursion and a fine grid."""

from itertools import product

import numpy as np
import pytest

from vanewatch.operators import health
from vanewatch.operators.simplex import minimised


def recursion(x, alpha, beta, phi, level, trend):
    sse = 0.0
    for v in x:
        expected = level + phi * trend
        new = alpha * v + (1 - alpha) * expected
        trend = beta * (new - level) + (1 - beta) * phi * trend
        sse, level = sse + (v - expected) ** 2, new
    return sse, level, trend


def series(seed):
    rng = np.random.default_rng(seed)
    out = [np.cumsum(rng.normal(0.02, 0.2, rng.integers(20, 60))) for _ in range(6)]
    return [*out, np.full(25, 3.0), np.arange(30) * 0.5, rng.normal(0, 1, 40), np.array([1.0, 2.0])]


def test_simplex_finds_minima_side_by_side():
    goal = np.array([[0.3, -1.0], [2.0, 0.5], [9.0, 9.0]])
    loss = lambda p: ((p - goal) ** 2 * [1.0, 30.0]).sum(axis=1)
    lo, hi = np.array([-5.0, -5.0]), np.array([5.0, 5.0])
    point, value = minimised(loss, np.zeros((3, 2)), np.array([0.5, 0.5]), lo, hi, rounds=300)
    assert np.allclose(point[:2], goal[:2], atol=1e-3) and np.allclose(point[2], 5.0, atol=1e-3)
    assert np.allclose(value, loss(point))


def test_errors_are_those_of_the_recursion_with_the_best_start():
    values = series(1)
    point = np.tile([0.4, 0.2, 0.9], (len(values), 1))
    sse, level, trend = health._Series(values).solved(point)
    for i, x in enumerate(values):
        basis = []  # errors of the zero start and of both unit starts
        for data, l0, b0 in ((x, 0.0, 0.0), (x * 0, 1.0, 0.0), (x * 0, 0.0, 1.0)):
            errors, lv, tr = [], l0, b0
            for v in data:
                errors.append(v - (lv + 0.9 * tr))
                new = 0.4 * v + 0.6 * (lv + 0.9 * tr)
                tr, lv = 0.2 * (new - lv) + 0.8 * 0.9 * tr, new
            basis.append(errors)
        start = np.linalg.lstsq(-np.array(basis[1:]).T, np.array(basis[0]), rcond=None)[0]
        want = recursion(x, 0.4, 0.2, 0.9, *start)
        assert sse[i] == pytest.approx(want[0], abs=1e-7)
        assert (level[i], trend[i]) == pytest.approx(want[1:], abs=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_error_is_no_higher_than_that_of_a_fine_grid(spark, seed):
    values = series(seed)
    arrays = spark.createDataFrame(
        [("A", i, len(x), x.tolist()) for i, x in enumerate(values)],
        "farm string, asset_id long, n_days long, values array<double>",
    ).repartition(3)
    fitted = {r.asset_id: r for r in health.trend_forecast(health.trend_optimum(arrays)).collect()}
    held = health._Series(values)
    grid = product(np.linspace(0.02, 0.98, 25), np.linspace(0.02, 0.98, 25), np.linspace(0.8, 0.98, 7))
    finest = np.min([held.solved(np.tile(g, (len(values), 1)))[0] for g in grid], axis=0)
    for i, x in enumerate(values):
        r = fitted[i]
        assert r.fit_rmse ** 2 * len(x) <= finest[i] * 1.001 + 1e-9
        assert 0 < r.alpha < 1 and 0 < r.beta < 1 and 0.8 <= r.phi <= 0.98
        assert r.forecast[0] == pytest.approx(r.level + r.phi * r.trend)


def test_no_series(spark):
    empty = spark.createDataFrame([], "farm string, asset_id long, n_days long, values array<double>")
    assert health.trend_optimum(empty).count() == 0


def test_few_series_are_dealt_over_the_cores(spark):
    """One partition of small rows must not be one task of long fits."""
    arrays = spark.createDataFrame(
        [("A", i, 20, [float(i + d % 3) for d in range(20)]) for i in range(64)],
        "farm string, asset_id long, n_days long, values array<double>",
    ).coalesce(1)
    fitted = health.trend_optimum(arrays)
    assert fitted.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert fitted.count() == 64


def test_a_component_reads_its_trends_from_a_table(spark):
    """The report, the scores and the store all read the fits; none may fit them again."""
    from vanewatch.plans import training

    rows = [("A", a, d * 86400, 0, f"{d % 2}", float(a + d)) for a in range(2) for d in range(25)]
    features = spark.createDataFrame(
        rows, "farm string, asset_id long, s long, status_type_id int, event_id string, x_avg_24h double",
    ).selectExpr("farm", "asset_id", "timestamp_seconds(s) AS time_stamp", "CAST(NULL AS string) AS event_id", "x_avg_24h")
    faults = spark.createDataFrame([], "farm string, event_id string, category string, event_start timestamp, asset_id long")
    labels = spark.createDataFrame([], "farm string, asset_id long, time_stamp timestamp, event_id string, hours_to_failure double")
    models = training.train_component(features, faults, labels, "c", 20, 1, 1)
    plan = models.trends._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and models.trends.count() == 2
