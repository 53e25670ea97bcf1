"""The registered model queries train as many and as deep rounds as the library does."""

import pytest
from pyspark.sql import functions as F
from test_learning import training_rows

from vanewatch.operators import faults, learning, rul
from vanewatch.plans import fleet_view as fv
from vanewatch.plans import q_models


@pytest.fixture
def fitted(spark, monkeypatch):
    """The fits of a query over a few rows of its own: [(trees, depth)] by function."""
    rows = training_rows(spark, 600).withColumn("event_id", F.lit(None).cast("bigint"))
    features = rows.drop("label", "hours_to_failure")
    monkeypatch.setattr(q_models, "stored_features", lambda *_: features)
    monkeypatch.setattr(fv, "stored_faults", lambda *_: None)
    monkeypatch.setattr(fv, "tagged", lambda *_: None)
    monkeypatch.setattr(fv, "scada", lambda *_: rows.select(
        F.monotonically_increasing_id().alias("id"), F.col("hours_to_failure").alias("sensor_1_avg"),
        F.col("x_avg_24h").alias("sensor_2_avg"), F.col("noise").alias("sensor_4_avg")))
    monkeypatch.setattr(fv, "ranks", lambda *_: spark.createDataFrame(
        [("A", i, i + 1) for i in range(3)], "farm string, asset_id bigint, rank int"))
    monkeypatch.setattr(faults, "labelled_features", lambda *_: rows.drop("hours_to_failure"))
    monkeypatch.setattr(rul, "rul_labels", lambda *_: None)
    monkeypatch.setattr(rul, "labelled_for_rul", lambda *_: rows.drop("label"))
    seen = {"fit_classifier": [], "fit_rul": []}

    def kept(name, sizes):
        plain = getattr(learning, name)

        def fit(*a, **k):
            out = plain(*a, **k)
            seen[name] += sizes(out[0])
            return out

        monkeypatch.setattr(learning, name, fit)

    kept("fit_classifier", lambda m: [(len(m.losses), m.model.trees.depth)])
    kept("fit_rul", lambda models: [(len(m.trees), None) for m in models.values()])
    return seen


def whole(classifiers, quantiles, seen):
    assert [d for _, d in seen["fit_classifier"]] == [learning.MAX_DEPTH] * classifiers
    assert len(seen["fit_rul"]) == quantiles
    assert all(n > learning.PATIENCE for n, _ in seen["fit_classifier"] + seen["fit_rul"])


def test_batch_score(spark, fitted):
    assert q_models.batch_score(spark, "").count() == 3
    whole(1, 3, fitted)


def test_fault_classifier(spark, fitted):
    assert q_models.fault_classifier(spark, "").count() >= 120
    whole(1, 0, fitted)


def test_rul_checks(spark, fitted):
    r = q_models.rul_checks(spark, "").first()
    assert (r.n_rows, r.ordered, r.beats_a_constant) == (120, True, True)
    whole(0, 3, fitted)


def test_rul_quantile(spark, fitted):
    assert q_models.rul_quantile(spark, "").count() == 120
    whole(0, 3, fitted)


def test_training_report(spark, fitted):
    assert q_models.training_report(spark, "").count() == 6
    whole(1, 3, fitted)
