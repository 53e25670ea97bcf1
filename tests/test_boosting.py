"""Multi-class boosting: rounds stop as told, scores agree with plain code, quality next to one model per class."""

import json

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vanewatch.operators import boosting, learning

COLUMNS = ["a", "b"]


def noisy(spark, n=1500):
    rng = np.random.default_rng(5)
    a, b = rng.random(n), rng.random(n)
    label = np.where(a > 0.7, "pitch", np.where(b > 0.6, "gearbox", "healthy"))
    wrong = rng.random(n) < 0.15
    label[wrong] = rng.permutation(label[wrong])
    rows = [(int(i), float(x), float(y), str(k)) for i, (x, y, k) in enumerate(zip(a, b, label))]
    return spark.createDataFrame(rows, "id long, a double, b double, label string")


def test_rounds_stop_after_patience_and_go_back_to_the_best(spark):
    model, scored = learning.fit_classifier(
        noisy(spark, 600), COLUMNS, ["id"], rounds=60, learning_rate=0.6, depth=3, patience=4)
    best = int(np.argmin(model.losses))
    assert len(model.model.trees) == best and len(model.losses) == best + 5
    assert model.losses[best] < model.losses[0]
    loss = scored.select(F.avg(-F.log(F.col("class_probability")[F.array_position(
        F.array(*[F.lit(c) for c in model.classes]), F.col("label")).cast("int") - 1]))).first()[0]
    assert loss == pytest.approx(model.losses[best], abs=1e-9)
    again = boosting.Boosted.from_json(json.loads(json.dumps(model.model.to_json())))
    x = np.random.default_rng(1).random((50, 2))
    start = np.tile(np.array(again.base), (50, 1))
    assert np.array_equal(again.trees.added(boosting.binned(x, again.edges), start),
                          model.model.trees.added(boosting.binned(x, model.model.edges), start))


def test_renewed_scores_change_nothing(spark, monkeypatch):
    fit = lambda: learning.fit_classifier(noisy(spark, 400), COLUMNS, ["id"], rounds=5, depth=2)[0]
    whole = fit()
    monkeypatch.setattr(boosting, "RENEW", 2)
    assert fit().losses == pytest.approx(whole.losses, abs=1e-12)


def test_macro_f1_is_no_lower_than_with_a_model_per_class(spark):
    data = noisy(spark)
    _, scored = learning.fit_classifier(data, COLUMNS, ["id"], rounds=12, learning_rate=0.3, depth=3)
    together = learning.macro_f1(scored).first()[0]
    flagged = learning.assembled(learning.split_flag(data, ["id"]), COLUMNS)
    out = flagged.where("is_test")
    classes = ["gearbox", "healthy", "pitch"]
    for c in classes:
        target = flagged.where("NOT is_test").withColumn("t", (F.col("label") == c).cast("double"))
        model = GBTClassifier(labelCol="t", maxIter=12, stepSize=0.3, maxDepth=3, minInstancesPerNode=20, seed=42).fit(target)
        names = {model.rawPredictionCol: f"r{c}", model.probabilityCol: f"p{c}", model.predictionCol: f"q{c}"}
        out = model.copy(names).transform(out)
    held = F.array(*[vector_to_array(f"p{c}")[1] for c in classes])
    best = F.array_position(held, F.array_max(held))
    apart = learning.macro_f1(out.withColumn("prediction", F.element_at(F.array(*[F.lit(c) for c in classes]), best.cast("int"))))
    assert together >= apart.first()[0] - 0.005


def test_a_split_needs_enough_rows(spark):
    rows = [(i, float(i >= 37), "x" if i >= 37 else "y") for i in range(40)]
    data = spark.createDataFrame(rows, "id long, a double, label string")
    model, _ = learning.fit_classifier(data, ["a"], ["id"], rounds=2, depth=2)
    assert all((np.asarray(f) < 0).all() for f in model.model.trees.feature)
