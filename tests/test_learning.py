"""Medians, metrics, health series, trend fits and models."""

import math
import statistics
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vanewatch.operators import health, learning, scoring
from vanewatch.plans import training

T0 = datetime(2024, 1, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), max_size=30))
def test_medians_are_exact(spark, values):
    df = spark.createDataFrame([(v, None) for v in values] or [(None, None)], "a double, b double")
    present = [v for v in values if v is not None]
    got = learning.exact_medians(df, ["a", "b"])
    assert got["b"] is None
    assert got["a"] == (pytest.approx(statistics.median(present)) if present else None)


def test_median_of_a_large_skewed_column(spark):
    df = spark.range(60_001).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 37 % 10_007).cast("double")).alias("a"))
    want = statistics.median(r.a for r in df.collect())
    assert learning.exact_medians(df, ["a"])["a"] == want


def test_impute_keeps_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double")
    out = learning.imputed(df, learning.exact_medians(df, ["a", "b"])).collect()
    assert [(r.a, r.b) for r in out] == [(1.0, None), (2.5, None), (4.0, None)]


def test_report_and_macro_f1(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    r = {x["class"]: x for x in learning.classification_report(df).collect()}
    assert (r["a"].precision, r["a"].recall, r["c"].f1, r["c"].support) == (1.0, 0.5, 0.0, 1)
    assert learning.macro_f1(df).first()[0] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_pinball(spark):
    df = spark.createDataFrame([(10.0, 8.0), (10.0, 13.0)], "y double, p double")
    assert [r[0] for r in df.select(F.round(learning.pinball("y", "p", 0.9), 6)).collect()] == [1.8, 0.3]


def daily(spark, columns):
    n = len(next(iter(columns.values())))
    rows = [("A", 1, T0 + timedelta(days=i), *[v[i] for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "farm string, asset_id bigint, day timestamp, " + ", ".join(f"{c} double" for c in columns))


def test_constant_sensors_are_skipped(spark):
    df = daily(spark, {"x": [1.0, 3.0], "c": [5.0, 5.0]})
    assert [r.health for r in health.health_index(df, ["x", "c"]).orderBy("day").collect()] == [1.0, -1.0]


def test_gaps_fill_forward_then_backward(spark):
    s = daily(spark, {"health": [None, 1.0, None, 2.0]})
    assert [r.health for r in health.filled(s).orderBy("day").collect()] == [1.0, 1.0, 1.0, 2.0]


def smooth(x, a, b, p):
    level, trend, sse = x[0], 0.0, 0.0
    for v in x[1:]:
        guess = level + p * trend
        new = a * v + (1 - a) * guess
        trend = b * (new - level) + (1 - b) * p * trend
        level, sse = new, sse + (v - guess) ** 2
    return level, trend, sse


def test_trend_fit_finds_the_grid_minimum(spark):
    x = [math.sin(i / 3) + i / 10 for i in range(32)]
    fit = health.trend_forecast(health.trend_fit(health.series_arrays(daily(spark, {"health": x})))).first()
    best = min((round(smooth(x, a, b, p)[2], 9), a, b, p) for a in (0.2, 0.5, 0.8) for b in (0.1, 0.3) for p in (0.8, 0.9, 0.98))
    assert (fit.alpha, fit.beta, fit.phi) == best[1:]
    level, trend, sse = smooth(x, *best[1:])
    assert fit.fit_rmse == pytest.approx(math.sqrt(sse / 32))
    assert len(fit.forecast) == 14
    assert fit.forecast[1] == pytest.approx(level + trend * (fit.phi + fit.phi**2))


def test_short_series_are_not_fitted(spark):
    s = daily(spark, {"health": [1.0] * 29})
    assert health.series_arrays(s).isEmpty()
    assert health.trend_candidates(s).first().skip_reason == "too few days"


def test_sustained_offset(spark):
    s = daily(spark, {"v": [0.0, 0.0, 9.0, 9.0, 9.0, 0.0, 0.0, 0.0, 0.0, 9.0]})
    out = health.sustained_offset(s, "v", 4.0, 2).collect()
    assert [(r.first_day.day, r.last_day.day, r.n_days) for r in out] == [(3, 5, 3)]


def training_rows(spark, n=600):
    t = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 6000)
    x = (F.col("id") * 7919 % 100) / 100.0
    return spark.range(n).select(
        F.lit("A").alias("farm"), (F.col("id") % 3).alias("asset_id"), t.alias("time_stamp"),
        x.alias("x_avg_24h"), F.when(F.col("id") % 10 != 0, F.rand(3)).alias("noise"),
        F.when(x > 0.8, "gearbox").when(x > 0.6, "pitch").otherwise("healthy").alias("label"),
        (x * 500 + (F.col("id") * 104729 % 50)).alias("hours_to_failure"))


def test_classifier_learns_and_fills_gaps_when_scoring(spark):
    df = training_rows(spark)
    model, scored = learning.fit_classifier(df, ["x_avg_24h", "noise"], training.KEYS, rounds=3, depth=2)
    assert model.classes == ["gearbox", "healthy", "pitch"]
    hits = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert hits > 0.95
    gaps = model.transform(df.withColumn("noise", F.lit(None).cast("double"))).where("label = 'gearbox'")
    assert gaps.agg(F.min(model.fault_probability())).first()[0] > 0.5
    total = scored.select(F.aggregate("class_probability", F.lit(0.0), lambda a, b: a + b).alias("t")).agg(F.max(F.abs(F.col("t") - 1))).first()[0]
    assert total < 1e-9


def test_models_survive_saving(spark, folder):
    df = training_rows(spark, 200)
    columns = ["x_avg_24h", "noise"]
    model, _ = learning.fit_classifier(df, columns, training.KEYS, rounds=2, depth=2)
    model.save(spark, f"{folder}/c")
    again = learning.FaultClassifier.load(spark, f"{folder}/c")
    pick = [*training.KEYS, "prediction", "class_probability"]
    assert again.transform(df).select(pick).exceptAll(model.transform(df).select(pick)).isEmpty()

    models, _ = learning.fit_rul(df, columns, training.KEYS, {"p50": 0.5}, rounds=3, depth=2)
    q = models["p50"]
    q.save(spark, f"{folder}/q")
    back = learning.QuantileModel.load(spark, f"{folder}/q")
    rows = learning.assembled(learning.imputed(df, q.medians), q.columns)
    assert back.add_to(rows, "p").select("p").exceptAll(q.add_to(rows, "p").select("p")).isEmpty()


def test_single_class_is_not_trained(spark):
    assert learning.fit_classifier(training_rows(spark).withColumn("label", F.lit("healthy")), ["x_avg_24h"], training.KEYS) is None


def test_quantiles_do_not_cross_and_cover(spark):
    models, scored = learning.fit_rul(
        training_rows(spark), ["x_avg_24h"], training.KEYS, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, rounds=6, depth=2)
    assert set(models) == {"p10", "p50", "p90"}
    r = scored.agg(
        F.avg((F.col("rul_p10") <= F.col("rul_p50")).cast("int") * (F.col("rul_p50") <= F.col("rul_p90")).cast("int")),
        F.avg((F.col("hours_to_failure") <= F.col("rul_p90")).cast("int")), F.avg((F.col("hours_to_failure") <= F.col("rul_p10")).cast("int"))).first()
    assert r[0] == 1.0 and r[1] > 0.8 and r[2] < 0.25


def test_too_few_rows_are_not_trained(spark):
    assert learning.fit_rul(training_rows(spark, 9), ["x_avg_24h"], training.KEYS, {"p50": 0.5}) is None


def test_nothing_is_scored_without_all_models(spark):
    ranks = spark.createDataFrame([("A", 0, 1)], "farm string, asset_id bigint, rank int")
    out = scoring.score_component(training_rows(spark), "gearbox", None, None, ranks, ranks, F.current_timestamp())
    assert out.isEmpty() and "forecastSeries" in out.columns


def test_coded_trees_give_what_spark_gives(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = learning.assembled(training_rows(spark).na.fill(0.0), ["x_avg_24h", "noise"])
    tree = DecisionTreeRegressor(labelCol="hours_to_failure", leafCol="leaf", maxDepth=4, seed=1).fit(rows)
    coded = learning.CodedTree.of(tree)
    out = tree.transform(rows).select("x_avg_24h", "noise", "prediction", "leaf").toPandas()
    by_leaf = dict(zip(out.leaf, out.prediction))
    assert len(by_leaf) == max(coded.leaf) + 1 > 4
    assert list(coded.with_values(by_leaf).gives(out[["x_avg_24h", "noise"]].to_numpy())) == list(out.prediction)


def test_quantile_plan_does_not_grow_with_the_rounds(spark):
    model = learning.QuantileModel(0.5, 1.0, ["x_avg_24h"], {})
    tree = learning.CodedTree([0, -1, -1], [0.5, 0.0, 0.0], [1, 1, 2], [2, 1, 2], [-1, 0, 1], [0.0, 1.0, 2.0])
    rows = learning.assembled(training_rows(spark, 9), ["x_avg_24h"])
    sizes = []
    for n in (1, 200):
        model.trees = [tree] * n
        out = model.add_to(rows, "p")
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert {r.p for r in out.collect()} <= {1.0 + n, 1.0 + 2 * n}
    assert abs(sizes[0] - sizes[1]) < 20
