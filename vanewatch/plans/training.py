"""Training and scoring of one component, from tagged rows to prediction rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.domain import MIN_TREND_DAYS, QUANTILES
from vanewatch.operators import faults, health, learning, rul, scoring, sensors
from vanewatch.session import work_path
from vanewatch.sources import tables

KEYS = ["farm", "asset_id", "time_stamp"]


@dataclass
class ComponentModels:
    classifier: learning.FaultClassifier | None
    quantiles: dict[str, learning.QuantileModel] | None
    trends: DataFrame
    report: DataFrame | None

    def save(self, spark: SparkSession, path: str) -> None:
        if self.classifier:
            self.classifier.save(spark, f"{path}/classifier")
        for name, model in (self.quantiles or {}).items():
            model.save(spark, f"{path}/{name}")
        tables.overwrite(self.trends, f"{path}/trends")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ComponentModels:
        """What was saved; a model that was never trained is missing again."""
        def has(name: str) -> bool:
            return tables.exists(spark, f"{path}/{name}/about")

        classifier = learning.FaultClassifier.load(spark, f"{path}/classifier") if has("classifier") else None
        quantiles = None
        if all(has(n) for n in QUANTILES):
            quantiles = {n: learning.QuantileModel.load(spark, f"{path}/{n}") for n in QUANTILES}
        return cls(classifier, quantiles, spark.read.parquet(f"{path}/trends"), None)


def train_component(
    features: DataFrame,
    fault_table: DataFrame,
    labels: DataFrame,
    component: str,
    min_days: int = MIN_TREND_DAYS,
    rounds: int = learning.ROUNDS,
    depth: int = learning.MAX_DEPTH,
) -> ComponentModels:
    """Fit the classifier, the three quantile models and all trend fits of one component."""
    columns = sensors.feature_columns(features)
    reports = []

    labelled = faults.labelled_features(features, fault_table)
    fitted = learning.fit_classifier(labelled, columns, KEYS, rounds, depth=depth)
    classifier = None
    if fitted:
        classifier, scored = fitted
        params = {"n_features": str(len(columns)), "classes": ",".join(classifier.classes),
                  "healthy_class_index": str(classifier.classes.index("healthy"))}
        reports.append(learning.metric_rows(
            learning.macro_f1(scored), component, "fault_classifier", params, {"macro_f1": "macro_f1"}))

    fitted = learning.fit_rul(rul.labelled_for_rul(features, labels), columns, KEYS, QUANTILES, rounds, depth)
    quantiles = None
    if fitted:
        quantiles, scored = fitted
        losses = scored.agg(*[
            F.avg(learning.pinball("hours_to_failure", f"rul_{n}", a)).alias(n) for n, a in QUANTILES.items()])
        reports.append(learning.metric_rows(
            losses, component, "rul_regressor", {"n_features": str(len(columns))},
            {f"pinball_loss_{n}": n for n in QUANTILES}))

    daily = sensors.day_average_columns(features)
    series = health.health_series(features, daily)
    fitted_trends = health.trend_forecast(health.trend_optimum(health.series_arrays(series, min_days)))
    path = work_path(features.sparkSession, "trends")  # fitted once, read by the report, the scores and the store
    tables.overwrite(fitted_trends, path)
    trends = features.sparkSession.read.parquet(path)
    last = trends.agg(F.avg("fit_rmse").alias("rmse"), F.avg(F.element_at("forecast", -1)).alias("day14"))
    reports.append(learning.metric_rows(
        last, component, "trend_forecaster", {"min_days": str(min_days)},
        {"mean_fit_rmse": "rmse", "mean_forecast_last_day": "day14"}))

    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return ComponentModels(classifier, quantiles, trends, report)


def score(
    features: DataFrame, models: ComponentModels, component: str, ranks: DataFrame, as_of: Column
) -> DataFrame:
    return scoring.score_component(
        features, component, models.classifier, models.quantiles, models.trends, ranks, as_of
    )
