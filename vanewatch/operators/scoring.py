"""Batch scoring of every turbine and component."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanewatch.functions.bands import forecast_points
from vanewatch.functions.labels import display_id
from vanewatch.operators.joins import attach
from vanewatch.operators.learning import (
    FaultClassifier, QuantileModel, assembled, imputed, with_quantiles,
)
from vanewatch.operators.serving import latest_per
from vanewatch.schemas import PREDICTION


def newest_params(registry: DataFrame) -> DataFrame:
    """The latest registered trend parameters per component and asset."""
    return registry.groupBy("component", "farm", "asset_id").agg(
        F.max_by("params", "version").alias("params"), F.max("version").alias("version")
    )


def complete_scores(
    fault: DataFrame, p10: DataFrame, p50: DataFrame, p90: DataFrame
) -> DataFrame:
    """Predictions exist only where all four models produced one."""
    keys = ["turbine_id", "component"]
    return reduce(lambda a, b: a.join(b, keys), [fault, p10, p50, p90])


def score_component(
    features: DataFrame,
    component: str,
    classifier: FaultClassifier | None,
    quantiles: dict[str, QuantileModel] | None,
    forecasts: DataFrame,
    ranks: DataFrame,
    as_of: Column,
) -> DataFrame:
    """Prediction rows of one component from each asset's latest features."""
    spark = features.sparkSession
    if classifier is None or quantiles is None:
        return spark.createDataFrame([], PREDICTION)
    latest = latest_per(features, ["farm", "asset_id"])
    first = next(iter(quantiles.values()))
    scored = classifier.transform(latest).withColumn("_fault", classifier.fault_probability())
    keyed = scored.select("farm", "asset_id", "_fault", *first.columns)
    ruls = with_quantiles(assembled(imputed(keyed, first.medians), first.columns), quantiles)
    series = forecasts.select("farm", "asset_id", "forecast")
    asset = ["farm", "asset_id"]
    joined = attach(attach(ruls, series, asset, asset), ranks, asset, asset)
    empty = F.array().cast("array<struct<timestamp:timestamp,value:double>>")
    return joined.select(
        display_id("farm", "rank", "asset_id").alias("turbineId"),
        F.lit(component).alias("component"),
        F.col("_fault").alias("faultProbability"),
        F.col("rul_p10").alias("rulHoursP10"),
        F.col("rul_p50").alias("rulHoursP50"),
        F.col("rul_p90").alias("rulHoursP90"),
        F.coalesce(forecast_points("forecast", as_of), empty).alias("forecastSeries"),
    )


def requested(predictions: DataFrame, turbine_id: str, component: str | None = None) -> DataFrame:
    """Predictions of a turbine, of one component or of all."""
    found = predictions.where(F.col("turbine_id") == turbine_id)
    return found if component is None else found.where(F.col("component") == component)
