"""From predictions to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanewatch.domain import DEFAULT_FAULT_THRESHOLD, DEFAULT_RUL_THRESHOLD
from vanewatch.functions.labels import alert_id, alert_message, alert_severity
from vanewatch.operators.joins import attach
from vanewatch.operators.ranking import newest_per_key
from vanewatch.schemas import PREDICTION_EVENT


def parsed_predictions(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payloads to typed columns plus the first reason, if any, to reject them."""
    p = F.from_json(F.col(column), PREDICTION_EVENT, {"mode": "PERMISSIVE"})
    return payloads.withColumn("_p", p).select(
        *[c for c in payloads.columns if c != column],
        column,
        "_p.*",
    ).withColumn("reason", rejection_reason())


def rejection_reason() -> Column:
    def blank(c: str) -> Column:
        return F.coalesce(F.length(c) == 0, F.lit(True))

    def not_number(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c)

    return (
        F.when(blank("turbineId"), "turbineId is required")
        .when(blank("component"), "component is required")
        .when(not_number("faultProbability"), "faultProbability must be a number")
        .when(not_number("rulHoursP50"), "rulHoursP50 must be a number")
    )


def with_thresholds(predictions: DataFrame, config: DataFrame) -> DataFrame:
    """Per-component thresholds; a missing row or field falls back to its default."""
    joined = attach(predictions, config, ["component"], ["turbineId"])
    return joined.withColumn(
        "faultProbabilityThreshold",
        F.coalesce("faultProbabilityThreshold", F.lit(DEFAULT_FAULT_THRESHOLD)),
    ).withColumn(
        "rulHoursP50Threshold", F.coalesce("rulHoursP50Threshold", F.lit(DEFAULT_RUL_THRESHOLD))
    )


def is_breach() -> Column:
    return (F.col("faultProbability") > F.col("faultProbabilityThreshold")) | (
        F.col("rulHoursP50") < F.col("rulHoursP50Threshold")
    )


def evaluated(predictions: DataFrame, config: DataFrame, clock: str) -> DataFrame:
    """Alerts of the breaching predictions, one per turbine and component, the newest kept."""
    breaches = with_thresholds(predictions, config).where(is_breach())
    alerts = breaches.select(
        alert_id().alias("id"),
        "turbineId",
        "component",
        alert_severity("faultProbability", "rulHoursP50").alias("severity"),
        alert_message("turbineId", "component", "faultProbability", "rulHoursP50").alias("message"),
        F.col(clock).alias("createdAt"),
        F.lit(False).alias("acknowledged"),
    )
    return newest_per_key(alerts, ["id"], [F.col("createdAt").desc(), F.col("message").desc()])


def active(alerts: DataFrame) -> DataFrame:
    return alerts.where(~F.col("acknowledged"))


def acknowledged(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Set the flag on the alerts listed in ``acks``; others keep theirs."""
    listed = acks.select("id").distinct().withColumn("_ack", F.lit(True))
    return attach(alerts, listed, ["id"], ["createdAt"]).withColumn(
        "acknowledged", F.coalesce("_ack", "acknowledged")
    ).drop("_ack")
