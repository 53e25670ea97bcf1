"""Schemas, as DDL, of the tables whose columns do not vary per farm."""

from __future__ import annotations

EVENT_INFO_RAW = (
    "event_id string, event_label string, event_start string, event_start_id string, "
    "event_end string, event_end_id string, event_description string"
)
FEATURE_DESCRIPTION = ("sensor_name string, description string, unit string")
FAULT_EVENTS = (
    "farm string, event_id string, category string, event_start timestamp, event_end timestamp, "
    "event_description string, asset_id bigint"
)
RUL_LABELS = (
    "farm string, asset_id bigint, time_stamp timestamp, event_id string, hours_to_failure double"
)
SENSOR_READINGS = (
    "turbine_id string, time timestamp, sensor string, value double, unit string"
)
PREDICTION_EVENT = (
    "turbineId string, component string, faultProbability double, rulHoursP50 double"
)
ALERT_CONFIG = (
    "component string, faultProbabilityThreshold double, rulHoursP50Threshold double"
)
ALERT = (
    "id string, turbineId string, component string, severity string, message string, "
    "createdAt timestamp, acknowledged boolean"
)
PREDICTION = (
    "turbineId string, component string, faultProbability double, rulHoursP10 double, "
    "rulHoursP50 double, rulHoursP90 double, "
    "forecastSeries array<struct<timestamp:timestamp,value:double>>"
)
TWIN_STATE = (
    "turbineId string, updatedAt timestamp, pitchAngleDeg double, rotorSpeedRpm double, "
    "componentHealth map<string,string>"
)
LANDING_MANIFEST = ("bucket string, key string")
