"""Identifiers, labels and severities shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vanewatch.domain import RISK_ACCENT, STATUS_LABELS


def status_label(column: str) -> Column:
    pairs = [F.lit(x) for item in STATUS_LABELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit("unknown"))


def strip_avg(column) -> Column:
    return F.regexp_replace(column, "_avg$", "")


def display_id(farm, rank, asset_id) -> Column:
    """``A-3`` for the third asset of farm A; the raw asset id where no rank is known."""
    return F.concat_ws("-", F.col(farm), F.coalesce(F.col(rank), F.col(asset_id)).cast("string"))


def display_farm(column: str) -> Column:
    return F.when(_is_display_id(column), F.split_part(F.col(column), F.lit("-"), F.lit(1)))


def display_rank(column: str) -> Column:
    tail = F.regexp_extract(column, r"^[^-]*-(\d+)$", 1)
    return F.when(_is_display_id(column), tail.try_cast("int"))


def _is_display_id(column: str) -> Column:
    return F.col(column).rlike(r"^[^-]*-\d+$")


def alert_id(turbine: str = "turbineId", component: str = "component") -> Column:
    return F.concat_ws("#", turbine, component)


def alert_severity(probability: str, rul: str) -> Column:
    p, r = F.col(probability), F.col(rul)
    return (
        F.when((p > 0.9) | (r < 24), "critical").when((p > 0.8) | (r < 48), "high").otherwise("medium")
    )


def alert_message(turbine: str, component: str, probability: str, rul: str) -> Column:
    return F.format_string(
        "%s on %s: faultProbability=%.2f, rulHoursP50=%.1f",
        F.col(component), F.col(turbine), F.col(probability), F.col(rul),
    )


def risk_flag(probability: str, accent: float = RISK_ACCENT) -> Column:
    return F.when(F.col(probability) > accent, "red").otherwise("green")
