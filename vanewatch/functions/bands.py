"""Array expressions over forecast series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def horizon_factor(index: Column, length: Column) -> Column:
    return (index + F.lit(1)) / length


def rul_band(series: str, p10: str, p50: str, p90: str, share: float = 0.4) -> Column:
    """Widen every forecast point by a growing share of the P10-P50 and P50-P90 spreads."""
    points = F.col(series)
    below = F.col(p50) - F.col(p10)
    above = F.col(p90) - F.col(p50)

    def widen(point: Column, i: Column) -> Column:
        horizon = horizon_factor(i, F.size(points))
        value = point["value"]
        return F.struct(
            point["timestamp"].alias("timestamp"),
            value.alias("p50"),
            F.round(F.greatest(F.lit(0.0), value - below * horizon * F.lit(share)), 1).alias("low"),
            F.round(value + above * horizon * F.lit(share), 1).alias("high"),
        )

    return F.transform(points, widen)


def forecast_points(values: str, as_of: Column) -> Column:
    """Attach the dates one, two, ... days after ``as_of`` to an array of values."""
    return F.transform(
        F.col(values),
        lambda v, i: F.struct(
            (as_of + F.make_dt_interval(days=(i + 1).cast("int"))).alias("timestamp"),
            v.cast("double").alias("value"),
        ),
    )
