"""Means that do not follow the order of rows."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from vanewatch.functions.means import exact_mean
from vanewatch.plans import q_serving

T = "timestamp_ntz'2024-01-01 00:00:00'"


@pytest.mark.parametrize("values", list(itertools.permutations([0.1, 0.2, 0.3])))
def test_forecast_mean_in_any_order(spark, folder, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "event_id long, value double").coalesce(1)
    rows.selectExpr(
        "event_id", f"{T} AS ts", "0L AS user_id", "'view' AS event_type", "value", "'{\"k\": 1}' AS props"
    ).write.parquet(f"{folder}/events.parquet")
    assert q_serving.forecast_rows(spark, folder).first().mid == 0.6 / 3


@pytest.mark.parametrize("values", [
    [None, None], [1.0, None, 2.0], [1e300, 2e300], [-1e15, 3.0], [1 / 3, 2 / 3, 1e-20], [math.inf, 1.0],
])
def test_values_without_exact_sum_keep_avg(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = rows.agg(exact_mean("v").alias("exact"), F.avg("v").alias("plain")).first()
    assert got.exact == got.plain


def test_nan_stays(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert math.isnan(rows.agg(exact_mean("v")).first()[0])
