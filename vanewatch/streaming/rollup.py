"""Rolling statistics over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time_rollup(
    rows: DataFrame,
    sensor: str,
    length: str = "24 hours",
    slide: str = "10 minutes",
    delay: str = "1 hour",
) -> DataFrame:
    """Average and deviation per asset and sliding window, on the grid of ``slide``.

    Rows are first summed into panes one slide long; only panes are copied into the windows
    they belong to. Works the same on a batch, where the watermark means nothing.
    """
    asset = ["farm", "asset_id"]
    panes = (
        rows.withWatermark("time_stamp", delay)
        .groupBy(*asset, F.window("time_stamp", slide).alias("pane"))
        .agg(
            F.count(sensor).alias("n"),
            F.sum(sensor).alias("s"),
            F.sum(F.col(sensor) * F.col(sensor)).alias("q"),
        )
    )
    windows = panes.groupBy(*asset, F.window(F.window_time("pane"), length, slide).alias("w")).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )
    mean = F.try_divide("s", "n")
    spread = F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0))
    return windows.select(
        *asset,
        F.col("w.end").alias("window_end"),
        F.col("n").alias("n_rows"),
        mean.alias("mean_value"),
        F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std_value"),
    )
