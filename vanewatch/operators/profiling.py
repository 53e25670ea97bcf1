"""Sensor distributions, correlations and degradation curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.operators.ranking import every_nth
from vanewatch.operators.serving import unpivoted


def sampled(raw: DataFrame, strides: dict[str, int]) -> DataFrame:
    """Every n-th row of each file by row id, n per farm."""
    pairs = [F.lit(x) for item in strides.items() for x in item]
    step = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("farm")), F.lit(1))
    return every_nth(raw, ["farm", "_source_file"], "id", step)


def histogram(raw: DataFrame, sensors: list[str], bins: int = 40) -> DataFrame:
    """Equal-width bins over each sensor's own range; the last bin includes the maximum."""
    long = unpivoted(raw, ["farm"], sensors)
    bounds = long.groupBy("farm", "sensor").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    width = (F.col("high") - F.col("low")) / F.lit(bins)
    position = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("low"), width)), F.lit(0))
    return (
        long.join(F.broadcast(bounds), ["farm", "sensor"])
        .withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy("farm", "sensor", "bin")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.first("low").alias("low"), F.first("high").alias("high"))
    )


#: Columns on either side of a block of the matrices below.
GRAM_BLOCK = 256
GRAMS = "farm string, a int, b int, sums array<double>"


def _grams(shifts: dict[str, list[float]], width: int):
    """(farm, a, b, sums): six sums over the rows where both of two columns are present.

    For each farm and pair of column blocks these are products of matrices; the six sums of a
    block (n, x, y, xx, yy, xy) lie end to end. Values are taken as distances from ``shifts``.
    """
    blocks = [(i, min(i + GRAM_BLOCK, width)) for i in range(0, width, GRAM_BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            farms = np.array(batch.column("farm").to_pylist(), dtype=object)
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1) if batch.num_rows else None
            for farm in {f for f in farms if f in shifts}:
                values = table[farms == farm] - np.array(shifts[farm])
                held = np.isfinite(values)
                x, held = np.where(held, values, 0.0), held.astype(float)
                for a, (lo, hi) in enumerate(blocks):
                    for b, (start, stop) in enumerate(blocks[a:], start=a):
                        p, q, u, v = x[:, lo:hi], x[:, start:stop], held[:, lo:hi], held[:, start:stop]
                        part = np.stack([u.T @ v, p.T @ v, u.T @ q, (p * p).T @ v, u.T @ (q * q), p.T @ q])
                        sums[farm, a, b] = sums.get((farm, a, b), 0.0) + part
        for (farm, a, b), part in sums.items():
            row = [[farm], [a], [b], [part.ravel()]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], ["farm", "a", "b", "sums"])

    return run


def _correlations(width: int):
    """(farm, i, j, corr) of the pairs of one block, from its partial sums."""

    def run(partials: pa.Table) -> pa.Table:
        farm, a, b = (partials.column(c)[0].as_py() for c in ("farm", "a", "b"))
        total = sum(np.asarray(x.values) for x in partials.column("sums"))
        rows, columns = (min(GRAM_BLOCK, width - k * GRAM_BLOCK) for k in (a, b))
        n, x, y, xx, yy, xy = total.reshape(6, rows, columns)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt((xx - x * x / n) * (yy - y * y / n))
            corr = np.where((n > 1) & (spread > 0), (xy - x * y / n) / spread, np.nan)
        i, j = np.meshgrid(np.arange(rows) + a * GRAM_BLOCK, np.arange(columns) + b * GRAM_BLOCK, indexing="ij")
        upper = i < j
        return pa.table({
            "farm": pa.array([farm] * int(upper.sum()), pa.string()), "i": pa.array(i[upper].astype(np.int32)),
            "j": pa.array(j[upper].astype(np.int32)), "corr": pa.array(corr[upper], from_pandas=True),
        })

    return run


def correlation(raw: DataFrame, sensors: list[str]) -> DataFrame:
    """Pearson correlation of each sensor pair over the rows where both are present.

    Tasks multiply blocks of columns (values times values, values times presence), so the plan does
    not grow with the number of pairs; a block's partial sums, a bounded array per task, meet by
    (farm, block pair). Sums are taken around each farm's mean, which a first pass gives. A pair
    without spread has none.
    """
    names = [F.col(f"`{s}`").cast("double").alias(f"c{i}") for i, s in enumerate(sensors)]
    numbers = raw.select(F.col("farm").cast("string").alias("farm"), *names)
    means = numbers.groupBy("farm").agg(*[F.avg(F.nanvl(f"c{i}", F.lit(None))).alias(f"c{i}") for i in range(len(sensors))])
    shifts = {r["farm"]: [r[f"c{i}"] or 0.0 for i in range(len(sensors))] for r in means.collect()}  # a row per farm
    listed = F.array(*[F.lit(s) for s in sensors])
    return (
        numbers.mapInArrow(_grams(shifts, len(sensors)), GRAMS)
        .groupBy("farm", "a", "b").applyInArrow(_correlations(len(sensors)), "farm string, i int, j int, corr double")
        .select("farm", F.element_at(listed, F.col("i") + 1).alias("sensor_a"),
                F.element_at(listed, F.col("j") + 1).alias("sensor_b"), "corr")
    )


def prediction_rows(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the prediction slice in each event's file; events without a file count zero."""
    counts = raw.groupBy("farm", "file_event_id").agg(
        F.count_if(F.col("train_test") == "prediction").alias("n_prediction")
    )
    return events.join(counts, ["farm", "file_event_id"], "left").na.fill(0, ["n_prediction"])


def best_events(counted: DataFrame) -> DataFrame:
    """Event with most prediction rows: per category among anomalies, per farm among normals.

    The first listed event wins a tie; groups without any prediction row are left out.
    """
    listed = F.col("event_id").cast("bigint")
    better = F.struct(F.col("n_prediction"), -listed)
    slot = F.when(F.col("event_label") == "anomaly", F.col("category")).otherwise("baseline")
    return (
        counted.where("n_prediction > 0")
        .withColumn("slot", slot)
        .groupBy("farm", "slot")
        .agg(
            F.max_by("event_id", better).alias("event_id"),
            F.max("n_prediction").alias("n_prediction"),
        )
    )


def degradation_curves(
    windows: DataFrame, best: DataFrame, sensors: list[str], per_day: int = 144
) -> DataFrame:
    """Anomaly and baseline averages on a common relative-time grid.

    ``windows`` holds the prediction rows of event files with ``rel_days``. Rows are averaged
    per grid cell before the two kinds of events are aligned.
    """
    chosen = windows.join(F.broadcast(best.select("farm", "slot", "event_id")), ["farm", "event_id"])
    cell = F.floor(F.col("rel_days") * F.lit(per_day)).cast("bigint")
    long = unpivoted(
        chosen.withColumn("cell", cell), ["farm", "slot", "event_id", "cell"], sensors
    )
    curve = long.groupBy("farm", "slot", "event_id", "sensor", "cell").agg(
        F.avg("value").alias("value")
    )
    keys = ["farm", "sensor", "cell"]
    base = curve.where("slot = 'baseline'").select(*keys, F.col("value").alias("baseline_value"))
    faulty = curve.where("slot <> 'baseline'").withColumnRenamed("value", "anomaly_value")
    slots = faulty.select("farm", "slot", "event_id").distinct()
    grid = base.join(F.broadcast(slots), "farm")
    return faulty.join(grid, [*keys, "slot", "event_id"], "full").select(
        *keys, "slot", "event_id", "anomaly_value", "baseline_value"
    )
