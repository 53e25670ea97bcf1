"""Keyed state kept up to date from streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.operators.alerting import evaluated
from vanewatch.sources.tables import (
    drop_partition, exists, overwrite, overwrite_partitions, read_table, upsert,
)
from vanewatch.streaming.gold import isolated
from vanewatch.streaming.ingest import run_available

#: Partitions of a keyed table that does not say otherwise.
KEY_PARTITIONS = 16


def _property(path: str) -> str:
    return f"{path.rstrip('/')}_partitions"


def key_partitions(spark: SparkSession, path: str) -> int | None:
    """Into how many partitions the keys of a table are dealt; ``None`` without a table."""
    if exists(spark, _property(path)):
        return int(spark.read.text(_property(path)).first()["value"])
    return KEY_PARTITIONS if exists(spark, path) else None


def _keep_partitions(spark: SparkSession, path: str, partitions: int) -> None:
    spark.createDataFrame([(str(partitions),)], "value string").coalesce(1).write.mode("overwrite").text(_property(path))


def _dealt(df: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    return df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int"))


def upsert_keyed(
    df: DataFrame, path: str, keys: list[str], newest_first: list[Column], partitions: int = KEY_PARTITIONS
) -> None:
    """Put whole rows by key; a hash of the key decides the partition that is rewritten.

    How many partitions there are is a property of the table, kept beside it: ``partitions`` counts
    when the table is made, later writes follow the table. A small batch rewrites the partitions of
    its keys only, so more partitions make small batches cheaper and large ones no dearer.
    """
    spark = df.sparkSession
    known = key_partitions(spark, path)
    if known is None:
        _keep_partitions(spark, path, partitions)
    upsert(_dealt(df, keys, known or partitions), path, keys, newest_first, ["_part"])


def redeal_keys(spark: SparkSession, path: str, keys: list[str], partitions: int) -> None:
    """Deal a table anew into another number of partitions; no write may run meanwhile.

    The rows are first kept in a second table, from which this can be run again if it fails.
    """
    stored = read_table(spark, path)
    if stored is None:
        return
    beside = f"{path.rstrip('/')}_redealt"
    overwrite(_dealt(stored.drop("_part"), keys, partitions), beside, ["_part"])
    overwrite(spark.read.parquet(beside), path, ["_part"])
    _keep_partitions(spark, path, partitions)
    drop_partition(spark, beside)


def first_arrivals(stream: DataFrame, keys: list[str], clock: str, delay: str) -> DataFrame:
    """Drop repeated readings within the watermark; the first one to arrive stays."""
    return stream.withWatermark(clock, delay).dropDuplicatesWithinWatermark(keys)


def keep_alerts(
    predictions: DataFrame, config: DataFrame, path: str, checkpoint: str, clock: str = "predicted_at"
) -> None:
    """Evaluate predictions as they arrive; a repeated breach refreshes the same alert."""

    def load(batch: DataFrame, batch_id: int) -> None:
        upsert_keyed(evaluated(batch, config, clock), path, ["id"], [F.col("createdAt").desc()])

    run_available(predictions.writeStream.foreachBatch(load), checkpoint)


def latest_states(readings: DataFrame, values: list[str], clock: str = "time_stamp") -> DataFrame:
    """Latest row per turbine; a turbine that never reported has none."""
    newest = F.max_by(F.struct(*values), F.struct(F.col(clock), F.struct(*values)))
    return (
        readings.groupBy("turbineId")
        .agg(F.max(clock).alias("updatedAt"), newest.alias("_state"))
        .select("turbineId", "updatedAt", "_state.*")
    )


def keep_states(states: DataFrame, path: str, checkpoint: str) -> None:
    """Publish changed turbines only and keep the table of latest states."""

    def load(batch: DataFrame, batch_id: int) -> None:
        upsert_keyed(batch, path, ["turbineId"], [F.col("updatedAt").desc()])

    run_available(states.writeStream.outputMode("update").foreachBatch(load), checkpoint)


def score_on_arrival(
    features: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    config: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = None,
):
    """Score what changed and feed the predictions to the alerts.

    With ``every`` (such as ``"60 seconds"``) the query keeps running on that schedule and is
    returned; without, it handles what is available and stops. ``score`` maps a micro-batch to
    prediction rows with ``predicted_at``.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        alerts = evaluated(score(batch), config, "predicted_at")
        upsert_keyed(alerts, path, ["id"], [F.col("createdAt").desc()])

    writer = features.writeStream.foreachBatch(load)
    if every is None:
        return run_available(writer, checkpoint)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def score_components_on_arrival(
    features: DataFrame,
    scorers: dict[str, Callable[[DataFrame], DataFrame]],
    config: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = None,
    workers: int = 4,
):
    """Score every component of what changed on its own and feed the predictions to the alerts.

    Predictions are kept by component in ``{path}/predictions``; ``{path}/outcomes`` has a row per
    component and batch. A component whose scorer fails keeps the predictions it had, raises no
    alert for this batch, and does not hold up the others. ``every`` as in ``score_on_arrival``.
    """
    kept, alerts = f"{path}/predictions", f"{path}/alerts"

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()

        def score(component: str) -> None:
            scored = scorers[component](held).withColumns({"component": F.lit(component), "_batch": F.lit(batch_id)})
            overwrite_partitions(scored, kept, ["component"])

        outcomes = isolated(spark, "score", scorers, score, workers).withColumn("_batch", F.lit(batch_id)).persist()
        overwrite_partitions(outcomes, f"{path}/outcomes", ["_batch"])
        done = [r["component"] for r in outcomes.where("ok").select("component").collect()]
        stored = read_table(spark, kept) if done else None
        if stored is not None:
            fresh = stored.where(F.col("component").isin(done) & (F.col("_batch") == batch_id)).drop("_batch")
            upsert_keyed(evaluated(fresh, config, "predicted_at"), alerts, ["id"], [F.col("createdAt").desc()])
        outcomes.unpersist()
        held.unpersist()

    writer = features.writeStream.foreachBatch(load)
    if every is None:
        return run_available(writer, checkpoint)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
