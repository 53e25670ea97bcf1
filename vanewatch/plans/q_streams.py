"""Queries that run as streams to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanewatch.functions import labels
from vanewatch.operators import serving
from vanewatch.plans import fleet_view as fv
from vanewatch.plans.fleet_view import sql
from vanewatch.plans.q_ingest import ALERT_COLUMNS, ALERTS_SQL, corrected, delivered
from vanewatch.plans.q_rows import rounded
from vanewatch.plans.registry import query
from vanewatch.session import work_path
from vanewatch.streaming import ingest, rollup, state


def arriving(df, path: str) -> None:
    """Add files to a folder that a stream watches."""
    df.write.mode("append").parquet(path)


def watch(spark, path: str, schema):
    return spark.readStream.schema(schema).parquet(path)


@query("stream_late_upsert", sql("""
    SELECT farm, asset_id, id, time_stamp, event_id,
      CASE WHEN status_type_id = 4 THEN sensor_1_avg + 1 ELSE sensor_1_avg END AS sensor_1_avg FROM tagged""", "tagged"))
def stream_late_upsert(spark, sf_dir):
    """A first delivery and a late correction, each picked up by a run of the same stream."""
    root, rows = work_path(spark, "late"), fv.scada(spark, sf_dir)
    for when, batch in (("2024-02-01", rows), ("2024-02-02", corrected(rows))):
        arriving(delivered(batch, when), f"{root}/raw")
        schema = delivered(rows, when).schema
        ingest.upsert_silver(
            spark, f"{root}/raw", schema, fv.event_info(spark, sf_dir), f"{root}/silver", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/silver").select(
        "farm", "asset_id", "id", "time_stamp", "event_id", "sensor_1_avg")


@query("stream_retag", sql(
    "SELECT farm, asset_id, id, time_stamp, event_id, event_label, event_description, sensor_1_avg FROM tagged", "tagged"))
def stream_retag(spark, sf_dir):
    """Readings stored under an older event table; a second run brings new events and no readings."""
    root, rows, events = work_path(spark, "retag"), fv.scada(spark, sf_dir), fv.event_info(spark, sf_dir)
    number = F.regexp_extract("event_id", "[0-9]+", 0).cast("long")
    moved = F.col("event_end") + F.expr("INTERVAL 30 HOURS")
    older = (
        events.where(number % 3 != 0)
        .withColumn("event_end", F.when(number % 5 == 0, moved).otherwise(F.col("event_end")))
        .withColumn("event_label", F.when(number % 7 == 0, "normal").otherwise(F.col("event_label")))
    )
    raw = delivered(rows, "2024-02-01")
    arriving(raw, f"{root}/raw")
    for known in (older, events):
        ingest.upsert_silver(spark, f"{root}/raw", raw.schema, known, f"{root}/silver", f"{root}/checkpoint")
    return ingest.read_evolving(spark, f"{root}/silver").select(
        "farm", "asset_id", "id", "time_stamp", *ingest.EVENT_COLUMNS, "sensor_1_avg")


@query("stream_dedup", sql("SELECT farm, asset_id, time_stamp, sensor_1_avg FROM scada", "scada"))
def stream_dedup(spark, sf_dir):
    """Every reading delivered twice."""
    root = work_path(spark, "dedup")
    rows = fv.scada(spark, sf_dir).select("farm", "asset_id", "time_stamp", "sensor_1_avg")
    for _ in range(2):
        arriving(rows, f"{root}/raw")
    unique = state.first_arrivals(
        watch(spark, f"{root}/raw", rows.schema), ["farm", "asset_id", "time_stamp"], "time_stamp", "1 hour")
    ingest.run_available(
        unique.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("stream_alerts", sql(ALERTS_SQL, "predictions", "alert_config"))
def stream_alerts(spark, sf_dir):
    """Predictions of two periods; a turbine breaching again refreshes its alert."""
    root, made = work_path(spark, "alerts"), fv.predictions(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp")
    for part in (made.where(F.col("predicted_at") < cut), made.where(F.col("predicted_at") >= cut)):
        arriving(part, f"{root}/in")
        state.keep_alerts(
            watch(spark, f"{root}/in", made.schema), fv.alert_config(spark, sf_dir),
            f"{root}/alerts", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/alerts").select(*ALERT_COLUMNS)


@query("stream_twin_state", sql("""
    SELECT farm || '-' || asset_id AS "turbineId", max(time_stamp) AS "updatedAt",
      arg_max(sensor_1_avg, time_stamp) AS "pitchAngleDeg", arg_max(sensor_2_avg, time_stamp) AS "rotorSpeedRpm"
    FROM scada GROUP BY ALL""", "scada"))
def stream_twin_state(spark, sf_dir):
    root = work_path(spark, "twin")
    rows = fv.scada(spark, sf_dir).select(
        F.concat_ws("-", "farm", "asset_id").alias("turbineId"), "time_stamp", "train_test",
        F.col("sensor_1_avg").alias("pitchAngleDeg"), F.col("sensor_2_avg").alias("rotorSpeedRpm"))
    for period in ("train", "prediction"):
        arriving(rows.where(F.col("train_test") == period), f"{root}/in")
        states = state.latest_states(watch(spark, f"{root}/in", rows.schema), ["pitchAngleDeg", "rotorSpeedRpm"])
        state.keep_states(states, f"{root}/states", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/states").drop("_part")


@query("scheduled_scoring", sql("""
    SELECT "turbineId" || '#' || component AS id, "turbineId", component,
      CASE WHEN "faultProbability" > 0.9 OR "rulHoursP50" < 24 THEN 'critical'
        WHEN "faultProbability" > 0.8 OR "rulHoursP50" < 48 THEN 'high' ELSE 'medium' END AS severity,
      predicted_at AS "createdAt", false AS acknowledged
    FROM (SELECT p.*, coalesce(c."faultProbabilityThreshold", 0.7) AS pt, coalesce(c."rulHoursP50Threshold", 72) AS rt
      FROM (SELECT * FROM predictions QUALIFY row_number() OVER (
        PARTITION BY "turbineId", component ORDER BY predicted_at DESC) = 1) p
      LEFT JOIN alert_config c ON p.component = c.component)
    WHERE "faultProbability" > pt OR "rulHoursP50" < rt""", "predictions", "alert_config"))
def scheduled_scoring(spark, sf_dir):
    """One tick: what arrived is scored, the newest prediction of a component counts."""
    root, made = work_path(spark, "scoring"), fv.predictions(spark, sf_dir)
    arriving(made, f"{root}/in")
    state.score_on_arrival(
        watch(spark, f"{root}/in", made.schema),
        lambda batch: serving.latest_per(batch, ["turbineId", "component"], "predicted_at"),
        fv.alert_config(spark, sf_dir), f"{root}/alerts", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/alerts").select(*ALERT_COLUMNS)


@query("scheduled_isolation", sql("""
    SELECT component, component <> 'SMALL' AS ok, CASE WHEN component <> 'SMALL' THEN n_turbines ELSE 0 END AS n_predictions,
      component = 'SMALL' AS has_error FROM (
      SELECT component, count(DISTINCT "turbineId") AS n_turbines FROM predictions GROUP BY component)""", "predictions"))
def scheduled_isolation(spark, sf_dir):
    """One tick in which the scorer of one component fails; the others store their predictions."""
    root, made = work_path(spark, "isolation"), fv.predictions(spark, sf_dir)
    arriving(made, f"{root}/in")
    names = sorted(r["component"] for r in made.select("component").distinct().collect())

    def scorer(name):
        def score(batch):
            own = serving.latest_per(batch.where(F.col("component") == name), ["turbineId", "component"], "predicted_at")
            return own.select("*", F.col("no_such_column")) if name == "SMALL" else own
        return score

    state.score_components_on_arrival(
        watch(spark, f"{root}/in", made.schema), {n: scorer(n) for n in names},
        fv.alert_config(spark, sf_dir), f"{root}/out", f"{root}/checkpoint")
    kept = spark.read.parquet(f"{root}/out/predictions").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{root}/out/outcomes").join(kept, "component", "left").select(
        "component", "ok", F.coalesce("n", F.lit(0)).alias("n_predictions"), F.col("error").isNotNull().alias("has_error"))


@query("event_time_rollup", sql("""
    SELECT farm, asset_id, make_timestamp((k + j) * 21600 * 1000000) AS window_end, sum(n) AS n_rows,
      round(sum(s) / sum(n), 6) AS mean_value,
      CASE WHEN sum(n) > 1 THEN round(sqrt(greatest(sum(q) - sum(s) * sum(s) / sum(n), 0) / (sum(n) - 1)), 4) END AS std_value
    FROM (SELECT farm, asset_id, CAST(floor(epoch(time_stamp) / 21600) AS BIGINT) AS k, count(*) AS n, sum(sensor_1_avg) AS s,
      sum(sensor_1_avg * sensor_1_avg) AS q FROM scada GROUP BY ALL), generate_series(1, 4) g(j)
    GROUP BY farm, asset_id, k + j""", "scada"))
def event_time_rollup(spark, sf_dir):
    """The batch form of the rollup, a day long every six hours."""
    out = rollup.event_time_rollup(fv.scada(spark, sf_dir), "sensor_1_avg", "24 hours", "6 hours")
    return rounded(rounded(out, ["mean_value"]), ["std_value"], 4)


@query("stream_event_time_rollup")
def stream_event_time_rollup(spark, sf_dir):
    """The same rollup over a stream: windows come out once the watermark has passed them."""
    root, rows = work_path(spark, "rollup"), fv.scada(spark, sf_dir)
    arriving(rows, f"{root}/in")
    out = rollup.event_time_rollup(watch(spark, f"{root}/in", rows.schema), "sensor_1_avg", "24 hours", "6 hours")
    ingest.run_available(out.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("twin_state_writer", sql("""
    SELECT r.farm || '-' || r.rank AS "turbineId", s.updated AS "updatedAt", s.v1 AS "pitchAngleDeg", s.v2 AS "rotorSpeedRpm",
      CASE WHEN h.n IS NULL THEN 'green' WHEN h.last - h.mean > 6 THEN 'red' WHEN h.last - h.mean > 3 THEN 'amber' ELSE 'green' END AS gearbox
    FROM ranks r JOIN (SELECT farm, asset_id, max(time_stamp) AS updated, arg_max(sensor_1_avg, time_stamp) AS v1,
      arg_max(sensor_2_avg, time_stamp) AS v2 FROM scada GROUP BY ALL) s ON r.farm = s.farm AND r.asset_id = s.asset_id
    LEFT JOIN (SELECT turbine_id, count(*) AS n, avg(value) AS mean, arg_max(value, time) AS last FROM (
      SELECT *, max(time) OVER (PARTITION BY turbine_id) AS newest FROM readings)
      WHERE sensor = 'sensor_1' AND time >= newest - INTERVAL 48 HOUR GROUP BY turbine_id) h ON h.turbine_id = r.farm || '-' || r.rank""",
    "ranks", "readings"))
def twin_state_writer(spark, sf_dir):
    """Latest states with component colours, the table the twin reads."""
    ranks = fv.ranks(spark, sf_dir).withColumn("turbine_id", labels.display_id("farm", "rank", "asset_id"))
    rows = fv.scada(spark, sf_dir).join(ranks, ["farm", "asset_id"]).select(
        F.col("turbine_id").alias("turbineId"), "time_stamp",
        F.col("sensor_1_avg").alias("pitchAngleDeg"), F.col("sensor_2_avg").alias("rotorSpeedRpm"))
    latest = state.latest_states(rows, ["pitchAngleDeg", "rotorSpeedRpm"])
    snapshot = serving.health_snapshot(fv.readings(spark, sf_dir), {"Gearbox": "sensor_1"}, ranks)
    colours = serving.health_maps(snapshot).withColumnRenamed("turbine_id", "turbineId")
    return latest.join(colours, "turbineId").select(
        "turbineId", "updatedAt", "pitchAngleDeg", "rotorSpeedRpm", F.col("component_health")["Gearbox"].alias("gearbox"))
