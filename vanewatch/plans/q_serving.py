"""Queries of the serving side: readings, snapshots, predictions, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanewatch.domain import RETENTION_DAYS
from vanewatch.functions import bands, labels
from vanewatch.functions.means import exact_mean
from vanewatch.operators import alerting, extras, health, scoring, serving
from vanewatch.plans import fleet_view as fv
from vanewatch.plans.fleet_view import sql
from vanewatch.plans.q_ingest import ALERT_COLUMNS, ALERTS_SQL
from vanewatch.plans.q_rows import rounded
from vanewatch.plans.registry import query


@query("wide_to_long", sql("SELECT turbine_id, time, sensor, value, unit FROM readings", "readings"))
def wide_to_long(spark, sf_dir):
    return fv.readings(spark, sf_dir)


@query("long_to_wide", sql("""
    SELECT turbine_id, time, max(value) FILTER (sensor = 'sensor_1') AS sensor_1, max(value) FILTER (sensor = 'sensor_2') AS sensor_2,
      max(value) FILTER (sensor = 'sensor_3') AS sensor_3, max(value) FILTER (sensor = 'sensor_4') AS sensor_4
    FROM readings GROUP BY turbine_id, time""", "readings"))
def long_to_wide(spark, sf_dir):
    return serving.wide_by_time(fv.readings(spark, sf_dir), ["sensor_1", "sensor_2", "sensor_3", "sensor_4"])


def requests(spark, sf_dir):
    """Every turbine asks for the two days around its first event."""
    firsts = fv.event_info(spark, sf_dir).groupBy("farm", "asset_id").agg(F.min("event_start").alias("t"))
    named = firsts.join(fv.ranks(spark, sf_dir), ["farm", "asset_id"])
    return named.select(
        F.concat_ws("/", "farm", "asset_id").alias("request_id"),
        labels.display_id("farm", "rank", "asset_id").alias("turbine_id"),
        (F.col("t") - F.expr("INTERVAL 24 HOURS")).alias("from_time"),
        (F.col("t") + F.expr("INTERVAL 24 HOURS")).alias("to_time"),
    )


@query("telemetry_range", sql("""
    SELECT q.request_id, r.turbine_id, r.time, r.sensor, r.value, r.unit FROM readings r JOIN (
      SELECT e.farm || '/' || e.asset_id AS request_id, e.farm || '-' || k.rank AS turbine_id,
        min(e.event_start) - INTERVAL 24 HOUR AS f, min(e.event_start) + INTERVAL 24 HOUR AS t
      FROM event_info e JOIN ranks k ON e.farm = k.farm AND e.asset_id = k.asset_id GROUP BY ALL) q
    ON r.turbine_id = q.turbine_id AND r.time BETWEEN q.f AND q.t""", "readings", "event_info"))
def telemetry_range(spark, sf_dir):
    return serving.telemetry_many(fv.readings(spark, sf_dir), requests(spark, sf_dir))


@query("telemetry_sorted", sql("""
    SELECT time, sensor, value, unit FROM readings WHERE turbine_id = 'A-1'
      AND time BETWEEN TIMESTAMP '2024-01-22' AND TIMESTAMP '2024-02-01' ORDER BY time, sensor""", "readings"))
def telemetry_sorted(spark, sf_dir):
    first, last = (F.lit(d).cast("timestamp") for d in ("2024-01-22", "2024-02-01"))
    return serving.telemetry(fv.readings(spark, sf_dir), "A-1", first, last)


@query("telemetry_page_cap", sql("""
    SELECT time, sensor, value, unit, count(*) OVER () > 20000 AS truncated
    FROM readings WHERE turbine_id = 'A-1' ORDER BY time, sensor LIMIT 20000""", "readings"))
def telemetry_page_cap(spark, sf_dir):
    """A read of all times that stops after the service's 20 pages, here of 1,000 rows, and says so."""
    first, last = (F.lit(d).cast("timestamp") for d in ("1970-01-01", "2100-01-01"))
    return serving.telemetry(fv.readings(spark, sf_dir), "A-1", first, last, max_rows=20 * 1000)


@query("series_sort", sql("""
    SELECT turbine_id, sensor, first_value(value) OVER w AS first_value, time, row_number() OVER w AS position
    FROM readings WINDOW w AS (PARTITION BY turbine_id, sensor ORDER BY time)""", "readings"))
def series_sort(spark, sf_dir):
    """Readings in sequence, with the value a series starts from."""
    r = fv.readings(spark, sf_dir)
    return extras.in_sequence(r).select("turbine_id", "sensor", "first_value", "time", "position")


@query("snapshot_health", sql("""
    SELECT turbine_id, component, round(mean_value, 6) AS mean_value, latest_value,
      CASE WHEN latest_value - mean_value > 6 THEN 'red' WHEN latest_value - mean_value > 3 THEN 'amber' ELSE 'green' END AS health
    FROM (SELECT g.turbine_id, g.component, avg(r.value) AS mean_value, arg_max(r.value, r.time) AS latest_value
      FROM (SELECT DISTINCT k.farm || '-' || k.rank AS turbine_id, c.component, c.sensor FROM ranks k
        CROSS JOIN (VALUES ('Gearbox', 'sensor_1'), ('Generator', 'sensor_2'), ('Pitch System', 'sensor_4')) c(component, sensor)) g
      LEFT JOIN (SELECT r.*, max(time) OVER (PARTITION BY turbine_id) AS newest FROM readings r) r
        ON r.turbine_id = g.turbine_id AND r.sensor = g.sensor AND r.time >= r.newest - INTERVAL 48 HOUR
      GROUP BY ALL)""", "readings"))
def snapshot_health(spark, sf_dir):
    turbines = fv.ranks(spark, sf_dir).select(labels.display_id("farm", "rank", "asset_id").alias("turbine_id"))
    out = serving.health_snapshot(fv.readings(spark, sf_dir), fv.SNAPSHOT_SENSORS, turbines)
    return rounded(out, ["mean_value"])


@query("health_json", sql("""
    SELECT k.farm || '-' || k.rank AS turbine_id, CASE WHEN count(r.value) = 0 THEN '{"Gearbox":"green"}'
      ELSE '{"Gearbox":"' || CASE WHEN arg_max(r.value, r.time) - avg(r.value) > 6 THEN 'red'
        WHEN arg_max(r.value, r.time) - avg(r.value) > 3 THEN 'amber' ELSE 'green' END || '"}' END AS component_health
    FROM ranks k LEFT JOIN (SELECT r.*, max(time) OVER (PARTITION BY turbine_id) AS newest FROM readings r) r
      ON r.turbine_id = k.farm || '-' || k.rank AND r.sensor = 'sensor_1' AND r.time >= r.newest - INTERVAL 48 HOUR
    GROUP BY k.farm, k.rank""", "readings"))
def health_json(spark, sf_dir):
    turbines = fv.ranks(spark, sf_dir).select(labels.display_id("farm", "rank", "asset_id").alias("turbine_id"))
    snapshot = serving.health_snapshot(fv.readings(spark, sf_dir), {"Gearbox": "sensor_1"}, turbines)
    return serving.health_maps(snapshot).select("turbine_id", F.to_json("component_health").alias("component_health"))


@query("latest_features", sql("""
    SELECT farm, asset_id, time_stamp, status_type_id, round(sensor_1_avg_avg_24h, 6) AS sensor_1_avg_avg_24h
    FROM features QUALIFY row_number() OVER (PARTITION BY farm, asset_id ORDER BY time_stamp DESC) = 1""", "features"))
def latest_features(spark, sf_dir):
    out = serving.latest_per(fv.features(spark, sf_dir), ["farm", "asset_id"])
    return rounded(out.select("farm", "asset_id", "time_stamp", "status_type_id", "sensor_1_avg_avg_24h"), ["sensor_1_avg_avg_24h"])


@query("turbine_component_grid", sql("""
    SELECT k.farm, k.asset_id, c.component FROM ranks k CROSS JOIN (VALUES ('gearbox'), ('hydraulics'), ('pitch'),
      ('generator'), ('transformer'), ('rotor_brake'), ('vibration')) c(component)""", "ranks"))
def turbine_component_grid(spark, sf_dir):
    turbines = fv.scada(spark, sf_dir).select("farm", "asset_id").distinct()
    return serving.turbine_components(turbines, list(fv.COMPONENTS))


def score_tables(spark, sf_dir):
    """Four model outputs derived from predictions, each missing some keys."""
    p = fv.predictions(spark, sf_dir).groupBy(F.col("turbineId").alias("turbine_id"), "component").agg(
        F.avg("faultProbability").alias("fault_probability"), F.min("rulHoursP50").alias("p10"),
        F.avg("rulHoursP50").alias("p50"), F.max("rulHoursP50").alias("p90"), F.count(F.lit(1)).alias("n"),
    )
    keys = ["turbine_id", "component"]
    return (
        p.select(*keys, "fault_probability"), p.where("p10 >= 1").select(*keys, "p10"),
        p.where("n >= 2").select(*keys, "p50"), p.where("p90 < 300").select(*keys, "p90"),
    )


@query("all_models_present", sql("""
    SELECT "turbineId" AS turbine_id, component, round(avg("faultProbability"), 6) AS fault_probability,
      min("rulHoursP50") AS p10, round(avg("rulHoursP50"), 6) AS p50, max("rulHoursP50") AS p90
    FROM predictions GROUP BY "turbineId", component HAVING min("rulHoursP50") >= 1 AND count(*) >= 2 AND max("rulHoursP50") < 300""", "predictions"))
def all_models_present(spark, sf_dir):
    return rounded(scoring.complete_scores(*score_tables(spark, sf_dir)), ["fault_probability", "p50"])


@query("trend_model_for_asset", sql("""
    SELECT component, "turbineId" AS asset_id, arg_max("faultProbability", id) AS params, max(id) AS version
    FROM predictions GROUP BY ALL""", "predictions"))
def trend_model_for_asset(spark, sf_dir):
    """Versions of parameters registered over time; the newest per asset counts."""
    registry = fv.predictions(spark, sf_dir).select(
        "component", F.split_part("turbineId", F.lit("-"), F.lit(1)).alias("farm"),
        F.col("turbineId").alias("asset_id"), F.col("faultProbability").alias("params"), F.col("id").alias("version"),
    )
    return scoring.newest_params(registry).select("component", "asset_id", "params", "version")


@query("predictions_filter", sql("""
    SELECT "turbineId", component, id FROM predictions WHERE "turbineId" = 'B-1'
    UNION ALL SELECT "turbineId", component, id FROM predictions WHERE "turbineId" = 'A-0' AND component = 'ECONOMY'""", "predictions"))
def predictions_filter(spark, sf_dir):
    p = fv.predictions(spark, sf_dir).withColumnRenamed("turbineId", "turbine_id")
    both = scoring.requested(p, "B-1").unionByName(scoring.requested(p, "A-0", "ECONOMY"))
    return both.select(F.col("turbine_id").alias("turbineId"), "component", "id")


@query("prediction_event_validation", sql("""
    SELECT id, CASE status_type_id WHEN 1 THEN 'turbineId is required' WHEN 2 THEN 'component is required'
      WHEN 3 THEN 'faultProbability must be a number' WHEN 4 THEN 'rulHoursP50 must be a number' END AS reason FROM predictions""", "predictions"))
def prediction_event_validation(spark, sf_dir):
    s = F.col("status_type_id")
    payload = F.to_json(F.struct(
        F.when(s != 1, F.col("turbineId")).alias("turbineId"),
        F.when(s == 2, "").otherwise(F.col("component")).alias("component"),
        F.when(s != 3, F.col("faultProbability")).alias("faultProbability"),
        F.when(s == 4, F.lit(float("nan"))).otherwise(F.col("rulHoursP50")).alias("rulHoursP50"),
    ))
    raw = fv.predictions(spark, sf_dir).select("id", payload.alias("payload"))
    return alerting.parsed_predictions(raw).select("id", "reason")


@query("threshold_lookup", sql("""
    SELECT p.id, p.component, round(coalesce(c."faultProbabilityThreshold", 0.7), 6) AS fault_threshold,
      round(coalesce(c."rulHoursP50Threshold", 72), 6) AS rul_threshold
    FROM predictions p LEFT JOIN alert_config c ON p.component = c.component""", "predictions", "alert_config"))
def threshold_lookup(spark, sf_dir):
    out = alerting.with_thresholds(fv.predictions(spark, sf_dir), fv.alert_config(spark, sf_dir))
    return out.select(
        "id", "component", F.round("faultProbabilityThreshold", 6).alias("fault_threshold"),
        F.round("rulHoursP50Threshold", 6).alias("rul_threshold"),
    )


@query("alert_breach", sql("""
    SELECT p.id, "faultProbability" > coalesce(c."faultProbabilityThreshold", 0.7)
      OR "rulHoursP50" < coalesce(c."rulHoursP50Threshold", 72) AS breached
    FROM predictions p LEFT JOIN alert_config c ON p.component = c.component""", "predictions", "alert_config"))
def alert_breach(spark, sf_dir):
    out = alerting.with_thresholds(fv.predictions(spark, sf_dir), fv.alert_config(spark, sf_dir))
    return out.select("id", alerting.is_breach().alias("breached"))


@query("alert_severity", sql("""
    SELECT id, CASE WHEN "faultProbability" > 0.9 OR "rulHoursP50" < 24 THEN 'critical'
      WHEN "faultProbability" > 0.8 OR "rulHoursP50" < 48 THEN 'high' ELSE 'medium' END AS severity FROM predictions""", "predictions"))
def alert_severity(spark, sf_dir):
    return fv.predictions(spark, sf_dir).select("id", labels.alert_severity("faultProbability", "rulHoursP50").alias("severity"))


@query("alert_id", sql("""
    SELECT id, "turbineId" || '#' || component AS alert_id FROM predictions""", "predictions"))
def alert_id(spark, sf_dir):
    return fv.predictions(spark, sf_dir).select("id", labels.alert_id().alias("alert_id"))


@query("alert_message", sql("""
    SELECT id, component || ' on ' || "turbineId" AS subject, true AS probability_fits, true AS rul_fits FROM predictions""", "predictions"))
def alert_message(spark, sf_dir):
    """The message taken apart again: two and one decimals of the numbers it reports."""
    text = labels.alert_message("turbineId", "component", "faultProbability", "rulHoursP50")

    def fits(pattern, column, half):
        shown = F.regexp_extract("m", pattern, 1).cast("double")
        return F.abs(shown - F.col(column)) <= half + 1e-9

    return fv.predictions(spark, sf_dir).withColumn("m", text).select(
        "id", F.split_part("m", F.lit(":"), F.lit(1)).alias("subject"),
        fits(r"faultProbability=(\d+\.\d{2}),", "faultProbability", 0.005).alias("probability_fits"),
        fits(r"rulHoursP50=(\d+\.\d)$", "rulHoursP50", 0.05).alias("rul_fits"),
    )


@query("active_alerts", sql(f"SELECT * FROM ({ALERTS_SQL}) WHERE severity <> 'medium'", "predictions", "alert_config"))
def active_alerts(spark, sf_dir):
    """Medium alerts have been acknowledged; the others are active."""
    alerts = alerting.evaluated(fv.predictions(spark, sf_dir), fv.alert_config(spark, sf_dir), "predicted_at")
    acked = alerting.acknowledged(alerts, alerts.where("severity = 'medium'").select("id"))
    return alerting.active(acked).select(*ALERT_COLUMNS)


@query("alert_ack", sql(f"""
    SELECT id, severity, severity = 'critical' AS acknowledged FROM ({ALERTS_SQL})""", "predictions", "alert_config"))
def alert_ack(spark, sf_dir):
    alerts = alerting.evaluated(fv.predictions(spark, sf_dir), fv.alert_config(spark, sf_dir), "predicted_at")
    return alerting.acknowledged(alerts, alerts.where("severity = 'critical'").select("id")).select(
        "id", "severity", "acknowledged"
    )


@query("risk_flag", sql("""
    SELECT id, CASE WHEN "faultProbability" > 0.25 THEN 'red' ELSE 'green' END AS accent FROM predictions""", "predictions"))
def risk_flag(spark, sf_dir):
    return fv.predictions(spark, sf_dir).select("id", labels.risk_flag("faultProbability").alias("accent"))


def forecast_rows(spark, sf_dir):
    """Per asset a three-point series made of its aggregates, with quantile spreads."""
    agg = fv.scada(spark, sf_dir).groupBy("farm", "asset_id").agg(
        F.min("sensor_1_avg").alias("lo"), exact_mean("sensor_1_avg").alias("mid"),
        F.max("sensor_1_avg").alias("hi"), F.max("time_stamp").alias("as_of"),
    )
    return agg.withColumn("values", F.array("lo", "mid", "hi"))


@query("rul_band", sql("""
    SELECT farm, asset_id, i, timestamp, round(value, 6) AS p50,
      round(greatest(0, value - (mid - lo) * (i / 3.0::DOUBLE) * 0.4), 1) AS low,
      round(value + (hi - mid) * (i / 3.0::DOUBLE) * 0.4, 1) AS high
    FROM (SELECT a.*, i, CASE i WHEN 1 THEN lo WHEN 2 THEN mid ELSE hi END AS value, as_of + to_days(i) AS timestamp
      FROM (SELECT farm, asset_id, min(sensor_1_avg) AS lo, avg(sensor_1_avg) AS mid, max(sensor_1_avg) AS hi, max(time_stamp) AS as_of
        FROM scada GROUP BY ALL) a CROSS JOIN (VALUES (1), (2), (3)) h(i))""", "scada"))
def rul_band(spark, sf_dir):
    f = forecast_rows(spark, sf_dir)
    f = f.withColumn("series", bands.forecast_points("values", F.col("as_of")))
    band = f.withColumn("band", bands.rul_band("series", "lo", "mid", "hi"))
    return band.select("farm", "asset_id", F.posexplode("band").alias("pos", "b")).select(
        "farm", "asset_id", (F.col("pos") + 1).alias("i"), "b.timestamp", F.round("b.p50", 6).alias("p50"), "b.low", "b.high"
    )


@query("forecast_timestamps", sql("""
    SELECT farm, asset_id, i, newest + to_days(i) AS timestamp FROM (SELECT farm, asset_id, max(time_stamp) AS newest
      FROM scada GROUP BY ALL) CROSS JOIN (VALUES (1), (2), (3)) h(i)""", "scada"))
def forecast_timestamps(spark, sf_dir):
    f = forecast_rows(spark, sf_dir).withColumn("series", bands.forecast_points("values", F.col("as_of")))
    return f.select("farm", "asset_id", F.posexplode("series").alias("pos", "s")).select(
        "farm", "asset_id", (F.col("pos") + 1).alias("i"), "s.timestamp"
    )


@query("forecast_index", sql("""
    SELECT farm, asset_id, i, round(i / 3.0::DOUBLE, 6) AS factor FROM (SELECT DISTINCT farm, asset_id FROM scada)
    CROSS JOIN (VALUES (1), (2), (3)) h(i)""", "scada"))
def forecast_index(spark, sf_dir):
    f = forecast_rows(spark, sf_dir)
    factors = F.transform("values", lambda v, i: F.round(bands.horizon_factor(i, F.size("values")), 6))
    return f.select("farm", "asset_id", F.posexplode(factors).alias("pos", "factor")).select(
        "farm", "asset_id", (F.col("pos") + 1).alias("i"), "factor"
    )


@query("retention_tiers", sql("""
    SELECT env, count(*) AS n_rows FROM (SELECT *, max(time) OVER () AS newest FROM readings)
    JOIN (VALUES ('hot', 24), ('dev', 168), ('staging', 4320), ('uat', 8760)) t(env, hours)
      ON time >= newest - to_hours(hours) GROUP BY env""", "readings"))
def retention_tiers(spark, sf_dir):
    """How many readings each environment's retention keeps."""
    r = fv.readings(spark, sf_dir)
    newest = r.agg(F.max("time"))
    age = F.unix_micros(newest.scalar()) - F.unix_micros("time")
    hours = {"hot": 24, **{env: days * 24 for env, days in RETENTION_DAYS.items()}}
    counted = r.agg(*[F.count_if(age <= F.lit(h * 3_600_000_000)).alias(env) for env, h in hours.items()])
    return counted.unpivot([], list(hours), "env", "n_rows")


@query("implausible_filter", sql("""
    SELECT l.id, l.sensor, l.value FROM long_rows l JOIN (SELECT sensor, quantile_disc(value, 0.0) AS lo, 300.0 AS hi
      FROM long_rows GROUP BY sensor) r ON l.sensor = r.sensor WHERE l.value BETWEEN r.lo AND r.hi""", "long_rows"))
def implausible_filter(spark, sf_dir):
    """Values outside a sensor's physical range are left out."""
    long = serving.unpivoted(fv.scada(spark, sf_dir), ["id"], fv.SENSORS)
    ranges = long.groupBy("sensor").agg(F.min("value").alias("low"), F.lit(300.0).alias("high"))
    return extras.plausible(long, ranges).select("id", "sensor", "value")


@query("stuck_sensor", sql("""
    SELECT farm, asset_id, status, min(time_stamp) AS first_time, max(time_stamp) AS last_time, count(*) AS n_rows FROM (
      SELECT *, sum(changed) OVER (PARTITION BY farm, asset_id ORDER BY time_stamp, id) AS run FROM (
        SELECT farm, asset_id, time_stamp, id, status_type_id AS status, CASE WHEN status_type_id = lag(status_type_id)
          OVER (PARTITION BY farm, asset_id ORDER BY time_stamp, id) THEN 0 ELSE 1 END AS changed FROM scada))
    GROUP BY farm, asset_id, run, status HAVING count(*) >= 3""", "scada"))
def stuck_sensor(spark, sf_dir):
    """Runs of at least three equal readings in a row, here of the status."""
    rows = fv.scada(spark, sf_dir).withColumn("status", F.col("status_type_id").cast("double"))
    return extras.constant_runs(rows, ["farm", "asset_id"], "status", 3).withColumn(
        "status", F.col("status").cast("int"))


@query("sustained_offset", sql("""
    SELECT farm, asset_id, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM (
      SELECT *, CAST(day AS DATE) - CAST(row_number() OVER (PARTITION BY farm, asset_id ORDER BY day) AS INTEGER) AS island FROM (
        SELECT *, abs(sensor_1_avg_avg_24h - avg(sensor_1_avg_avg_24h) OVER (PARTITION BY farm, asset_id)) > 10 AS off FROM daily)
      WHERE off) GROUP BY farm, asset_id, island HAVING count(*) >= 2""", "daily"))
def sustained_offset(spark, sf_dir):
    column = "sensor_1_avg_avg_24h"
    daily = health.daily_means(fv.features(spark, sf_dir, ["sensor_1_avg"]), [column])
    return health.sustained_offset(daily, column, 10.0, 2)


@query("event_severity", sql("""
    SELECT event_id, category, CASE WHEN (epoch_us(event_end) - epoch_us(event_start)) / 86400000000.0::DOUBLE > 14 THEN 'high'
      WHEN category = 'other' THEN 'low' ELSE 'medium' END AS severity FROM (SELECT DISTINCT event_id, category, event_start, event_end FROM faults)""", "faults"))
def event_severity(spark, sf_dir):
    f = fv.faults(spark, sf_dir).select("event_id", "category", "event_start", "event_end").distinct()
    return extras.with_event_severity(f, fv.OTHER).select("event_id", "category", "severity")
