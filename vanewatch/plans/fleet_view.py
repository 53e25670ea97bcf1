"""The shared test tables seen as a fleet: readings, labelled events and predictions.

Every view is defined twice, as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.operators.faults import event_assets, fault_events
from vanewatch.operators.rolling import rolling_features
from vanewatch.operators.serving import sensor_readings, turbine_ranks
from vanewatch.operators.tagging import tag_events
from vanewatch.session import work_path
from vanewatch.sources.tables import overwrite

SENSORS = ["sensor_1_avg", "sensor_2_avg", "sensor_3", "sensor_4_avg"]
FEATURED = ["sensor_1_avg", "sensor_2_avg"]

# Word lists in the vocabulary of the part names that serve as descriptions here.
FAULTS = {"gearbox": ["gear"], "hydraulic": ["rod", "bolt"], "pitch": ["plate"], "bearing": ["ring"]}
OTHER = "other"
COMPONENTS = {
    "gearbox": ["gear"],
    "hydraulics": ["bolt", "rod"],
    "pitch": ["plate"],
    "generator": ["widget"],
    "transformer": ["ring"],
    "rotor_brake": ["anvil"],
    "vibration": ["gizmo"],
}
BONUS = ["small", "economy", "old", "medium"]
SNAPSHOT_SENSORS = {"Gearbox": "sensor_1", "Generator": "sensor_2", "Pitch System": "sensor_4"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scada(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    status = F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "signup", 2).when(
        kind == "purchase", 3
    ).otherwise(4)
    return e.select(
        F.substring(F.lit("ABC"), (F.col("user_id") % 3 + 1).cast("int"), F.lit(1)).alias("farm"),
        F.col("user_id").alias("asset_id"),
        F.col("event_id").alias("id"),
        ts.alias("time_stamp"),
        status.alias("status_type_id"),
        F.when(F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz"), "prediction")
        .otherwise("train")
        .alias("train_test"),
        F.col("value").alias("sensor_1_avg"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("sensor_2_avg"),
        (F.hour(ts) * 60 + F.minute(ts)).cast("double").alias("sensor_3"),
        F.when(kind != "purchase", F.col("value")).alias("sensor_4_avg"),
        F.concat(F.lit("comma_"), F.col("user_id"), F.lit(".csv")).alias("_source_file"),
        F.col("user_id").cast("int").alias("file_event_id"),
    )


def event_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong downtime readings announce an event; the reading's code names the part."""
    s = scada(spark, sf_dir).where("status_type_id = 4 AND sensor_1_avg >= 100")
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("code"), F.col("p_name").alias("event_description")
    )
    return (
        s.withColumn("code", F.col("sensor_2_avg").cast("bigint"))
        .join(names, "code", "left")
        .select(
            "farm",
            "asset_id",
            F.col("id").cast("string").alias("event_id"),
            F.when(F.col("sensor_2_avg") < 67, "anomaly").otherwise("normal").alias("event_label"),
            (F.col("time_stamp") + F.expr("INTERVAL 12 HOURS")).alias("event_start"),
            (F.col("time_stamp") + F.expr("INTERVAL 60 HOURS")).alias("event_end"),
            "event_description",
            "file_event_id",
        )
    )


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled event per data file: the first of its asset."""
    e = event_info(spark, sf_dir)
    first = F.min_by(F.struct(*[c for c in e.columns if c not in ("farm", "file_event_id")]),
                     F.struct("event_start", "event_id"))
    return e.groupBy("farm", "file_event_id").agg(first.alias("e")).select("farm", "file_event_id", "e.*")


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("sensor_"), "p_partkey").alias("sensor_name"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.col("p_brand").alias("unit"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_events(scada(spark, sf_dir), event_info(spark, sf_dir))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fault_events(
        event_info(spark, sf_dir), event_assets(tagged(spark, sf_dir)), FAULTS, OTHER
    )


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Written to a table and read back, as gold tables are before others build on them."""
    path = work_path(spark, label)
    overwrite(df, path)
    return spark.read.parquet(path)


def stored_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, faults(spark, sf_dir), "faults")


def features(spark: SparkSession, sf_dir: str, sensors: list[str] | None = None) -> DataFrame:
    return rolling_features(tagged(spark, sf_dir), sensors or FEATURED)


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as a table to look columns up in."""
    return scada(spark, sf_dir).select("farm", "asset_id", "time_stamp", *SENSORS)


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turbine_ranks(scada(spark, sf_dir))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = stored(spark, ranks(spark, sf_dir), "ids")
    return sensor_readings(scada(spark, sf_dir), ids, SENSORS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings taken as predictions: the code as probability, the value as remaining hours."""
    kinds = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("code"), F.col("p_type").alias("component")
    )
    s = scada(spark, sf_dir).withColumn("code", F.col("sensor_2_avg").cast("bigint"))
    return s.join(kinds, "code").select(
        F.concat_ws("-", "farm", "asset_id").alias("turbineId"),
        "component",
        (F.col("sensor_2_avg") / 100).alias("faultProbability"),
        F.col("sensor_1_avg").alias("rulHoursP50"),
        F.col("time_stamp").alias("predicted_at"),
        "id",
        "status_type_id",
    )


def alert_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds per component with missing rows and missing fields."""
    return (
        table(spark, sf_dir, "part")
        .where("p_type <> 'LARGE'")
        .groupBy(F.col("p_type").alias("component"))
        .agg(
            F.when(F.col("component") != "PROMO", F.round(F.avg("p_size") / 40, 2)).alias("faultProbabilityThreshold"),
            F.when(F.col("component") != "SMALL", F.round(F.min("p_retailprice") / 20, 2)).alias("rulHoursP50Threshold"),
        )
    )


_VIEWS: dict[str, tuple[list[str], str]] = {
    "scada": ([], """
        SELECT substr('ABC', CAST(user_id % 3 AS INTEGER) + 1, 1) AS farm, user_id AS asset_id,
          event_id AS id, ts AS time_stamp,
          CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2
            WHEN 'purchase' THEN 3 ELSE 4 END AS status_type_id,
          CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN 'prediction' ELSE 'train' END AS train_test,
          value AS sensor_1_avg,
          CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS sensor_2_avg,
          CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS sensor_3,
          CASE WHEN event_type <> 'purchase' THEN value END AS sensor_4_avg,
          'comma_' || user_id || '.csv' AS _source_file, CAST(user_id AS INTEGER) AS file_event_id
        FROM events"""),
    "event_info": (["scada"], """
        SELECT s.farm, s.asset_id, CAST(s.id AS VARCHAR) AS event_id,
          CASE WHEN s.sensor_2_avg < 67 THEN 'anomaly' ELSE 'normal' END AS event_label,
          s.time_stamp + INTERVAL 12 HOUR AS event_start,
          s.time_stamp + INTERVAL 60 HOUR AS event_end,
          p.p_name AS event_description, s.file_event_id
        FROM scada s LEFT JOIN part p ON p.p_partkey = CAST(s.sensor_2_avg AS BIGINT)
        WHERE s.status_type_id = 4 AND s.sensor_1_avg >= 100"""),
    "file_events": (["event_info"], """
        SELECT * FROM event_info QUALIFY row_number() OVER (
          PARTITION BY farm, file_event_id ORDER BY event_start, event_id) = 1"""),
    "descriptions": ([], """
        SELECT 'sensor_' || p_partkey AS sensor_name, p_name || ' ' || p_type AS description,
          p_brand AS unit FROM part"""),
    "tagged": (["scada", "event_info"], """
        SELECT s.*, e.event_id, e.event_label, e.event_description
        FROM scada s LEFT JOIN event_info e ON s.farm = e.farm AND s.asset_id = e.asset_id
          AND s.time_stamp BETWEEN e.event_start AND e.event_end
        QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY e.event_start, e.event_id) = 1"""),
    "faults": (["tagged", "event_info"], """
        SELECT e.farm, e.event_id,
          CASE WHEN contains(lower(e.event_description), 'gear') THEN 'gearbox'
            WHEN contains(lower(e.event_description), 'rod')
              OR contains(lower(e.event_description), 'bolt') THEN 'hydraulic'
            WHEN contains(lower(e.event_description), 'plate') THEN 'pitch'
            WHEN contains(lower(e.event_description), 'ring') THEN 'bearing'
            ELSE 'other' END AS category,
          e.event_start, e.event_end, e.event_description, a.asset_id
        FROM event_info e LEFT JOIN (
          SELECT DISTINCT farm, event_id, asset_id FROM tagged WHERE event_id IS NOT NULL) a
          ON e.farm = a.farm AND e.event_id = a.event_id
        WHERE e.event_label = 'anomaly'"""),
    "features": (["tagged"], """
        SELECT farm, asset_id, time_stamp, status_type_id, event_id, event_label, id,
          avg(sensor_1_avg) OVER h1 AS sensor_1_avg_avg_1h, stddev_samp(sensor_1_avg) OVER h1 AS sensor_1_avg_std_1h,
          avg(sensor_2_avg) OVER h1 AS sensor_2_avg_avg_1h, stddev_samp(sensor_2_avg) OVER h1 AS sensor_2_avg_std_1h,
          avg(sensor_1_avg) OVER h6 AS sensor_1_avg_avg_6h, stddev_samp(sensor_1_avg) OVER h6 AS sensor_1_avg_std_6h,
          avg(sensor_2_avg) OVER h6 AS sensor_2_avg_avg_6h, stddev_samp(sensor_2_avg) OVER h6 AS sensor_2_avg_std_6h,
          avg(sensor_1_avg) OVER h24 AS sensor_1_avg_avg_24h, stddev_samp(sensor_1_avg) OVER h24 AS sensor_1_avg_std_24h,
          avg(sensor_2_avg) OVER h24 AS sensor_2_avg_avg_24h, stddev_samp(sensor_2_avg) OVER h24 AS sensor_2_avg_std_24h
        FROM (SELECT *, CAST(floor(epoch(time_stamp)) AS BIGINT) AS sec FROM tagged)
        WINDOW h1 AS (PARTITION BY farm, asset_id ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW),
          h6 AS (PARTITION BY farm, asset_id ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW),
          h24 AS (PARTITION BY farm, asset_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"""),
    "rul": (["tagged", "faults"], """
        SELECT t.farm, t.asset_id, t.time_stamp, f.event_id,
          (CAST(floor(epoch(f.event_start)) AS BIGINT) - CAST(floor(epoch(t.time_stamp)) AS BIGINT)) / 3600.0::DOUBLE
            AS hours_to_failure
        FROM tagged t JOIN faults f ON t.farm = f.farm AND t.asset_id = f.asset_id
          AND t.time_stamp < f.event_start
          AND CAST(floor(epoch(f.event_start)) AS BIGINT) - CAST(floor(epoch(t.time_stamp)) AS BIGINT) <= 720 * 3600
        WHERE t.event_id IS NULL
        QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY f.event_start, f.event_id) = 1"""),
    "ranks": (["scada"], """
        SELECT farm, asset_id, row_number() OVER (
          PARTITION BY farm ORDER BY length(CAST(asset_id AS VARCHAR)), CAST(asset_id AS VARCHAR)) AS rank
        FROM (SELECT DISTINCT farm, asset_id FROM scada)"""),
    "long_rows": (["scada"], """
        SELECT farm, asset_id, time_stamp, train_test, id, _source_file, file_event_id, sensor, value FROM (
          SELECT *, 'sensor_1' AS sensor, sensor_1_avg AS value FROM scada UNION ALL
          SELECT *, 'sensor_2' AS sensor, sensor_2_avg AS value FROM scada UNION ALL
          SELECT *, 'sensor_3' AS sensor, sensor_3 AS value FROM scada UNION ALL
          SELECT *, 'sensor_4' AS sensor, sensor_4_avg AS value FROM scada)
        WHERE value IS NOT NULL"""),
    "readings": (["long_rows", "ranks"], """
        SELECT l.farm || '-' || r.rank AS turbine_id, l.time_stamp AS time, l.sensor, l.value, '' AS unit
        FROM long_rows l JOIN ranks r ON l.farm = r.farm AND l.asset_id = r.asset_id
        WHERE l.train_test = 'prediction'"""),
    "predictions": (["scada"], """
        SELECT s.farm || '-' || s.asset_id AS "turbineId", p.p_type AS component,
          s.sensor_2_avg / 100 AS "faultProbability", s.sensor_1_avg AS "rulHoursP50",
          s.time_stamp AS predicted_at, s.id, s.status_type_id
        FROM scada s JOIN part p ON p.p_partkey = CAST(s.sensor_2_avg AS BIGINT)"""),
    "alert_config": ([], """
        SELECT p_type AS component,
          CASE WHEN p_type <> 'PROMO' THEN round(avg(p_size) / 40, 2) END AS "faultProbabilityThreshold",
          CASE WHEN p_type <> 'SMALL' THEN round(min(p_retailprice) / 20, 2) END AS "rulHoursP50Threshold"
        FROM part WHERE p_type <> 'LARGE' GROUP BY p_type"""),
    "categorised": (["event_info"], """
        SELECT *, (epoch_us(event_end) - epoch_us(event_start)) / 86400000000.0::DOUBLE AS duration_days,
          CASE WHEN event_label <> 'anomaly' THEN 'Normal (n/a)'
            WHEN contains(lower(event_description), 'gear') THEN 'gearbox'
            WHEN contains(lower(event_description), 'rod') OR contains(lower(event_description), 'bolt') THEN 'hydraulic'
            WHEN contains(lower(event_description), 'plate') THEN 'pitch'
            WHEN contains(lower(event_description), 'ring') THEN 'bearing' ELSE 'other' END AS category
        FROM event_info"""),
    "daily": (["features"], """
        SELECT farm, asset_id, date_trunc('day', time_stamp)::TIMESTAMP AS day,
          avg(sensor_1_avg_avg_24h) AS sensor_1_avg_avg_24h, avg(sensor_2_avg_avg_24h) AS sensor_2_avg_avg_24h
        FROM features GROUP BY ALL"""),
    "health": (["daily"], """
        SELECT farm, asset_id, day, z1, z2,
          -(coalesce(z1, 0) + coalesce(z2, 0)) / nullif((z1 IS NOT NULL)::INT + (z2 IS NOT NULL)::INT, 0) AS health
        FROM (SELECT *,
          (sensor_1_avg_avg_24h - avg(sensor_1_avg_avg_24h) OVER w) / nullif(stddev_pop(sensor_1_avg_avg_24h) OVER w, 0) AS z1,
          (sensor_2_avg_avg_24h - avg(sensor_2_avg_avg_24h) OVER w) / nullif(stddev_pop(sensor_2_avg_avg_24h) OVER w, 0) AS z2
          FROM daily WINDOW w AS (PARTITION BY farm, asset_id))"""),
    "series": (["health"], """
        SELECT farm, asset_id, day, coalesce(
          last_value(health IGNORE NULLS) OVER (PARTITION BY farm, asset_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          first_value(health IGNORE NULLS) OVER (PARTITION BY farm, asset_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS health,
          row_number() OVER (PARTITION BY farm, asset_id ORDER BY day) AS pos,
          count(*) OVER (PARTITION BY farm, asset_id) AS n_days
        FROM health"""),
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` below the common table expressions it uses."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = _VIEWS[name]
        for n in needs:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        add(v)
    if not ordered:
        return body
    kind = "WITH RECURSIVE" if recursive else "WITH"
    ctes = ", ".join(f"{n} AS ({_VIEWS[n][1]})" for n in ordered)
    joint = ", " if body.lstrip().startswith("+") else " "
    return f"{kind} {ctes}{joint}{body.lstrip().lstrip('+')}"
