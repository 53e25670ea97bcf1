"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanewatch.domain import FARMS
from vanewatch.operators import cleaning, faults, kpi, quality, serving
from vanewatch.operators.alerting import active, evaluated
from vanewatch.plans import fleet_view as fv
from vanewatch.plans.fleet_view import sql
from vanewatch.plans.registry import query
from vanewatch.schemas import FAULT_EVENTS
from vanewatch.session import work_path
from vanewatch.sources import files, landing, tables
from vanewatch.streaming.ingest import ingest, ingest_evolving, raw_stream, read_bronze
from vanewatch.streaming.state import upsert_keyed

RAW_COLUMNS = ["time_stamp", "asset_id", "id", "train_test", "status_type_id", *fv.SENSORS]
RAW_SCHEMA = (
    "time_stamp string, asset_id bigint, id bigint, train_test string, status_type_id int, "
    "sensor_1_avg double, sensor_2_avg double, sensor_3 double, sensor_4_avg double"
)
CLOCK_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
READ_BACK = ["farm", "asset_id", "id", "time_stamp", "status_type_id", "train_test", *fv.SENSORS]
READ_BACK_SQL = sql(f"SELECT {', '.join(READ_BACK)} FROM scada", "scada")


#: Folders that the readings of one farm are delivered in, unless one per turbine is asked for.
FOLDERS = 64


def land(df: DataFrame, root: str, per_turbine: bool = False) -> None:
    """Write rows as folders of CSV files per farm, each with the readings of some turbines.

    A file costs several milliseconds to make, find and open, however few rows it has, and the
    shared tables have as many turbines as users, with some dozen readings each. So turbines share a
    fixed number of folders, and files grow with the rows; ``per_turbine`` gives each its own, for
    what is read off the paths. The rebalance hint gathers a folder's rows but splits a folder with
    very many. Tasks move their own files into place: the driver would move folder by folder.
    """
    folder = F.col("asset_id") if per_turbine else F.pmod("asset_id", F.lit(FOLDERS))
    text = df.withColumn("time_stamp", F.date_format("time_stamp", CLOCK_FORMAT)).withColumn("turbine", folder)
    (
        text.hint("rebalance", "farm", "turbine")
        .write.mode("append")
        .partitionBy("farm", "turbine")
        .option("header", True)
        .option("mapreduce.fileoutputcommitter.algorithm.version", 2)
        .csv(root)
    )


def landed(spark: SparkSession, sf_dir: str, per_turbine: bool = False) -> str:
    root = work_path(spark, "landing")
    land(fv.scada(spark, sf_dir).select("farm", *RAW_COLUMNS), root, per_turbine)
    return root


def farm_scan(spark: SparkSession, root: str, schema=None) -> DataFrame:
    return cleaning.union_farms([files.scan_csv(spark, root, f, schema=schema) for f in FARMS])


def typed(df: DataFrame) -> DataFrame:
    return cleaning.with_utc_clock(df).select(*READ_BACK)


@query("bronze_batch", READ_BACK_SQL)
def bronze_batch(spark, sf_dir):
    return typed(farm_scan(spark, landed(spark, sf_dir)))


def ingest_farms(spark: SparkSession, root: str, out: str) -> DataFrame:
    """One run of each farm's ingest; the farms' tables read together."""
    schema = spark.createDataFrame([], RAW_SCHEMA).schema
    for farm in FARMS:
        ingest(raw_stream(spark, root, farm, schema), f"{out}/table-{farm}", f"{out}/checkpoint-{farm}")
    return cleaning.union_farms([tables.read_table(spark, f"{out}/table-{f}") for f in FARMS])


@query("bronze_stream", READ_BACK_SQL)
def bronze_stream(spark, sf_dir):
    return typed(ingest_farms(spark, landed(spark, sf_dir), work_path(spark, "bronze")))


@query("bronze_sink", sql("""
    SELECT farm, count(*) AS n_rows, count(DISTINCT asset_id) AS n_turbines,
      round(sum(sensor_1_avg), 4) AS total FROM scada GROUP BY farm""", "scada"))
def bronze_sink(spark, sf_dir):
    """Run to completion twice: the second run finds nothing new."""
    root, out = landed(spark, sf_dir), work_path(spark, "bronze")
    ingest_farms(spark, root, out)
    return ingest_farms(spark, root, out).groupBy("farm").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("asset_id").alias("n_turbines"),
        F.round(F.sum("sensor_1_avg"), 4).alias("total"),
    )


@query("stream_bronze", READ_BACK_SQL)
def stream_bronze(spark, sf_dir):
    """Files that land in two waves, picked up by two runs of the same query."""
    rows = fv.scada(spark, sf_dir).select("farm", *RAW_COLUMNS)
    root, out = work_path(spark, "landing"), work_path(spark, "bronze")
    land(rows.where("train_test = 'train'"), root)
    ingest_farms(spark, root, out)
    land(rows.where("train_test = 'prediction'"), root)
    return typed(ingest_farms(spark, root, out))


@query("stream_schema_evolution", sql("""
    SELECT farm, asset_id, id, time_stamp, status_type_id, sensor_1_avg,
      CASE WHEN train_test = 'prediction' THEN sensor_2_avg END AS sensor_2_avg,
      CASE WHEN train_test = 'prediction' THEN sensor_3 END AS sensor_3
    FROM scada""", "scada"))
def stream_schema_evolution(spark, sf_dir):
    """The second wave of files brings two columns the first did not have."""
    rows = fv.scada(spark, sf_dir)
    early = ["time_stamp", "asset_id", "id", "status_type_id", "sensor_1_avg"]
    late = ["time_stamp", "asset_id", "sensor_3", "id", "status_type_id", "sensor_1_avg", "sensor_2_avg"]
    root, out = work_path(spark, "landing"), work_path(spark, "bronze")
    for wave, columns in (("train", early), ("prediction", late)):
        land(rows.where(F.col("train_test") == wave).select("farm", *columns), root)
        for farm in FARMS:
            ingest_evolving(
                spark, root, farm, f"{out}/table", f"{out}/schema-{farm}", f"{out}/checkpoint-{farm}"
            )
    return cleaning.with_utc_clock(tables.read_table(spark, f"{out}/table", merge=True)).select(
        "farm", "asset_id", "id", "time_stamp", "status_type_id", "sensor_1_avg", "sensor_2_avg",
        F.col("sensor_3").cast("double").alias("sensor_3"),
    )


@query("stream_type_widening", sql("""
    SELECT farm, asset_id, id, time_stamp, CASE WHEN train_test = 'prediction' THEN sensor_1_avg ELSE floor(sensor_1_avg) END AS sensor_1_avg,
      CASE WHEN train_test = 'prediction' AND id % 50 = 0 THEN NULL ELSE status_type_id END AS status_type_id,
      CASE WHEN train_test = 'prediction' AND id % 50 = 0 THEN '{"status_type_id":"off"}' END AS rescued
    FROM scada""", "scada"))
def stream_type_widening(spark, sf_dir):
    """Whole numbers first, then fractions of the same sensor and some text among the states."""
    rows = fv.scada(spark, sf_dir)
    columns = ["time_stamp", "asset_id", "id", "status_type_id", "sensor_1_avg"]
    whole = {"sensor_1_avg": F.floor("sensor_1_avg")}
    text = {"status_type_id": F.when(F.col("id") % 50 == 0, "off").otherwise(F.col("status_type_id").cast("string"))}
    root, out = work_path(spark, "landing"), work_path(spark, "bronze")
    for wave, changed in (("train", whole), ("prediction", text)):
        land(rows.where(F.col("train_test") == wave).select("farm", *columns).withColumns(changed), root)
        for farm in FARMS:
            ingest_evolving(
                spark, root, farm, f"{out}/table-{farm}", f"{out}/schema-{farm}", f"{out}/checkpoint-{farm}"
            )
    found = cleaning.union_farms([read_bronze(spark, f"{out}/table-{f}", f"{out}/schema-{f}") for f in FARMS])
    return cleaning.with_utc_clock(found).select(
        "farm", "asset_id", "id", "time_stamp", F.col("sensor_1_avg").cast("double").alias("sensor_1_avg"),
        "status_type_id", F.col("_rescued").alias("rescued"),
    )


@query("ref_csv_scan", sql("SELECT sensor_name, description, unit FROM descriptions", "descriptions"))
def ref_csv_scan(spark, sf_dir):
    path = work_path(spark, "reference")
    tables.export_csv(fv.descriptions(spark, sf_dir), path)
    return files.scan_feature_description(spark, path)


@query("ingest_lineage", sql("""
    SELECT id, farm, farm AS path_farm, CAST(asset_id AS VARCHAR) AS path_turbine, true AS has_clock
    FROM scada""", "scada"))
def ingest_lineage(spark, sf_dir):
    raw = farm_scan(spark, landed(spark, sf_dir, per_turbine=True), RAW_SCHEMA)
    place = r"farm=([ABC])/turbine=([^/]+)/[^/]+\.csv$"
    return raw.select(
        "id", "farm",
        F.regexp_extract("_source_file", place, 1).alias("path_farm"),
        F.regexp_extract("_source_file", place, 2).alias("path_turbine"),
        F.col("_ingested_at").isNotNull().alias("has_clock"),
    )


@query("overwrite_sink", sql("""
    SELECT farm, event_id, category, event_start, event_end FROM faults""", "faults"))
def overwrite_sink(spark, sf_dir):
    """A second overwrite replaces rows and schema of the first."""
    path = work_path(spark, "faults")
    tables.overwrite(fv.event_info(spark, sf_dir), path, ["farm"])
    tables.overwrite(fv.faults(spark, sf_dir), path, ["farm"])
    return spark.read.parquet(path).select("farm", "event_id", "category", "event_start", "event_end")


@query("init_empty", sql("""
    SELECT 0 AS n_before, count(*) AS n_after FROM scada""", "scada"))
def init_empty(spark, sf_dir):
    path, rows = work_path(spark, "silver"), fv.scada(spark, sf_dir)
    tables.create_if_absent(rows, path)
    before = spark.read.parquet(path).count()
    rows.write.mode("append").parquet(path)
    tables.create_if_absent(rows, path)
    after = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_after"))
    return after.withColumn("n_before", F.lit(before))


def corrected(rows: DataFrame) -> DataFrame:
    """A later delivery that repeats the downtime readings with a corrected value."""
    return rows.where("status_type_id = 4").withColumn("sensor_1_avg", F.col("sensor_1_avg") + 1)


def delivered(rows: DataFrame, when: str) -> DataFrame:
    return rows.withColumn("_ingested_at", F.lit(when).cast("timestamp"))


@query("silver_upsert", sql("""
    SELECT farm, asset_id, id, time_stamp, event_id,
      CASE WHEN status_type_id = 4 THEN sensor_1_avg + 1 ELSE sensor_1_avg END AS sensor_1_avg
    FROM tagged""", "tagged"))
def silver_upsert(spark, sf_dir):
    """First load, a correction, and the same correction again."""
    path, rows = work_path(spark, "silver"), fv.tagged(spark, sf_dir)
    fix = corrected(rows)
    for when, batch in (("2024-02-01", rows), ("2024-02-02", fix), ("2024-02-02", fix)):
        tables.upsert(
            delivered(batch, when).withColumn("day", F.to_date("time_stamp")),
            path, ["farm", "asset_id", "time_stamp"], [F.col("_ingested_at").desc()], ["farm", "day"],
        )
    return spark.read.parquet(path).select(
        "farm", "asset_id", "id", "time_stamp", "event_id", "sensor_1_avg"
    )


@query("table_exists_guard", sql("""
    SELECT farm, event_id, category FROM faults""", "faults"))
def table_exists_guard(spark, sf_dir):
    """A missing table counts as an empty one."""
    path = work_path(spark, "faults")
    tables.overwrite(fv.faults(spark, sf_dir), f"{path}/present")
    found = [tables.read_table(spark, f"{path}/{p}", FAULT_EVENTS) for p in ("present", "absent")]
    return cleaning.union_farms(found).select("farm", "event_id", "category")


@query("serving_sync", sql("SELECT turbine_id, time, sensor, value, unit FROM readings", "readings"))
def serving_sync(spark, sf_dir):
    path = work_path(spark, "readings")
    tables.write_serving(fv.readings(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("pruned_scan", """
    SELECT user_id AS asset_id, event_type, count(*) AS n_rows FROM events GROUP BY ALL""")
def pruned_scan(spark, sf_dir):
    narrow = fv.table(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), "event_type")
    return narrow.groupBy("asset_id", "event_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("file_event_id", sql("""
    SELECT DISTINCT farm, _source_file, CAST(regexp_extract(_source_file, '[0-9]+') AS INTEGER) AS file_event_id
    FROM scada ORDER BY file_event_id""", "scada"))
def file_event_id(spark, sf_dir):
    named = fv.scada(spark, sf_dir).select("farm", "_source_file").distinct()
    return named.withColumn("file_event_id", files.file_event_id()).orderBy("file_event_id")


@query("per_file_rows", sql("""
    SELECT farm, count(*) AS n_files, sum(n) AS n_rows_total, round(sum(n) / count(*), 1) AS avg_rows_per_file
    FROM (SELECT farm, _source_file, count(*) AS n FROM scada GROUP BY ALL) GROUP BY farm""", "scada"))
def per_file_rows(spark, sf_dir):
    return quality.file_summary(fv.scada(spark, sf_dir))


@query("schema_consistency", sql("""
    SELECT farm, asset_id, CASE WHEN asset_id < 10 THEN 9 ELSE 8 END AS n_columns, asset_id < 10 AS consistent
    FROM (SELECT DISTINCT farm, asset_id FROM scada)""", "scada"))
def schema_consistency(spark, sf_dir):
    """Files of later assets lack a column."""
    rows, root = fv.scada(spark, sf_dir).select("farm", *RAW_COLUMNS), work_path(spark, "landing")
    land(rows.where("asset_id < 10"), root, per_turbine=True)
    land(rows.where("asset_id >= 10").drop("sensor_4_avg"), root, per_turbine=True)
    place = r"farm=([ABC])/(turbine=[^/]+)/"
    headers = files.header_columns(spark, f"{root}/farm=*/turbine=*/*.csv", "time_stamp").select(
        F.regexp_extract("_source_file", place, 1).alias("farm"),
        F.regexp_extract("_source_file", place, 2).alias("_source_file"),
        "columns",
    )
    return quality.header_consistency(headers.distinct()).select(
        "farm",
        F.regexp_extract("_source_file", r"(\d+)", 1).cast("bigint").alias("asset_id"),
        F.size("columns").alias("n_columns"),
        "consistent",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object keys in good and bad shapes, one per reading."""
    place = F.concat(F.lit("farm="), "farm", F.lit("/turbine="), "asset_id", F.lit("/part "), "id", F.lit(".csv"))
    s = F.col("status_type_id")
    key = (
        F.when(s == 0, F.replace(F.replace(place, F.lit("="), F.lit("%3D")), F.lit(" "), F.lit("+")))
        .when(s == 1, place)
        .when(s == 2, F.concat(F.lit("some-other-prefix/"), "id", F.lit(".csv")))
        .when(s == 4, F.concat(F.lit("farm=D/turbine="), "asset_id", F.lit("/"), "id", F.lit(".csv")))
    )
    return fv.scada(spark, sf_dir).select("id", F.lit("landing").alias("bucket"), key.alias("key"))


MANIFEST_SQL = """
    SELECT id, key, outcome, reason,
      CASE WHEN outcome = 'triggered' THEN regexp_extract(key, '^farm=([ABC])/', 1) END AS farm,
      CASE WHEN outcome = 'triggered' THEN regexp_extract(key, '^farm=[ABC]/turbine=([^/]+)/', 1) END AS turbine
    FROM (SELECT id, key,
        CASE WHEN key IS NULL THEN 'rejected'
          WHEN regexp_matches(key, '^farm=[ABC]/turbine=[^/]+/.+$') THEN 'triggered' ELSE 'skipped' END AS outcome,
        CASE WHEN key IS NULL THEN 'record is missing bucket name or object key'
          WHEN NOT regexp_matches(key, '^farm=[ABC]/turbine=[^/]+/.+$')
          THEN 'key does not match bronze prefix pattern' END AS reason
      FROM (SELECT id, CASE WHEN status_type_id IN (0, 1)
            THEN 'farm=' || farm || '/turbine=' || asset_id || '/part ' || id || '.csv'
          WHEN status_type_id = 2 THEN 'some-other-prefix/' || id || '.csv'
          WHEN status_type_id = 4 THEN 'farm=D/turbine=' || asset_id || '/' || id || '.csv' END AS key
        FROM scada))"""


@query("landing_router", sql(MANIFEST_SQL, "scada"))
def landing_router(spark, sf_dir):
    return landing.routed(manifest(spark, sf_dir)).drop("bucket")


@query("landing_stream", sql("""
    SELECT farm, CAST(asset_id AS VARCHAR) AS turbine, count(*) AS n_objects FROM scada
    WHERE status_type_id IN (0, 1) GROUP BY ALL""", "scada"))
def landing_stream(spark, sf_dir):
    """Manifests arrive as a stream; the result is what has to be reprocessed."""
    from vanewatch.streaming.ingest import route_landing

    path = work_path(spark, "manifest")
    source = manifest(spark, sf_dir)
    tables.overwrite(source, f"{path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{path}/in")
    route_landing(stream, f"{path}/out", f"{path}/checkpoint")
    return landing.affected(spark.read.parquet(f"{path}/out"))


@query("kpi_export", sql("""
    SELECT t.farm, n_turbines, n_files, n_anomaly, n_normal, n_categories FROM (
      SELECT s.farm, s.n_turbines, s.n_files, e.n_anomaly, e.n_normal, e.n_categories FROM
        (SELECT farm, count(DISTINCT asset_id) AS n_turbines, count(DISTINCT _source_file) AS n_files FROM scada GROUP BY farm) s
        JOIN (SELECT farm, count(*) FILTER (event_label = 'anomaly') AS n_anomaly,
          count(*) FILTER (event_label = 'normal') AS n_normal,
          count(DISTINCT category) FILTER (event_label = 'anomaly') AS n_categories
          FROM categorised GROUP BY farm) e ON s.farm = e.farm) t""", "scada", "categorised"))
def kpi_export(spark, sf_dir):
    """Nested records through a JSON export, flattened after reading them back."""
    rows, path = fv.scada(spark, sf_dir), work_path(spark, "report")
    events = faults.categorised(fv.event_info(spark, sf_dir), fv.FAULTS, fv.OTHER)
    per_farm = faults.anomalies(events).groupBy("farm", "category").agg(F.count(F.lit(1)).alias("n_events"))
    lead = kpi.lead_time_kpi(
        kpi.status_lead_time(rows, ["farm", "file_event_id"]),
        faults.anomalies(fv.file_events(spark, sf_dir)), ["farm", "file_event_id"],
    )
    report = kpi.fleet_report(kpi.fleet_totals(rows, events), per_farm, lead)
    tables.export_json(report, path)
    back = spark.read.schema(report.schema).json(path).where("farm IS NOT NULL")
    return back.select(
        "farm", "n_turbines", "n_files", "n_anomaly", "n_normal",
        F.size("anomaly_count_by_category").alias("n_categories"),
    )


@query("id_map_sink", sql("SELECT farm, asset_id, rank FROM ranks", "ranks"))
def id_map_sink(spark, sf_dir):
    """Each farm's ids replace only that farm's part of the map."""
    path, ranked = work_path(spark, "ids"), fv.ranks(spark, sf_dir)
    for farm in [*FARMS, FARMS[0]]:
        tables.overwrite_partitions(ranked.where(F.col("farm") == farm), path, ["farm"])
    return spark.read.parquet(path).select("farm", "asset_id", "rank")


ALERTS_SQL = """
    SELECT "turbineId" || '#' || component AS id, "turbineId", component,
      CASE WHEN "faultProbability" > 0.9 OR "rulHoursP50" < 24 THEN 'critical'
        WHEN "faultProbability" > 0.8 OR "rulHoursP50" < 48 THEN 'high' ELSE 'medium' END AS severity,
      predicted_at AS "createdAt", false AS acknowledged
    FROM (SELECT p.*, coalesce(c."faultProbabilityThreshold", 0.7) AS pt, coalesce(c."rulHoursP50Threshold", 72) AS rt
      FROM predictions p LEFT JOIN alert_config c ON p.component = c.component)
    WHERE "faultProbability" > pt OR "rulHoursP50" < rt
    QUALIFY row_number() OVER (PARTITION BY "turbineId", component ORDER BY predicted_at DESC) = 1"""
ALERT_COLUMNS = ["id", "turbineId", "component", "severity", "createdAt", "acknowledged"]


@query("keyed_latest_sink", sql(ALERTS_SQL, "predictions", "alert_config"))
def keyed_latest_sink(spark, sf_dir):
    """Two batches of alerts put by key; the later one replaces whole rows."""
    path, config = work_path(spark, "alerts"), fv.alert_config(spark, sf_dir)
    made = fv.predictions(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp")
    for batch in (made.where(F.col("predicted_at") < cut), made.where(F.col("predicted_at") >= cut)):
        upsert_keyed(evaluated(batch, config, "predicted_at"), path, ["id"], [F.col("createdAt").desc()])
    return active(spark.read.parquet(path)).select(*ALERT_COLUMNS)


@query("retention", sql("""
    SELECT turbine_id, time, sensor, value FROM readings
    WHERE time >= (SELECT max(time) FROM readings) - INTERVAL 7 DAY""", "readings"))
def retention(spark, sf_dir):
    return serving.within_retention(fv.readings(spark, sf_dir), 7).drop("unit")
