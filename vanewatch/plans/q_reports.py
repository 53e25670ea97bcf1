"""Queries behind reports: data quality, events, profiles and key figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanewatch.functions import clock
from vanewatch.functions.taxonomy import matches
from vanewatch.operators import faults, kpi, profiling, quality, tagging
from vanewatch.plans import fleet_view as fv
from vanewatch.plans.fleet_view import sql
from vanewatch.plans.q_rows import rounded
from vanewatch.plans.registry import query
from vanewatch.sources import tables
from vanewatch.session import work_path

PROFILED = ["time_stamp", "asset_id", "id", "train_test", "status_type_id", *fv.SENSORS]
MISSING_SQL = """
    SELECT farm, column_name, n_rows, n_rows - n_filled AS n_missing,
      round((n_rows - n_filled) / n_rows::DOUBLE * 100, 4) AS pct_missing
    FROM (SELECT farm, column_name, any_value(n_rows) AS n_rows, any_value(n_filled) AS n_filled FROM (
      """ + " UNION ALL ".join(
    f"SELECT farm, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_filled FROM scada GROUP BY farm"
    for c in PROFILED
) + ") GROUP BY ALL)"
BUCKET_SQL = "CASE WHEN n_missing = 0 THEN 'always' WHEN n_missing / n_rows::DOUBLE * 100 <= 5 THEN 'mostly' ELSE 'sparse' END"


@query("missingness", sql(MISSING_SQL, "scada"))
def missingness(spark, sf_dir):
    return quality.missingness(fv.scada(spark, sf_dir), PROFILED)


@query("missingness_buckets", sql(
    f"SELECT farm, {BUCKET_SQL} AS bucket, count(*) AS n_columns FROM ({MISSING_SQL}) GROUP BY ALL", "scada"))
def missingness_buckets(spark, sf_dir):
    return quality.missing_buckets(quality.missingness(fv.scada(spark, sf_dir), PROFILED))


@query("top_sparse_columns", sql(f"""
    SELECT farm, column_name, n_rows, n_missing, pct_missing FROM ({MISSING_SQL}) WHERE {BUCKET_SQL} = 'sparse'
    ORDER BY pct_missing DESC, farm, column_name LIMIT 8""", "scada"))
def top_sparse_columns(spark, sf_dir):
    return quality.sparsest(quality.missingness(fv.scada(spark, sf_dir), PROFILED), n=8)


STATUS_SQL = """
    SELECT farm, status_type_id, n_rows, round(n_rows / sum(n_rows) OVER (PARTITION BY farm)::DOUBLE * 100, 3) AS pct,
      CASE status_type_id WHEN 0 THEN 'normal operation' WHEN 1 THEN 'derated' WHEN 2 THEN 'idling (normal)'
        WHEN 3 THEN 'service' WHEN 4 THEN 'downtime (fault)' END AS label
    FROM (SELECT farm, status_type_id, count(*) AS n_rows FROM scada GROUP BY ALL)"""


@query("status_distribution", sql(STATUS_SQL, "scada"))
def status_distribution(spark, sf_dir):
    return quality.status_distribution(fv.scada(spark, sf_dir))


@query("share_of_total", sql("""
    SELECT farm, _source_file, n_rows, round(n_rows / sum(n_rows) OVER (PARTITION BY farm)::DOUBLE * 100, 3) AS pct
    FROM (SELECT farm, _source_file, count(*) AS n_rows FROM scada GROUP BY ALL)""", "scada"))
def share_of_total(spark, sf_dir):
    return quality.with_share(quality.rows_per_file(fv.scada(spark, sf_dir)))


@query("train_test_distribution", sql("""
    SELECT farm, train_test, n_rows, round(n_rows / sum(n_rows) OVER (PARTITION BY farm)::DOUBLE * 100, 3) AS pct
    FROM (SELECT farm, train_test, count(*) AS n_rows FROM scada GROUP BY ALL)""", "scada"))
def train_test_distribution(spark, sf_dir):
    return quality.split_distribution(fv.scada(spark, sf_dir))


@query("status_out_of_range", sql("""
    SELECT farm, _source_file, CAST(sensor_2_avg AS INTEGER) AS status_type_id, count(*) AS n_rows FROM scada
    WHERE sensor_2_avg NOT IN (0, 1, 2, 3, 4, 5) GROUP BY ALL""", "scada"))
def status_out_of_range(spark, sf_dir):
    """Codes instead of statuses, so nearly every file has illegal values."""
    coded = fv.scada(spark, sf_dir).withColumn("status_type_id", F.col("sensor_2_avg").cast("int"))
    return quality.illegal_status(coded)


def as_text(spark, sf_dir):
    """Readings the way a file holds them, with flaws in the files of farm B."""
    s = fv.scada(spark, sf_dir)
    flawed = F.col("farm") == "B"
    return s.select(
        "farm", "_source_file",
        F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss").alias("time_stamp"),
        F.when(~flawed | (F.col("status_type_id") != 0), F.col("asset_id").cast("string")).alias("asset_id"),
        F.when(flawed, F.concat(F.col("id"), F.lit(".5"))).otherwise(F.col("id").cast("string")).alias("id"),
        "train_test",
        F.when(flawed & (F.col("sensor_1_avg") > 250), "down").otherwise(F.col("status_type_id").cast("string")).alias("status_type_id"),
        F.col("sensor_4_avg").cast("string").alias("sensor_4_avg"),
    )


@query("dtype_sanity", sql("""
    SELECT farm, column_name, actual, expected, actual = expected AS ok FROM (
      SELECT f.farm, c.column_name, c.expected, CASE WHEN f.farm <> 'B' THEN c.expected ELSE c.flawed END AS actual
      FROM (SELECT DISTINCT farm FROM scada) f CROSS JOIN (VALUES ('time_stamp', 'datetime', 'datetime'),
        ('asset_id', 'int', 'float'), ('id', 'int', 'float'), ('train_test', 'str', 'str'),
        ('status_type_id', 'int', 'str')) c(column_name, expected, flawed))""", "scada"))
def dtype_sanity(spark, sf_dir):
    return quality.type_check(as_text(spark, sf_dir))


@query("first_n_mismatch", sql("""
    SELECT farm, _source_file, actual, first_type FROM (
      SELECT *, first_value(actual) OVER (PARTITION BY farm ORDER BY file_event_id) AS first_type FROM (
        SELECT farm, _source_file, file_event_id, CASE WHEN count(*) FILTER (farm = 'B' AND sensor_1_avg > 250) > 0
          THEN 'str' ELSE 'int' END AS actual FROM scada GROUP BY ALL))
    WHERE actual <> first_type ORDER BY farm, file_event_id LIMIT 50""", "scada"))
def first_n_mismatch(spark, sf_dir):
    """The report's first fifty files whose status type differs from the first file's."""
    return quality.type_drift(as_text(spark, sf_dir), ["status_type_id"], n=50).select(
        "farm", "_source_file", "actual", "first_type"
    )


def categorised(spark, sf_dir):
    return faults.categorised(fv.event_info(spark, sf_dir), fv.FAULTS, fv.OTHER)


CATEGORISED_SQL = """
    SELECT farm, event_id, event_label, round(duration_days, 6) AS duration_days, category, matched_categories
    FROM (SELECT *, CASE WHEN event_label = 'anomaly' THEN concat_ws(';',
        CASE WHEN contains(lower(event_description), 'gear') THEN 'gearbox' END,
        CASE WHEN contains(lower(event_description), 'rod') OR contains(lower(event_description), 'bolt') THEN 'hydraulic' END,
        CASE WHEN contains(lower(event_description), 'plate') THEN 'pitch' END,
        CASE WHEN contains(lower(event_description), 'ring') THEN 'bearing' END) ELSE '' END AS matched_categories
      FROM categorised)"""


@query("eda_category", sql(CATEGORISED_SQL, "categorised"))
def eda_category(spark, sf_dir):
    out = categorised(spark, sf_dir).select(
        "farm", "event_id", "event_label", "duration_days", "category", "matched_categories"
    )
    return rounded(out, ["duration_days"])


@query("fault_category", """
    SELECT p_partkey, p_name, CASE WHEN contains(lower(p_name), 'gear') THEN 'gearbox'
      WHEN contains(lower(p_name), 'rod') OR contains(lower(p_name), 'bolt') THEN 'hydraulic'
      WHEN contains(lower(p_name), 'plate') THEN 'pitch' WHEN contains(lower(p_name), 'ring') THEN 'bearing'
      ELSE 'other' END AS category FROM part""")
def fault_category(spark, sf_dir):
    return fv.table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", faults.fault_category(F.col("p_name"), fv.FAULTS, fv.OTHER).alias("category")
    )


@query("fault_category_texts", """
    SELECT doc_id, CASE
      WHEN regexp_matches(lower(text), 'gearbox|gear box') THEN 'gearbox'
      WHEN contains(lower(text), 'hydraulic') THEN 'hydraulic' WHEN contains(lower(text), 'pitch') THEN 'pitch'
      WHEN contains(lower(text), 'generator') THEN 'generator' WHEN contains(lower(text), 'transformer') THEN 'transformer'
      WHEN regexp_matches(lower(text), 'converter|inverter') THEN 'converter' WHEN contains(lower(text), 'yaw') THEN 'yaw'
      WHEN regexp_matches(lower(text), 'plc|communication') THEN 'plc_communication'
      WHEN contains(lower(text), 'brake') THEN 'rotor_brake'
      WHEN regexp_matches(lower(text), 'bearing|lager') THEN 'bearing' ELSE 'other' END AS category FROM documents""")
def fault_category_texts(spark, sf_dir):
    """The training taxonomy over whole free texts."""
    docs = fv.table(spark, sf_dir, "documents")
    return docs.select("doc_id", faults.fault_category(F.col("text")).alias("category"))


@query("matched_categories", """
    SELECT p_partkey, concat_ws(';', CASE WHEN contains(d, 'gear') THEN 'gearbox' END,
      CASE WHEN contains(d, 'rod') OR contains(d, 'bolt') THEN 'hydraulic' END,
      CASE WHEN contains(d, 'plate') THEN 'pitch' END, CASE WHEN contains(d, 'ring') THEN 'bearing' END) AS matched
    FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS d FROM part)""")
def matched_categories(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type")
    return fv.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(";", matches(text, fv.FAULTS)).alias("matched")
    )


@query("duration_days", sql("SELECT event_id, round(duration_days, 6) AS duration_days FROM categorised", "categorised"))
def duration_days(spark, sf_dir):
    return rounded(categorised(spark, sf_dir).select("event_id", "duration_days"), ["duration_days"])


@query("events_by_farm_label", sql("""
    SELECT farm, count(*) FILTER (event_label = 'anomaly') AS anomaly, count(*) FILTER (event_label = 'normal') AS normal
    FROM event_info GROUP BY farm""", "event_info"))
def events_by_farm_label(spark, sf_dir):
    return faults.label_counts(fv.event_info(spark, sf_dir))


ORDER_VALUES = ", ".join(f"('{c}', {i + 1})" for i, c in enumerate([*fv.FAULTS, fv.OTHER]))
COUNTS_SQL = f"""
    SELECT c.category, c.n_events, o.position FROM (SELECT category, count(*) AS n_events FROM categorised
      WHERE event_label = 'anomaly' GROUP BY category) c
    JOIN (VALUES {ORDER_VALUES}) o(category, position) ON c.category = o.category ORDER BY o.position"""


@query("fault_category_counts", sql(COUNTS_SQL, "categorised"))
def fault_category_counts(spark, sf_dir):
    return faults.category_counts(categorised(spark, sf_dir), fv.FAULTS, fv.OTHER)


@query("category_order", sql(f"SELECT category, position FROM ({COUNTS_SQL}) ORDER BY position", "categorised"))
def category_order(spark, sf_dir):
    return faults.category_counts(categorised(spark, sf_dir), fv.FAULTS, fv.OTHER).select("category", "position")


@query("named_categories", sql("""
    SELECT DISTINCT category FROM categorised WHERE event_label = 'anomaly' AND category <> 'other'""", "categorised"))
def named_categories(spark, sf_dir):
    found = faults.anomalies(categorised(spark, sf_dir)).select("category").distinct()
    return found.where(F.col("category") != fv.OTHER)


@query("category_set", sql("SELECT DISTINCT category FROM categorised WHERE event_label = 'anomaly'", "categorised"))
def category_set(spark, sf_dir):
    return faults.anomalies(categorised(spark, sf_dir)).select("category").distinct()


@query("fault_category_by_farm", sql("""
    SELECT category, count(*) FILTER (farm = 'A') AS "A", count(*) FILTER (farm = 'B') AS "B", count(*) FILTER (farm = 'C') AS "C"
    FROM categorised WHERE event_label = 'anomaly' GROUP BY category""", "categorised"))
def fault_category_by_farm(spark, sf_dir):
    return faults.category_by_farm(categorised(spark, sf_dir), ["A", "B", "C"])


@query("null_coercion", sql("""
    SELECT c.category, f.farm, count(e.event_id) AS n_events FROM (SELECT DISTINCT category FROM categorised) c
    CROSS JOIN (VALUES ('A'), ('B'), ('C')) f(farm) LEFT JOIN categorised e ON e.category = c.category AND e.farm = f.farm
    GROUP BY ALL""", "categorised"))
def null_coercion(spark, sf_dir):
    """Absent combinations count zero."""
    counts = categorised(spark, sf_dir).groupBy("category").pivot("farm", ["A", "B", "C"]).agg(F.count(F.lit(1)))
    return counts.na.fill(0).unpivot(["category"], ["A", "B", "C"], "farm", "n_events")


@query("top_fault_category", sql("""
    SELECT (SELECT category FROM c ORDER BY n DESC, first_seen LIMIT 1) AS top_category,
      (SELECT category FROM c WHERE category <> 'other' ORDER BY n DESC, first_seen LIMIT 1) AS top_named_category
    FROM (SELECT 1) """.replace("FROM c", "FROM (SELECT category, count(*) AS n, min(CAST(event_id AS BIGINT)) AS first_seen FROM categorised WHERE event_label = 'anomaly' GROUP BY category) c"),
    "categorised"))
def top_fault_category(spark, sf_dir):
    return faults.top_categories(categorised(spark, sf_dir), fv.OTHER)


@query("events_timeline", sql("""
    SELECT farm, event_id, event_start, event_end, row_number() OVER (PARTITION BY farm ORDER BY event_start, event_id) - 1 AS position
    FROM event_info ORDER BY farm, position""", "event_info"))
def events_timeline(spark, sf_dir):
    return faults.timeline(fv.event_info(spark, sf_dir)).select(
        "farm", "event_id", "event_start", "event_end", "position"
    ).orderBy("farm", "position")


@query("turbine_count", sql("SELECT farm, count(DISTINCT asset_id) AS n_turbines FROM scada GROUP BY farm", "scada"))
def turbine_count(spark, sf_dir):
    return kpi.turbine_counts(fv.scada(spark, sf_dir))


LEAD_SQL = """
    SELECT farm, file_event_id, onset_time, down_time,
      (epoch_us(down_time) - epoch_us(onset_time)) / 3600000000.0::DOUBLE AS lead_hours FROM (
      SELECT d.farm, d.file_event_id, d.down_time, min(s.time_stamp) AS onset_time FROM (
        SELECT r.farm, r.file_event_id, x.down_rn, x.down_time, coalesce(max(r.rn) FILTER (
          r.rn < x.down_rn AND r.status_type_id NOT IN (1, 2)), 0) AS barrier
        FROM (SELECT *, row_number() OVER (PARTITION BY farm, file_event_id ORDER BY time_stamp, id) AS rn FROM scada) r
        JOIN (SELECT farm, file_event_id, min(rn) AS down_rn, arg_min(time_stamp, rn) AS down_time FROM (
          SELECT *, row_number() OVER (PARTITION BY farm, file_event_id ORDER BY time_stamp, id) AS rn FROM scada)
          WHERE status_type_id = 4 GROUP BY ALL) x ON r.farm = x.farm AND r.file_event_id = x.file_event_id
        GROUP BY ALL) d
      JOIN (SELECT *, row_number() OVER (PARTITION BY farm, file_event_id ORDER BY time_stamp, id) AS rn FROM scada) s
        ON s.farm = d.farm AND s.file_event_id = d.file_event_id AND s.rn > d.barrier AND s.rn < d.down_rn
      GROUP BY ALL) WHERE down_time > onset_time"""
FILE = ["farm", "file_event_id"]


@query("status_lead_time", sql(f"""
    SELECT farm, file_event_id, onset_time, down_time, round(lead_hours, 6) AS lead_hours FROM ({LEAD_SQL})""", "scada"))
def status_lead_time(spark, sf_dir):
    return rounded(kpi.status_lead_time(fv.scada(spark, sf_dir), FILE), ["lead_hours"])


@query("lead_time_kpi", sql(f"""
    SELECT e.farm, count(l.lead_hours) AS n_computable, count(*) AS n_anomalies, round(avg(l.lead_hours), 2) AS avg_hours,
      count(l.lead_hours) || '/' || count(*) AS coverage
    FROM file_events e LEFT JOIN ({LEAD_SQL}) l ON e.farm = l.farm AND e.file_event_id = l.file_event_id
    WHERE e.event_label = 'anomaly' GROUP BY ROLLUP (e.farm)""", "scada", "file_events"))
def lead_time_kpi(spark, sf_dir):
    lead = kpi.status_lead_time(fv.scada(spark, sf_dir), FILE)
    return kpi.lead_time_kpi(lead, faults.anomalies(fv.file_events(spark, sf_dir)), FILE)


@query("fleet_totals", sql("""
    SELECT farm, sum(n_turbines) AS n_turbines, sum(n_files) AS n_files, sum(n_anomaly) AS n_anomaly, sum(n_normal) AS n_normal
    FROM (SELECT s.farm, count(DISTINCT asset_id) AS n_turbines, count(DISTINCT _source_file) AS n_files,
      (SELECT count(*) FROM event_info e WHERE e.farm = s.farm AND event_label = 'anomaly') AS n_anomaly,
      (SELECT count(*) FROM event_info e WHERE e.farm = s.farm AND event_label = 'normal') AS n_normal
      FROM scada s GROUP BY s.farm) GROUP BY ROLLUP (farm)""", "scada", "event_info"))
def fleet_totals(spark, sf_dir):
    return kpi.fleet_totals(fv.scada(spark, sf_dir), fv.event_info(spark, sf_dir))


@query("sensor_histogram", sql("""
    SELECT farm, sensor, bin, count(*) AS n_rows, any_value(low) AS low, any_value(high) AS high FROM (
      SELECT l.farm, l.sensor, b.low, b.high,
        CAST(least(CASE WHEN b.high > b.low THEN floor((l.value - b.low) / ((b.high - b.low) / 40)) ELSE 0 END, 39) AS INTEGER) AS bin
      FROM long_rows l JOIN (SELECT farm, sensor, min(value) AS low, max(value) AS high FROM long_rows GROUP BY ALL) b
        ON l.farm = b.farm AND l.sensor = b.sensor) GROUP BY farm, sensor, bin""", "long_rows"))
def sensor_histogram(spark, sf_dir):
    return profiling.histogram(fv.scada(spark, sf_dir), fv.SENSORS)


PAIRS = [(a, b) for i, a in enumerate(fv.SENSORS) for b in fv.SENSORS[i + 1:]]


@query("sensor_correlation", sql(" UNION ALL ".join(
    f"SELECT farm, '{a}' AS sensor_a, '{b}' AS sensor_b, round(corr({a}, {b}), 6) AS corr FROM scada GROUP BY farm"
    for a, b in PAIRS), "scada"))
def sensor_correlation(spark, sf_dir):
    return rounded(profiling.correlation(fv.scada(spark, sf_dir), fv.SENSORS), ["corr"])


@query("prediction_rows_per_event", sql("""
    SELECT e.farm, e.event_id, count(s.id) FILTER (s.train_test = 'prediction') AS n_prediction
    FROM file_events e LEFT JOIN scada s ON s.farm = e.farm AND s.file_event_id = e.file_event_id GROUP BY ALL""", "file_events"))
def prediction_rows_per_event(spark, sf_dir):
    return profiling.prediction_rows(fv.scada(spark, sf_dir), fv.file_events(spark, sf_dir)).select(
        "farm", "event_id", "n_prediction"
    )


BEST_SQL = """
    SELECT farm, slot, event_id, n_prediction FROM (
      SELECT c.farm, CASE WHEN c.event_label = 'anomaly' THEN c.category ELSE 'baseline' END AS slot, c.event_id, n.n_prediction
      FROM categorised c JOIN (
        SELECT e.farm, e.event_id, count(*) AS n_prediction FROM file_events e
        JOIN scada s ON s.farm = e.farm AND s.file_event_id = e.file_event_id AND s.train_test = 'prediction' GROUP BY ALL) n
      ON c.farm = n.farm AND c.event_id = n.event_id)
    QUALIFY row_number() OVER (PARTITION BY farm, slot ORDER BY n_prediction DESC, CAST(event_id AS BIGINT)) = 1"""


def best(spark, sf_dir):
    events = faults.categorised(fv.file_events(spark, sf_dir), fv.FAULTS, fv.OTHER)
    return profiling.best_events(profiling.prediction_rows(fv.scada(spark, sf_dir), events))


@query("best_event", sql(BEST_SQL, "categorised", "file_events"))
def best_event(spark, sf_dir):
    return best(spark, sf_dir)


REL_SQL = "(epoch_us(s.time_stamp) - epoch_us(e.event_start)) / 86400000000.0::DOUBLE"


@query("event_window_rows", sql(f"""
    SELECT s.id, e.event_id, round({REL_SQL}, 6) AS rel_days FROM file_events e
    JOIN scada s ON s.farm = e.farm AND s.file_event_id = e.file_event_id""", "file_events"))
def event_window_rows(spark, sf_dir):
    out = tagging.event_file_rows(fv.scada(spark, sf_dir), fv.file_events(spark, sf_dir).drop("asset_id"))
    return rounded(out.select("id", "event_id", "rel_days"), ["rel_days"])


@query("relative_days", sql(f"""
    SELECT e.event_id, s.id, round({REL_SQL}, 6) AS rel_days FROM file_events e
    JOIN scada s ON s.farm = e.farm AND s.file_event_id = e.file_event_id AND s.train_test = 'prediction'""", "file_events"))
def relative_days(spark, sf_dir):
    rows = fv.scada(spark, sf_dir).where("train_test = 'prediction'")
    out = tagging.event_file_rows(rows, fv.file_events(spark, sf_dir).drop("asset_id"))
    return rounded(out.select("event_id", "id", "rel_days"), ["rel_days"])


@query("event_replay", sql(f"""
    SELECT e.event_id, s.id, s.time_stamp, s.status_type_id, round({REL_SQL}, 6) AS rel_days FROM file_events e
    JOIN scada s ON s.farm = e.farm AND s.file_event_id = e.file_event_id
    WHERE e.event_label = 'anomaly' AND {REL_SQL} BETWEEN -7 AND 0 ORDER BY e.event_id, s.time_stamp""", "file_events"))
def event_replay(spark, sf_dir):
    """The week before each anomaly, in order."""
    events = faults.anomalies(fv.file_events(spark, sf_dir)).drop("asset_id")
    out = tagging.event_file_rows(fv.scada(spark, sf_dir), events).where("rel_days BETWEEN -7 AND 0")
    return rounded(
        out.select("event_id", "id", "time_stamp", "status_type_id", "rel_days"), ["rel_days"]
    ).orderBy("event_id", "time_stamp")


@query("fault_span_days", sql("""
    SELECT event_id, round((epoch_us(event_end) - epoch_us(event_start)) / 86400000000.0::DOUBLE, 6) AS span_days
    FROM file_events WHERE event_label = 'anomaly'""", "file_events"))
def fault_span_days(spark, sf_dir):
    e = faults.anomalies(fv.file_events(spark, sf_dir))
    return e.select("event_id", F.round(clock.days_between("event_start", "event_end"), 6).alias("span_days"))


CURVE_SQL = f"""
    SELECT b.farm, b.slot, b.event_id, l.sensor,
      CAST(floor((epoch_us(l.time_stamp) - epoch_us(e.event_start)) / 86400000000.0::DOUBLE * 4) AS BIGINT) AS cell, avg(l.value) AS value
    FROM ({BEST_SQL}) b JOIN file_events e ON b.farm = e.farm AND b.event_id = e.event_id
    JOIN long_rows l ON l.farm = e.farm AND l.file_event_id = e.file_event_id AND l.train_test = 'prediction'
    WHERE l.sensor IN ('sensor_1', 'sensor_2') GROUP BY ALL"""


@query("baseline_overlay", sql(f"""
    SELECT g.farm, g.slot, g.event_id, g.sensor, g.cell, round(a.value, 6) AS anomaly_value, round(n.value, 6) AS baseline_value
    FROM (SELECT farm, slot, event_id, sensor, cell FROM ({CURVE_SQL}) WHERE slot <> 'baseline'
      UNION SELECT n.farm, s.slot, s.event_id, n.sensor, n.cell FROM ({CURVE_SQL}) n
        JOIN ({BEST_SQL}) s ON s.farm = n.farm AND s.slot <> 'baseline' WHERE n.slot = 'baseline') g
    LEFT JOIN ({CURVE_SQL}) a ON a.farm = g.farm AND a.slot = g.slot AND a.event_id = g.event_id AND a.sensor = g.sensor AND a.cell = g.cell
    LEFT JOIN ({CURVE_SQL}) n ON n.slot = 'baseline' AND n.farm = g.farm AND n.sensor = g.sensor AND n.cell = g.cell""",
    "categorised", "file_events", "long_rows"))
def baseline_overlay(spark, sf_dir):
    """Six-hour cells here; the data is much sparser than ten-minute readings."""
    rows = fv.scada(spark, sf_dir).where("train_test = 'prediction'")
    windows = tagging.event_file_rows(rows, fv.file_events(spark, sf_dir).drop("asset_id"))
    out = profiling.degradation_curves(windows, best(spark, sf_dir), fv.FEATURED, per_day=4)
    return rounded(out, ["anomaly_value", "baseline_value"])


@query("events_csv_export", sql(CATEGORISED_SQL, "categorised"))
def events_csv_export(spark, sf_dir):
    """The categorised event table through its CSV export."""
    path = work_path(spark, "events")
    columns = ["farm", "event_id", "event_label", "duration_days", "category", "matched_categories"]
    tables.export_csv(rounded(categorised(spark, sf_dir).select(*columns), ["duration_days"]), path)
    schema = "farm string, event_id string, event_label string, duration_days double, category string, matched_categories string"
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.na.fill("", ["matched_categories"])
