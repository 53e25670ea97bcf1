"""Queries over rows: cleaning, tagging, rolling features, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanewatch.functions import clock, labels
from vanewatch.operators import cleaning, faults, profiling, rolling, rul, sensors, serving, tagging
from vanewatch.plans import fleet_view as fv
from vanewatch.plans.fleet_view import sql
from vanewatch.plans.q_ingest import corrected, delivered
from vanewatch.plans.registry import query

CLOCK_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


FEATURE_COLUMNS = [
    f"{s}_{a}_{h}h" for h in (1, 6, 24) for s in fv.FEATURED for a in ("avg", "std")
]
FEATURE_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLUMNS)


@query("rolling_features", sql(
    f"SELECT farm, asset_id, time_stamp, status_type_id, event_id, event_label, {FEATURE_SQL} FROM features",
    "features"))
def rolling_features(spark, sf_dir):
    return rounded(fv.features(spark, sf_dir), FEATURE_COLUMNS)


@query("rolling_std", sql("""
    SELECT farm, asset_id, time_stamp, id,
      round(stddev_samp(sensor_4_avg) OVER (w RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW), 6) AS sensor_4_avg_std_6h
    FROM (SELECT *, CAST(floor(epoch(time_stamp)) AS BIGINT) AS sec FROM scada)
    WINDOW w AS (PARTITION BY farm, asset_id ORDER BY sec)""", "scada"))
def rolling_std(spark, sf_dir):
    keep = ["farm", "asset_id", "time_stamp", "id"]
    f = rolling.rolling_features(fv.scada(spark, sf_dir), ["sensor_4_avg"], keep, [6])
    return rounded(f.select(*keep, "sensor_4_avg_std_6h"), ["sensor_4_avg_std_6h"])


@query("rolling_features_long", sql("""
    SELECT farm, asset_id, time_stamp, sensor,
      round(avg(value) OVER (w RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 6) AS value_avg_1h,
      round(stddev_samp(value) OVER (w RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 6) AS value_std_1h,
      round(avg(value) OVER (w RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 6) AS value_avg_24h,
      round(stddev_samp(value) OVER (w RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 6) AS value_std_24h
    FROM (SELECT *, CAST(floor(epoch(time_stamp)) AS BIGINT) AS sec FROM long_rows)
    WINDOW w AS (PARTITION BY farm, asset_id, sensor ORDER BY sec)""", "long_rows"))
def rolling_features_long(spark, sf_dir):
    long = serving.unpivoted(fv.scada(spark, sf_dir), ["farm", "asset_id", "time_stamp"], fv.SENSORS)
    f = rolling.rolling_features_long(long, [1, 24])
    return rounded(f, ["value_avg_1h", "value_std_1h", "value_avg_24h", "value_std_24h"])


@query("utc_normalise", sql("""
    SELECT id, CASE WHEN status_type_id <> 3 THEN time_stamp - INTERVAL 1 HOUR END AS time_stamp
    FROM scada""", "scada"))
def utc_normalise(spark, sf_dir):
    """Winter clocks of a zone one hour ahead; some readings carry unreadable text."""
    text = F.when(F.col("status_type_id") == 3, "bad").otherwise(F.date_format("time_stamp", CLOCK_FORMAT))
    raw = fv.scada(spark, sf_dir).select("id", text.alias("time_stamp"))
    return cleaning.with_utc_clock(raw, "Europe/Berlin")


@query("status_domain", sql("""
    SELECT id, CASE status_type_id WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 4 END AS status_type_id FROM scada
    WHERE status_type_id IN (0, 1, 4)""", "scada"))
def status_domain(spark, sf_dir):
    s = F.col("status_type_id")
    text = F.when(s == 0, "0").when(s == 1, "5").when(s == 2, "7").when(s == 3, "x").otherwise("4")
    return cleaning.with_valid_status(fv.scada(spark, sf_dir).select("id", text.alias("status_type_id")))


@query("not_null_keys", sql("""
    SELECT id, time_stamp, asset_id FROM scada WHERE status_type_id NOT IN (2, 3)""", "scada"))
def not_null_keys(spark, sf_dir):
    s = F.col("status_type_id")
    raw = fv.scada(spark, sf_dir).select(
        "id", F.when(s != 2, F.col("time_stamp")).alias("time_stamp"),
        F.when(s != 3, F.col("asset_id")).alias("asset_id"),
    )
    return cleaning.with_keys(raw)


@query("swap_time_col", sql("SELECT id, farm, time_stamp FROM scada", "scada"))
def swap_time_col(spark, sf_dir):
    raw = fv.scada(spark, sf_dir).select(
        "id", "farm", F.date_format("time_stamp", CLOCK_FORMAT).alias("time_stamp")
    )
    return cleaning.with_utc_clock(raw)


@query("dedup_latest", sql("""
    SELECT farm, asset_id, time_stamp,
      CASE WHEN status_type_id = 4 THEN sensor_1_avg + 1 ELSE sensor_1_avg END AS sensor_1_avg FROM scada""", "scada"))
def dedup_latest(spark, sf_dir):
    rows = fv.scada(spark, sf_dir)
    twice = delivered(rows, "2024-02-01").unionByName(delivered(corrected(rows), "2024-02-02"))
    return cleaning.newest_reading(twice).select("farm", "asset_id", "time_stamp", "sensor_1_avg")


@query("anomaly_filter", sql("""
    SELECT farm, asset_id, event_id, event_start, event_end, event_description FROM event_info
    WHERE event_label = 'anomaly'""", "event_info"))
def anomaly_filter(spark, sf_dir):
    return faults.anomalies(fv.event_info(spark, sf_dir)).drop("event_label", "file_event_id")


@query("prediction_window", sql("""
    SELECT asset_id, time_stamp, sensor_1_avg FROM scada WHERE train_test = 'prediction'""", "scada"))
def prediction_window(spark, sf_dir):
    return fv.scada(spark, sf_dir).where("train_test = 'prediction'").select(
        "asset_id", "time_stamp", "sensor_1_avg"
    )


@query("event_tag", sql("""
    SELECT id, farm, asset_id, time_stamp, event_id, event_label, event_description FROM tagged""", "tagged"))
def event_tag(spark, sf_dir):
    return fv.tagged(spark, sf_dir).select(
        "id", "farm", "asset_id", "time_stamp", "event_id", "event_label", "event_description"
    )


@query("event_tag_farm", sql("""
    SELECT s.id, s.farm, e.event_id, e.event_label
    FROM scada s LEFT JOIN event_info e ON s.farm = e.farm AND s.time_stamp BETWEEN e.event_start AND e.event_end
    QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY e.event_start, e.event_id) = 1""", "scada", "event_info"))
def event_tag_farm(spark, sf_dir):
    """Event tables without an asset column: any window of the farm."""
    rows = fv.scada(spark, sf_dir).select("id", "farm", "asset_id", "time_stamp")
    out = tagging.tag_events(rows, fv.event_info(spark, sf_dir), by=["farm"])
    return out.select("id", "farm", "event_id", "event_label")


@query("event_asset_lookup", sql("""
    SELECT farm, event_id, category, event_start, event_end, event_description, asset_id FROM faults""", "faults"))
def event_asset_lookup(spark, sf_dir):
    return fv.faults(spark, sf_dir)


@query("distinct_event_assets", sql("""
    SELECT DISTINCT farm, event_id, asset_id FROM tagged WHERE event_id IS NOT NULL""", "tagged"))
def distinct_event_assets(spark, sf_dir):
    return faults.event_assets(fv.tagged(spark, sf_dir))


@query("non_event_rows", sql("""
    SELECT farm, count(*) AS n_rows, count(*) FILTER (event_id IS NULL) AS n_quiet FROM tagged GROUP BY farm""", "tagged"))
def non_event_rows(spark, sf_dir):
    quiet = F.count_if(F.col("event_id").isNull())
    return fv.tagged(spark, sf_dir).groupBy("farm").agg(F.count(F.lit(1)).alias("n_rows"), quiet.alias("n_quiet"))


RUL_SQL = "SELECT farm, asset_id, time_stamp, event_id, round(hours_to_failure, 6) AS hours_to_failure FROM rul"


@query("nearest_next_event", sql(RUL_SQL, "rul"))
def nearest_next_event(spark, sf_dir):
    out = rul.rul_labels(fv.tagged(spark, sf_dir), fv.stored_faults(spark, sf_dir))
    return rounded(out, ["hours_to_failure"])


@query("pre_event_candidates", sql("""
    SELECT s.id, s.farm, s.asset_id, s.time_stamp FROM scada s WHERE EXISTS (SELECT 1 FROM event_info e
      WHERE e.farm = s.farm AND e.asset_id = s.asset_id AND s.time_stamp < e.event_start
      AND CAST(floor(epoch(e.event_start)) AS BIGINT) - CAST(floor(epoch(s.time_stamp)) AS BIGINT) <= 72 * 3600)""", "event_info"))
def pre_event_candidates(spark, sf_dir):
    """Rows in the three days before any event of their asset, each once."""
    rows = fv.scada(spark, sf_dir).select("id", "farm", "asset_id", "time_stamp")
    return rul.next_failure(rows, fv.event_info(spark, sf_dir), 72).select("id", "farm", "asset_id", "time_stamp")


@query("nearest_event", sql("""
    SELECT s.id, e.event_id AS next_event_id FROM scada s JOIN event_info e
      ON s.farm = e.farm AND s.asset_id = e.asset_id AND s.time_stamp < e.event_start
      AND CAST(floor(epoch(e.event_start)) AS BIGINT) - CAST(floor(epoch(s.time_stamp)) AS BIGINT) <= 720 * 3600
    QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY e.event_start, e.event_id) = 1""", "event_info"))
def nearest_event(spark, sf_dir):
    """Every row's next event of either label."""
    rows = fv.scada(spark, sf_dir).select("id", "farm", "asset_id", "time_stamp")
    return rul.next_failure(rows, fv.event_info(spark, sf_dir)).select("id", "next_event_id")


@query("rul_horizon", sql("""
    SELECT t.id, round(min((CAST(floor(epoch(f.event_start)) AS BIGINT) - CAST(floor(epoch(t.time_stamp)) AS BIGINT)) / 3600.0::DOUBLE), 6)
      AS hours_to_failure
    FROM tagged t JOIN faults f ON t.farm = f.farm AND t.asset_id = f.asset_id AND t.time_stamp < f.event_start
      AND CAST(floor(epoch(f.event_start)) AS BIGINT) - CAST(floor(epoch(t.time_stamp)) AS BIGINT) <= 48 * 3600
    WHERE t.event_id IS NULL GROUP BY t.id""", "tagged", "faults"))
def rul_horizon(spark, sf_dir):
    quiet = fv.tagged(spark, sf_dir).where("event_id IS NULL").select("id", "farm", "asset_id", "time_stamp")
    out = rul.next_failure(quiet, fv.stored_faults(spark, sf_dir), 48)
    return rounded(out.select("id", "hours_to_failure"), ["hours_to_failure"])


@query("hours_to_failure", sql("""
    SELECT event_id, round((CAST(floor(epoch(event_end)) AS BIGINT) - CAST(floor(epoch(event_start)) AS BIGINT)) / 3600.0::DOUBLE, 6) AS event_hours
    FROM event_info""", "event_info"))
def hours_to_failure(spark, sf_dir):
    hours = F.round(clock.hours_between("event_start", "event_end"), 6)
    return fv.event_info(spark, sf_dir).select("event_id", hours.alias("event_hours"))


@query("label_join", sql("""
    SELECT t.id, coalesce(c.category, 'healthy') AS label, round(t.sensor_1_avg_avg_24h, 6) AS sensor_1_avg_avg_24h
    FROM features t LEFT JOIN (SELECT DISTINCT farm, event_id, category FROM faults) c
      ON t.farm = c.farm AND t.event_id = c.event_id""", "features", "faults"))
def label_join(spark, sf_dir):
    keep = ["farm", "asset_id", "time_stamp", "event_id", "id"]
    f = rolling.rolling_features(fv.tagged(spark, sf_dir), fv.FEATURED, keep)
    out = faults.labelled_features(f, fv.stored_faults(spark, sf_dir))
    return rounded(out.select("id", "label", "sensor_1_avg_avg_24h"), ["sensor_1_avg_avg_24h"])


@query("rul_join", sql("""
    SELECT f.farm, f.asset_id, f.time_stamp, round(r.hours_to_failure, 6) AS hours_to_failure,
      round(f.sensor_1_avg_avg_24h, 6) AS sensor_1_avg_avg_24h
    FROM features f JOIN rul r ON f.farm = r.farm AND f.asset_id = r.asset_id AND f.time_stamp = r.time_stamp""",
    "features", "rul"))
def rul_join(spark, sf_dir):
    out = rul.labelled_features(fv.features(spark, sf_dir), fv.stored_faults(spark, sf_dir)).select(
        "farm", "asset_id", "time_stamp", "hours_to_failure", "sensor_1_avg_avg_24h"
    )
    return rounded(out, ["hours_to_failure", "sensor_1_avg_avg_24h"])


@query("union_strict", sql("""
    SELECT farm, event_id, event_label FROM event_info""", "event_info"))
def union_strict(spark, sf_dir):
    e = fv.event_info(spark, sf_dir).select("farm", "event_id", "event_label")
    parts = [e.where(F.col("farm") == f) for f in ("A", "B", "C")]
    return cleaning.union_farms(parts, evolving=False)


@query("union_evolving", sql("""
    SELECT id, farm, CASE WHEN farm <> 'B' THEN sensor_1_avg END AS sensor_1_avg,
      CASE WHEN farm <> 'A' THEN sensor_2_avg END AS sensor_2_avg,
      CASE WHEN farm = 'C' THEN sensor_3 END AS sensor_3 FROM scada""", "scada"))
def union_evolving(spark, sf_dir):
    s = fv.scada(spark, sf_dir)
    columns = {"A": ["sensor_1_avg"], "B": ["sensor_2_avg"], "C": ["sensor_1_avg", "sensor_2_avg", "sensor_3"]}
    return cleaning.union_farms([s.where(F.col("farm") == f).select("id", "farm", *c) for f, c in columns.items()])


@query("stride_sample", sql("""
    SELECT farm, id, _source_file FROM scada QUALIFY (row_number() OVER (PARTITION BY farm, _source_file ORDER BY id) - 1)
      % CASE farm WHEN 'C' THEN 8 ELSE 3 END = 0""", "scada"))
def stride_sample(spark, sf_dir):
    """The report's sampling: every third row of a file, every eighth on the large farm."""
    from vanewatch.domain import SAMPLE_STRIDE

    rows = fv.scada(spark, sf_dir).select("farm", "id", "_source_file")
    return profiling.sampled(rows, SAMPLE_STRIDE)


@query("stride_index", sql("""
    SELECT id, _source_file, row_number() OVER (PARTITION BY _source_file ORDER BY id) - 1 AS row_index FROM scada""", "scada"))
def stride_index(spark, sf_dir):
    from vanewatch.operators.ranking import numbered

    rows = fv.scada(spark, sf_dir).select("id", "_source_file")
    bucket = F.floor(F.col("id") / F.lit(100_000))
    out = numbered(rows, ["_source_file"], bucket, ["id"], "_row")
    return out.select("id", "_source_file", (F.col("_row") - 1).alias("row_index"))


COMPONENT_VALUES = ", ".join(f"('{c}', '{w}')" for c, ws in fv.COMPONENTS.items() for w in ws)
FOUND_SQL = f"""
    SELECT DISTINCT k.component, d.sensor_name, d.description FROM descriptions d
    JOIN (VALUES {COMPONENT_VALUES}) k(component, word) ON contains(lower(d.description), k.word)"""
COLUMN_VALUES = ", ".join(f"('{c}', '{c.removesuffix('_avg')}')" for c in fv.SENSORS)
RESOLVED_SQL = f"""
    SELECT f.component, f.sensor_name, f.description, c.column_name FROM ({FOUND_SQL}) f
    JOIN (VALUES {COLUMN_VALUES}) c(column_name, sensor_name) ON f.sensor_name = c.sensor_name"""


@query("component_sensors", sql(f"SELECT component, sensor_name FROM ({FOUND_SQL})", "descriptions"))
def component_sensors(spark, sf_dir):
    return sensors.component_sensors(fv.descriptions(spark, sf_dir), fv.COMPONENTS)


@query("distinct_sensors", sql("""
    SELECT count(DISTINCT sensor_name) AS n_sensors FROM descriptions WHERE contains(lower(description), 'gear')""", "descriptions"))
def distinct_sensors(spark, sf_dir):
    gear = sensors.component_sensors(fv.descriptions(spark, sf_dir), {"gearbox": fv.COMPONENTS["gearbox"]})
    return gear.select("sensor_name").distinct().agg(F.count(F.lit(1)).alias("n_sensors"))


@query("resolve_columns", sql(f"SELECT component, sensor_name, column_name FROM ({RESOLVED_SQL})", "descriptions"))
def resolve_columns(spark, sf_dir):
    wanted = sensors.component_sensors(fv.descriptions(spark, sf_dir), fv.COMPONENTS)
    return sensors.resolved_columns(wanted, fv.table_columns(spark, sf_dir))


@query("sensor_set_union", sql(f"SELECT DISTINCT column_name FROM ({RESOLVED_SQL})", "descriptions"))
def sensor_set_union(spark, sf_dir):
    wanted = sensors.component_sensors(fv.descriptions(spark, sf_dir), fv.COMPONENTS)
    return sensors.resolved_columns(wanted, fv.table_columns(spark, sf_dir)).select("column_name").distinct()


@query("dynamic_projection", sql(f"""
    SELECT r.component, l.id, l.sensor, l.value FROM long_rows l
    JOIN ({RESOLVED_SQL}) r ON l.sensor = r.sensor_name""", "descriptions", "long_rows"))
def dynamic_projection(spark, sf_dir):
    """Each component's columns, resolved from the descriptions, as its own projection."""
    rows = fv.scada(spark, sf_dir)
    wanted = sensors.component_sensors(fv.descriptions(spark, sf_dir), fv.COMPONENTS)
    resolved = sensors.resolved_columns(wanted, fv.table_columns(spark, sf_dir))
    by_component: dict[str, list[str]] = {}
    for r in resolved.select("component", "column_name").distinct().collect():
        by_component.setdefault(r["component"], []).append(r["column_name"])
    frames = [
        serving.unpivoted(rows.select("id", *columns), ["id"], sorted(columns)).withColumn("component", F.lit(c))
        for c, columns in sorted(by_component.items())
    ]
    return cleaning.union_farms(frames)


@query("suffix_select", sql("""
    SELECT farm, asset_id, time_stamp, round(sensor_1_avg_avg_24h, 6) AS sensor_1_avg_avg_24h,
      round(sensor_2_avg_avg_24h, 6) AS sensor_2_avg_avg_24h FROM features""", "features"))
def suffix_select(spark, sf_dir):
    f = fv.features(spark, sf_dir)
    columns = sensors.day_average_columns(f)
    return rounded(f.select("farm", "asset_id", "time_stamp", *columns), columns)


BONUS_SQL = " + ".join(f"contains(lower(d.description), '{w}')::INT" for w in fv.BONUS)


@query("representative_sensors", sql(f"""
    SELECT category, sensor_name, score, position FROM (
      SELECT component AS category, sensor_name, 1 + {BONUS_SQL.replace('d.', '')} AS score,
        row_number() OVER (PARTITION BY component ORDER BY 1 + {BONUS_SQL.replace('d.', '')} DESC, sensor_name) AS position
      FROM ({FOUND_SQL})) WHERE position <= 3""", "descriptions"))
def representative_sensors(spark, sf_dir):
    """Here every described sensor counts as present, so the ranking runs over all of them."""
    d = fv.descriptions(spark, sf_dir)
    return sensors.ranked_sensors(sensors.scored_sensors(d, fv.COMPONENTS, fv.BONUS)).select(
        "category", "sensor_name", "score", "position"
    )


@query("bonus_score", sql(f"SELECT sensor_name, 1 + {BONUS_SQL} AS score FROM descriptions d", "descriptions"))
def bonus_score(spark, sf_dir):
    from vanewatch.functions.taxonomy import bonus_score as score

    return fv.descriptions(spark, sf_dir).select("sensor_name", score(F.col("description"), fv.BONUS).alias("score"))


@query("sensor_metadata_join", sql("""
    SELECT l.sensor, d.description, d.unit, count(*) AS n_rows, round(avg(l.value), 6) AS mean_value
    FROM long_rows l JOIN descriptions d ON l.sensor = d.sensor_name GROUP BY ALL""", "long_rows", "descriptions"))
def sensor_metadata_join(spark, sf_dir):
    long = serving.unpivoted(fv.scada(spark, sf_dir), [], fv.SENSORS)
    stats = long.groupBy("sensor").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value"))
    return stats.join(fv.descriptions(spark, sf_dir), F.col("sensor") == F.col("sensor_name")).drop("sensor_name")


@query("turbine_rank", sql("SELECT farm, asset_id, rank FROM ranks", "ranks"))
def turbine_rank(spark, sf_dir):
    return fv.ranks(spark, sf_dir)


@query("distinct_assets", sql("SELECT DISTINCT farm, asset_id FROM scada", "scada"))
def distinct_assets(spark, sf_dir):
    return fv.scada(spark, sf_dir).select("farm", "asset_id").distinct()


@query("display_id_join", sql("""
    SELECT s.id, s.farm || '-' || CASE WHEN s.farm = 'C' THEN s.asset_id ELSE r.rank END AS turbine_id
    FROM scada s JOIN ranks r ON s.farm = r.farm AND s.asset_id = r.asset_id""", "ranks"))
def display_id_join(spark, sf_dir):
    """Farm C has no map yet and falls back to raw ids."""
    from vanewatch.operators.joins import attach

    known = fv.ranks(spark, sf_dir).where("farm <> 'C'")
    rows = attach(fv.scada(spark, sf_dir).select("id", "farm", "asset_id"), known, ["farm", "asset_id"], ["id"])
    return rows.select("id", labels.display_id("farm", "rank", "asset_id").alias("turbine_id"))


@query("parse_display_id", sql("""
    SELECT id, CASE WHEN status_type_id IN (0, 1) THEN farm END AS farm,
      CASE WHEN status_type_id IN (0, 1) THEN asset_id END AS rank FROM scada""", "scada"))
def parse_display_id(spark, sf_dir):
    s = F.col("status_type_id")
    text = F.when(s.isin(0, 1), F.concat_ws("-", "farm", "asset_id")).when(
        s == 2, F.concat("farm", "asset_id")).otherwise(F.concat_ws("-", "farm", F.lit("x")))
    rows = fv.scada(spark, sf_dir).select("id", text.alias("t"))
    return rows.select("id", labels.display_farm("t").alias("farm"), labels.display_rank("t").alias("rank"))


@query("status_label", sql("""
    SELECT id, CASE status_type_id WHEN 0 THEN 'normal operation' WHEN 1 THEN 'derated' WHEN 2 THEN 'idling (normal)'
      WHEN 3 THEN 'service' ELSE 'downtime (fault)' END AS label FROM scada""", "scada"))
def status_label(spark, sf_dir):
    return fv.scada(spark, sf_dir).select("id", labels.status_label("status_type_id").alias("label"))


@query("strip_suffix", sql("SELECT sensor, count(*) AS n_rows FROM long_rows GROUP BY sensor", "long_rows"))
def strip_suffix(spark, sf_dir):
    long = serving.unpivoted(fv.scada(spark, sf_dir), [], fv.SENSORS)
    return long.groupBy("sensor").agg(F.count(F.lit(1)).alias("n_rows"))


@query("iso_timestamp", sql("""
    SELECT id, strftime(time_stamp, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM scada""", "scada"))
def iso_timestamp(spark, sf_dir):
    return fv.scada(spark, sf_dir).select("id", clock.iso_utc("time_stamp").alias("iso"))


@query("day_trunc", sql("""
    SELECT farm, date_trunc('day', time_stamp)::TIMESTAMP AS day, count(*) AS n_rows FROM scada GROUP BY ALL""", "scada"))
def day_trunc(spark, sf_dir):
    return fv.scada(spark, sf_dir).groupBy("farm", clock.day_of("time_stamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"))
