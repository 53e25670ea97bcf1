"""Taxonomies, alerts, landing keys, serving, key figures and data quality."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vanewatch.domain import REPORT_OTHER, REPORT_TAXONOMY
from vanewatch.functions import bands, labels
from vanewatch.functions.taxonomy import first_match, matches
from vanewatch.operators import alerting, extras, faults, joins, kpi, quality, sensors, serving
from vanewatch.sources.landing import affected, routed

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("text, gold, report, all_", [
    ("Generator bearing failure", "generator", "Generator", "Generator;Bearing"),
    ("Getriebe defekt", "other", "Gearbox", "Gearbox"),
    ("Main bearing damage", "bearing", "Bearing", "Bearing"),
    ("INVERTER tripped", "converter", REPORT_OTHER, ""),
    ("Axis 2 stuck", "other", "Pitch / blade angle", "Pitch / blade angle"),
    ("gear box oil and hydraulic pump", "gearbox", "Gearbox", "Gearbox;Hydraulics"),
    ("", "other", REPORT_OTHER, ""),
    (None, "other", REPORT_OTHER, ""),
])
def test_categories(spark, text, gold, report, all_):
    df = spark.createDataFrame([(text,)], "t string").select(
        faults.fault_category(F.col("t")).alias("gold"),
        first_match(F.col("t"), REPORT_TAXONOMY, REPORT_OTHER).alias("report"),
        F.concat_ws(";", matches(F.col("t"), REPORT_TAXONOMY)).alias("all"),
    )
    assert tuple(df.first()) == (gold, report, all_)


def test_whole_word_mode(spark):
    df = spark.createDataFrame([("gearing",), ("a gear broke",)], "t string")
    out = df.select(first_match(F.col("t"), {"g": ["gear"]}, "-", whole_words=True).alias("c")).collect()
    assert [r.c for r in out] == ["-", "g"]


def test_normal_events_have_no_category(spark):
    df = spark.createDataFrame([("A", "1", "normal", "gear", T0, at(1440))], "farm string, event_id string, event_label string, event_description string, event_start timestamp, event_end timestamp")
    r = faults.categorised(df).first()
    assert (r.category, r.matched_categories, r.duration_days) == ("Normal (n/a)", "", 1.0)


def predictions(spark, *rows):
    return spark.createDataFrame([("A-1", "gearbox", p, r, T0) for p, r in rows], "turbineId string, component string, faultProbability double, rulHoursP50 double, predicted_at timestamp")


NO_CONFIG = "component string, faultProbabilityThreshold double, rulHoursP50Threshold double"


@pytest.mark.parametrize("p, rul, severity", [
    (0.95, 200.0, "critical"), (0.1, 500.0, None), (0.7, 72.0, None), (0.85, 200.0, "high"),
    (0.75, 200.0, "medium"), (0.1, 47.0, "high"), (0.1, 23.0, "critical"), (0.1, 60.0, "medium"),
])
def test_alert_rule(spark, p, rul, severity):
    out = alerting.evaluated(predictions(spark, (p, rul)), spark.createDataFrame([], NO_CONFIG), "predicted_at").collect()
    assert [r.severity for r in out] == ([severity] if severity else [])
    if out:
        assert out[0].id == "A-1#gearbox" and not out[0].acknowledged
        assert out[0].message == f"gearbox on A-1: faultProbability={p:.2f}, rulHoursP50={rul:.1f}"


def test_thresholds_fall_back_field_by_field(spark):
    config = spark.createDataFrame([("gearbox", None, 10.0)], NO_CONFIG)
    r = alerting.with_thresholds(predictions(spark, (0.5, 50.0)), config).first()
    assert (r.faultProbabilityThreshold, r.rulHoursP50Threshold) == (0.7, 10.0)


def test_invalid_predictions_are_set_aside(spark):
    payloads = spark.createDataFrame([
        ('{"turbineId":"A-1","component":"g","faultProbability":0.5,"rulHoursP50":10}',), ('{"component":"g","faultProbability":0.5,"rulHoursP50":10}',),
        ('{"turbineId":"A-1","component":"","faultProbability":0.5,"rulHoursP50":10}',), ('{"turbineId":"A-1","component":"g","faultProbability":"NaN","rulHoursP50":10}',),
        ("not json",),
    ], "payload string")
    reasons = [r.reason for r in alerting.parsed_predictions(payloads).collect()]
    assert reasons[0] is None and reasons[1] == reasons[4] == "turbineId is required"
    assert reasons[2] == "component is required" and reasons[3] == "faultProbability must be a number"


def test_landing_keys(spark):
    keys = ["farm=A/turbine=T001/2026-01-01.csv", "some-other-prefix/file.csv", "farm%3DA/turbine%3DT001/a+b.csv", None, ""]
    out = routed(spark.createDataFrame([("b", k) for k in keys], "bucket string, key string")).collect()
    assert [r.outcome for r in out] == ["triggered", "skipped", "triggered", "rejected", "rejected"]
    assert out[2].key == "farm=A/turbine=T001/a b.csv"
    again = routed(spark.createDataFrame([("b", k) for k in keys], "bucket string, key string"))
    assert [tuple(r) for r in affected(again).collect()] == [("A", "T001", 2)]


def test_ranks_and_display_ids(spark):
    df = spark.createDataFrame([("A", 21), ("A", 3), ("A", 10), ("B", 5)], "farm string, asset_id bigint")
    ranks = serving.turbine_ranks(df)
    assert {(r.farm, r.asset_id): r["rank"] for r in ranks.collect()} == {("A", 3): 1, ("A", 10): 2, ("A", 21): 3, ("B", 5): 1}
    ids = spark.createDataFrame([("A-3",), ("A-x",), ("A3",), ("A-3-1",)], "t string").select(labels.display_farm("t"), labels.display_rank("t"))
    assert [tuple(r) for r in ids.collect()] == [("A", 3), (None, None), (None, None), (None, None)]


def test_unpivot_drops_missing_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, None, 3), (2, float("nan"), 2.0, None)], "id int, s1_avg double, s2_avg double, count int")
    out = serving.unpivoted(df, ["id"], ["s1_avg", "s2_avg", "count"]).collect()
    assert sorted(tuple(r) for r in out) == [(1, "count", 3.0), (1, "s1", 1.0), (2, "s2", 2.0)]


def readings(spark, values):
    return spark.createDataFrame([("A-1", at(i), "s", v, None) for i, v in enumerate(values)], "turbine_id string, time timestamp, sensor string, value double, unit string")


def test_telemetry_includes_both_ends(spark):
    r = readings(spark, [1.0, 2.0, 3.0])
    one = serving.telemetry(r, "A-1", F.lit(at(1)), F.lit(at(1))).collect()
    assert [(x.value, x.unit) for x in one] == [(2.0, "")]
    assert serving.telemetry(r, "A-1", F.lit(at(50)), F.lit(at(60))).isEmpty()
    requests = spark.createDataFrame([("q", "A-1", at(1), at(2)), ("none", "A-9", at(0), at(2))], "request_id string, turbine_id string, from_time timestamp, to_time timestamp")
    for limit in (0, 1 << 20):
        assert sorted(x.value for x in serving.telemetry_many(r, requests, limit).collect()) == [2.0, 3.0]


@pytest.mark.parametrize("latest, colour", [(24.0, "red"), (18.0, "amber"), (16.0, "green"), (12.0, "green"), (-20.0, "green")])
def test_snapshot_colours(spark, latest, colour):
    r = readings(spark, [10.0, latest])
    turbines = spark.createDataFrame([("A-1",), ("A-2",)], "turbine_id string")
    out = {x.turbine_id: x.health for x in serving.health_snapshot(r, {"Gearbox": "s"}, turbines).collect()}
    assert out == {"A-1": colour, "A-2": "green"}


def test_snapshot_either_way(spark):
    turbines = spark.createDataFrame([("A-1",)], "turbine_id string")
    out = serving.health_snapshot(readings(spark, [10.0, -20.0]), {"Gearbox": "s"}, turbines, either_way=True)
    assert out.first().health == "red"


def test_wide_and_long_are_inverse(spark):
    r = readings(spark, [1.0, 2.0]).unionByName(readings(spark, [5.0]).withColumn("sensor", F.lit("t")))
    wide = serving.wide_by_time(r, ["s", "t"])
    back = serving.unpivoted(wide, ["turbine_id", "time"], ["s", "t"])
    assert back.exceptAll(r.select(back.columns)).isEmpty() and back.count() == 3


def test_rul_band(spark):
    df = spark.createDataFrame([(40.0, 120.0, 300.0, [(T0, 0.6)])], "p10 double, p50 double, p90 double, s array<struct<timestamp:timestamp,value:double>>")
    b = df.select(bands.rul_band("s", "p10", "p50", "p90").alias("b")).first().b[0]
    assert (b.low, b.high) == (0.0, 72.6)


def lead(spark, statuses):
    df = spark.createDataFrame([("A", 1, at(10 * i), i, s) for i, s in enumerate(statuses)], "farm string, file_event_id int, time_stamp timestamp, id int, status_type_id int")
    both = [[r.lead_hours for r in kpi.status_lead_time(df, ["farm", "file_event_id"], n).collect()] for n in (0, 1 << 20)]
    assert both[0] == both[1]
    return both[0]


def test_lead_times(spark):
    assert [round(x, 3) for x in lead(spark, [0, 1, 1, 4])] == [0.333]
    assert [round(x, 3) for x in lead(spark, [1, 2, 4, 0, 1, 4])] == [0.333]
    for statuses in ([0, 4], [4, 1], [0, 1, 2], [1, 1, 0, 4]):
        assert lead(spark, statuses) == []


def test_missing_buckets(spark):
    df = spark.range(2000).select(
        F.lit("A").alias("farm"), F.lit(1).alias("full"), F.when(F.col("id") >= 100, 1).alias("five"), F.when(F.col("id") >= 101, 1).alias("more"))
    out = quality.missingness(df, ["full", "five", "more"]).withColumn("b", quality.missing_bucket("n_missing", "n_rows"))
    assert {r.column_name: r.b for r in out.collect()} == {"full": "always", "five": "mostly", "more": "sparse"}


def test_sensor_columns(spark):
    table = spark.createDataFrame([], "farm string, asset_id int, time_stamp timestamp, a_avg double, a double, b double, c_std double")
    wanted = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c")], "component string, sensor_name string")
    resolved = sensors.resolved_columns(wanted, table)
    assert sensors.column_list(resolved) == ["a_avg", "b"]


def test_representative_sensors(spark):
    table = spark.createDataFrame([], "s1_avg double, s2_avg double, s3_avg double, s4_avg double, s5 double")
    d = spark.createDataFrame([("s1", "gear speed"), ("s2", "gear oil temperature"), ("s3", "Gear oil"), ("s4", "gear a"), ("s5", "gear oil pressure level"), ("s6", "gear oil temperature level")], "sensor_name string, description string")
    out = sensors.representative_sensors(d, table, {"Gearbox": ["gear"]}).orderBy("position").collect()
    assert [(r.sensor_name, r.score) for r in out] == [("s5", 4), ("s2", 3), ("s3", 2)]


def test_constant_runs_join_over_midnight(spark):
    values = [(1430, 5.0), (1435, 5.0), (1445, 5.0), (1450, 6.0), (1455, 6.0), (2900, 6.0), (2910, 7.0)]
    df = spark.createDataFrame([("A", at(m), i, v) for i, (m, v) in enumerate(values)], "farm string, time_stamp timestamp, id int, v double")
    out = extras.constant_runs(df, ["farm"], "v", 2).collect()
    assert sorted((r.v, r.n_rows) for r in out) == [(5.0, 3), (6.0, 3)]


def test_acknowledging(spark):
    alerts = alerting.evaluated(predictions(spark, (0.95, 10.0)), spark.createDataFrame([], NO_CONFIG), "predicted_at")
    done = alerting.acknowledged(alerts, spark.createDataFrame([("A-1#gearbox",), ("other",)], "id string"))
    assert done.count() == 1 and alerting.active(done).isEmpty()


def test_telemetry_tells_when_it_was_cut(spark):
    r = spark.createDataFrame([("A-1", at(h), "s", float(h), None) for h in range(4)], "turbine_id string, time timestamp, sensor string, value double, unit string")
    read = lambda n: [(x.value, x.truncated) for x in serving.telemetry(r, "A-1", F.lit(at(0)), F.lit(at(9)), n).collect()]
    assert read(3) == [(0.0, True), (1.0, True), (2.0, True)]
    assert read(4) == [(float(h), False) for h in range(4)]


def test_ranks_of_ids_with_long_characters_follow_bytes(spark):
    ids = ["zz", "\u00e9a", "a\U0001f600", "\uffe6b", "\U0001f600c", "b"]
    rows = spark.createDataFrame([("A", i) for i in ids], "farm string, asset_id string")
    got = {x.asset_id: x["rank"] for x in serving.turbine_ranks(rows).collect()}
    want = sorted(ids, key=lambda i: (len(i), i.encode()))
    assert got == {i: n for n, i in enumerate(want, 1)}


def test_types_of_cells(spark):
    cells = {
        "int": ["1", "-2", " 3 "], "float": ["1", "2.5", "NaN", None], "datetime": ["2024-01-01", "2024-01-01 10:00:00"],
        "str": ["1", "2024-01-01"], "none": [None, None], "hole": ["1", None], "word": ["infinite", "nano"],
    }
    for name, values in cells.items():
        df = spark.createDataFrame([("A", v) for v in values], "farm string, c string")
        got = quality.observed_types(df, ["c"], ["farm"]).first()["actual"]
        assert got == {"none": "float", "hole": "float", "word": "str"}.get(name, name), name


def test_null_keys_survive_a_salted_join(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("b", 4)], "k string, id int")
    side = spark.createDataFrame([("a", 7), (None, 9)], "k string, v int")
    out = joins.attach(rows, side, ["k"], ["id"], broadcast_bytes=0)
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, None), (2, 7), (3, None), (4, None)]
