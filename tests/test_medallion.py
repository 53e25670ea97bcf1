"""The jobs from landed files to alerts on a small made fleet."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vanewatch.plans import medallion as m

T0 = datetime(2024, 1, 1)
FAULT = T0 + timedelta(days=20)


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def reading(i, asset):
    t = T0 + timedelta(hours=2 * i)
    wear = max(0.0, 10.0 - abs((FAULT - t).total_seconds()) / 86400) if asset == 1 else 0.0
    status = 4 if asset == 1 and FAULT <= t <= FAULT + timedelta(days=1) else 0
    split = "prediction" if i >= 200 else "train"
    return f"{t},{asset},{i},{split},{status},{50 + wear + (i * 7 % 5)},{i * 13 % 11}"


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    header = "time_stamp,asset_id,id,train_test,status_type_id,sensor_1_avg,sensor_2"
    for farm in ("A", "B"):
        for asset in (1, 2):
            rows = [reading(i, asset) for i in range(300)]
            write(root / "land" / f"farm={farm}" / f"turbine={asset}" / f"comma_{asset}.csv", [header, *rows])
        write(root / "land" / f"farm={farm}" / "event_info" / "e.csv", [
            "event_id,event_label,event_start,event_start_id,event_end,event_end_id,event_description",
            f"1,anomaly,{FAULT},0,{FAULT + timedelta(days=2)},0,Gearbox failure",
        ])
        write(root / "land" / "feature_description" / f"farm={farm}" / "f.csv", [
            "sensor_name,description,unit", "sensor_1,Gear oil temperature,C", "sensor_2,Hydraulic level,%"])
    f = m.Fleet(spark, str(root / "land"), str(root / "lake"), farms=["A", "B", "C"], tag_by=("farm", "file_event_id"))
    f.components = {k: f.components[k] for k in ("gearbox", "hydraulics", "pitch")}
    m.run(f, F.lit("2024-02-01").cast("timestamp"), rounds=2, depth=2, min_days=20)
    return f


def test_silver_and_features(fleet):
    silver = fleet.read("silver", "A")
    assert silver.count() == 600
    assert silver.where("event_id = '1'").select("asset_id").distinct().collect()[0][0] == 1
    gear = fleet.read("features", "gearbox")
    assert gear.count() == 1200 and "sensor_1_avg_std_24h" in gear.columns
    assert "sensor_2_avg_1h" in fleet.read("features", "hydraulics").columns
    assert fleet.read("features", "pitch") is None


def test_faults_and_labels(fleet):
    faults = fleet.read("fault_events").collect()
    assert {(r.farm, r.event_id, r.category, r.asset_id) for r in faults} == {("A", "1", "gearbox", 1), ("B", "1", "gearbox", 1)}
    labels = fleet.read("rul_labels")
    assert labels.count() == 2 * 240
    assert labels.agg(F.max("hours_to_failure")).first()[0] == 480.0


def test_serving_scores_and_alerts(fleet):
    readings = fleet.read("sensor_readings")
    assert {r.turbine_id for r in readings.select("turbine_id").distinct().collect()} == {"A-1", "A-2", "B-1", "B-2"}
    assert readings.count() == 4 * 100 * 2
    predictions = fleet.read("predictions").collect()
    assert len(predictions) == 8
    assert all(p.rulHoursP10 <= p.rulHoursP50 <= p.rulHoursP90 for p in predictions)
    assert all(len(p.forecastSeries) == 14 for p in predictions)
    metrics = {r.metric for r in fleet.read("training_report").collect()}
    assert {"macro_f1", "pinball_loss_p50", "mean_fit_rmse"} <= metrics
    alerts = fleet.read("alerts")
    assert alerts is None or alerts.count() == alerts.select("id").distinct().count()


def test_late_file_refreshes_only_its_days(fleet, spark):
    late = T0 + timedelta(days=10, hours=1)
    write(__import__("pathlib").Path(fleet.landing) / "farm=A" / "turbine=2" / "late_2.csv", [
        "time_stamp,asset_id,id,train_test,status_type_id,sensor_1_avg,sensor_2", f"{late},2,999,train,0,1000.0,1"])
    m.bronze(fleet, "A")
    m.silver(fleet, "A")
    assert fleet.read("silver", "A").count() == 601
    changed = fleet.read("silver", "A").where("id = 999").select("farm", "asset_id", "time_stamp")
    m.refresh_features(fleet, "gearbox", "A", changed)
    partial = fleet.read("features", "gearbox").where("farm = 'A'")
    kept = partial.select(sorted(partial.columns)).collect()
    m.features(fleet, "gearbox")
    full = fleet.read("features", "gearbox").where("farm = 'A'")
    key = lambda r: (r.asset_id, r.time_stamp)
    assert sorted(kept, key=key) == sorted(full.select(sorted(full.columns)).collect(), key=key)
