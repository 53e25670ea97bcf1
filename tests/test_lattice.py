"""Types joined over files, rescued values, and rows tagged again."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanewatch.sources import tables
from vanewatch.streaming import ingest, lattice

VOID, INT, LONG, DOUBLE = lattice.NUMBERS


@pytest.mark.parametrize(("known", "seen", "want"), [
    (None, INT, INT), (VOID, lattice.TEXT, lattice.TEXT), (INT, DOUBLE, DOUBLE), (DOUBLE, INT, DOUBLE), (INT, LONG, LONG),
    (LONG, DOUBLE, DOUBLE), (INT, VOID, INT), (INT, lattice.TEXT, INT), (lattice.TEXT, INT, lattice.TEXT),
])
def test_join(known, seen, want):
    assert lattice.joined(known, seen) == want


def deliver(spark, tmp_path, *waves, header="time_stamp,asset_id,x"):
    root, out = tmp_path / "landing", tmp_path / "out"
    for k, (head, lines) in enumerate((w if isinstance(w, tuple) else (header, w)) for w in waves):
        folder = root / "farm=A" / "turbine=1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.csv").write_text("\n".join([head, *lines]) + "\n")
        ingest.ingest_evolving(spark, str(root), "A", f"{out}/t", f"{out}/schema", f"{out}/c")
    return ingest.read_bronze(spark, f"{out}/t", f"{out}/schema")


def test_whole_numbers_then_fractions_then_text(spark, tmp_path):
    got = deliver(spark, tmp_path, ["a,1,5", "b,1,6"], ["c,1,5.5", "d,1,7.25"], ["e,1,stuck", "f,1,", "g,1,8"])
    assert got.schema["x"].dataType == DOUBLE
    rows = {r.time_stamp: (r.x, r._rescued and json.loads(r._rescued)) for r in got.collect()}
    assert rows == {"a": (5.0, None), "b": (6.0, None), "c": (5.5, None), "d": (7.25, None),
                    "e": (None, {"x": "stuck"}), "f": (None, None), "g": (8.0, None)}


def test_long_numbers_are_rewritten_as_fractions(spark, tmp_path):
    got = deliver(spark, tmp_path, ["a,1,7"], ["b,1,5000000000"], ["c,1,0.5"], ["d,1,-3"])
    assert {r.time_stamp: r.x for r in got.collect()} == {"a": 7.0, "b": 5e9, "c": 0.5, "d": -3.0}


def test_an_empty_column_waits_for_its_type(spark, tmp_path):
    got = deliver(spark, tmp_path, ["a,1,", "b,1,"], ["c,1,2"], (("time_stamp,x,asset_id,y"), ["d,3,1,left", "e,4,1,right"]))
    assert got.schema["x"].dataType == INT and got.schema["y"].dataType == T.StringType()
    assert {r.time_stamp: (r.x, r.y) for r in got.collect()} == {
        "a": (None, None), "b": (None, None), "c": (2, None), "d": (3, "left"), "e": (4, "right")}


def test_lines_of_another_width_are_rescued(spark, tmp_path):
    got = deliver(spark, tmp_path, ["a,1,5", "b,1,6,7", "c,1"])
    rows = {r.time_stamp: (r.x, r._rescued and json.loads(r._rescued)) for r in got.collect()}
    assert rows == {"a": (5, None), "b": (6, {"_line": "b,1,6,7"}), "c": (None, {"_line": "c,1"})}


def test_fixed_schema_stream_rescues_misfits(spark, tmp_path):
    folder = tmp_path / "l" / "farm=A" / "turbine=1"
    folder.mkdir(parents=True)
    (folder / "f.csv").write_text("time_stamp,x\na,1\nb,oops\nc,3,4\n")
    schema = T.StructType([T.StructField("time_stamp", T.StringType()), T.StructField("x", T.IntegerType())])
    ingest.ingest(ingest.raw_stream(spark, str(tmp_path / "l"), "A", schema), str(tmp_path / "t"), str(tmp_path / "c"))
    rows = {r.time_stamp: (r.x, r._rescued and json.loads(r._rescued)) for r in tables.read_table(spark, str(tmp_path / "t")).collect()}
    assert rows == {"a": (1, None), "b": (None, {"x": "oops"}), "c": (3, {"_line": "c,3,4"})}


EVENTS = "farm string, event_id string, event_label string, event_description string, event_start timestamp, event_end timestamp"


def test_only_days_of_changed_events_are_rewritten(spark, folder):
    silver = f"{folder}/silver"
    rows = spark.sql("""SELECT 'A' AS farm, 1L AS asset_id, timestamp '2024-01-01' + make_dt_interval(id) AS time_stamp,
        CAST(NULL AS string) AS event_id, CAST(NULL AS string) AS event_label, CAST(NULL AS string) AS event_description
        FROM range(10)""").withColumn("day", F.to_date("time_stamp"))
    tables.upsert(rows, silver, ["farm", "asset_id", "time_stamp"], [F.desc("time_stamp")], ["farm", "day"], evolving=True)

    def events(*windows):
        made = [("A", i, "anomaly", "d", f"2024-01-0{a} 00:00:00", f"2024-01-0{b} 00:00:00") for i, a, b in windows]
        text = "farm string, event_id string, event_label string, event_description string, s string, e string"
        return spark.createDataFrame(made, text).select(
            "farm", "event_id", "event_label", "event_description",
            F.col("s").cast("timestamp").alias("event_start"), F.col("e").cast("timestamp").alias("event_end"))

    def tags():
        return {r.time_stamp.day: r.event_id for r in ingest.read_evolving(spark, silver).where("event_id IS NOT NULL").collect()}

    assert ingest.retag(spark, silver, events(("e1", 2, 3)), ["farm"]) == 2
    assert tags() == {2: "e1", 3: "e1"}
    assert ingest.retag(spark, silver, events(("e1", 2, 3)), ["farm"]) == 0
    assert ingest.retag(spark, silver, events(("e1", 2, 3), ("e2", 3, 5)), ["farm"]) == 3
    assert tags() == {2: "e1", 3: "e1", 4: "e2", 5: "e2"}
    assert ingest.retag(spark, silver, events(("e2", 3, 5)), ["farm"]) == 2
    assert tags() == {3: "e2", 4: "e2", 5: "e2"}
    assert ingest.read_evolving(spark, silver).count() == 10
