"""Tables, upserts and streams; a stream must end where its batch twin ends."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vanewatch.operators import serving
from vanewatch.sources import files, tables
from vanewatch.streaming import ingest, rollup, state

T0 = datetime(2024, 1, 1)
ROW = "k string, day date, v double, at timestamp"


def batch(spark, *rows):
    return spark.createDataFrame([(k, T0.date() + timedelta(days=d), v, T0 + timedelta(hours=h)) for k, d, v, h in rows], ROW)


def put(df, path):
    tables.upsert(df, path, ["k", "day"], [F.col("at").desc()], ["day"])


def content(spark, path):
    return sorted((r.k, r.day.day, r.v) for r in spark.read.parquet(path).collect())


def test_upsert_replaces_inserts_and_repeats(spark, folder):
    path = f"{folder}/t"
    put(batch(spark, ("a", 0, 1.0, 0), ("b", 0, 2.0, 0), ("c", 1, 3.0, 0)), path)
    change = batch(spark, ("a", 0, 9.0, 1), ("a", 0, 10.0, 2), ("d", 2, 4.0, 1))
    for _ in range(2):
        put(change, path)
        assert content(spark, path) == [("a", 1, 10.0), ("b", 1, 2.0), ("c", 2, 3.0), ("d", 3, 4.0)]


def test_upsert_leaves_other_partitions_alone(spark, folder):
    path = f"{folder}/t"
    put(batch(spark, ("a", 0, 1.0, 0), ("b", 1, 2.0, 0)), path)
    before = spark.read.parquet(path).where("k = 'b'").select(F.col("_metadata.file_path")).first()[0]
    put(batch(spark, ("a", 0, 5.0, 0)), path)
    after = spark.read.parquet(path).where("k = 'b'").select(F.col("_metadata.file_path")).first()[0]
    assert before == after


def test_upsert_takes_new_columns(spark, folder):
    path = f"{folder}/t"
    put(batch(spark, ("a", 0, 1.0, 0)), path)
    tables.upsert(batch(spark, ("b", 0, 2.0, 0)).withColumn("w", F.lit(7)), path, ["k", "day"], [F.col("at").desc()], ["day"], evolving=True)
    out = tables.read_table(spark, path, merge=True).orderBy("k").collect()
    assert [(r.k, r.w) for r in out] == [("a", None), ("b", 7)]


def test_missing_tables(spark, folder):
    assert tables.read_table(spark, f"{folder}/none") is None
    assert tables.read_table(spark, f"{folder}/none", "a int").count() == 0
    assert files.scan_event_info(spark, f"{folder}/none").count() == 0


def test_expired_days_are_deleted(spark, folder):
    path = f"{folder}/t"
    tables.overwrite_partitions(batch(spark, ("a", 0, 1.0, 0), ("a", 5, 1.0, 0), ("a", 9, 1.0, 0)), path, ["day"])
    assert tables.drop_expired(spark, path, "day", 5) == ["2024-01-01"]
    assert spark.read.parquet(path).count() == 2


def test_overwrite_changes_the_schema(spark, folder):
    tables.overwrite(spark.range(3), f"{folder}/t")
    tables.overwrite(spark.range(2).select(F.col("id").cast("string").alias("other")), f"{folder}/t")
    assert spark.read.parquet(f"{folder}/t").columns == ["other"]


def test_file_numbers(spark):
    df = spark.createDataFrame([("x/comma_12.csv",), ("x/other.csv",)], "_source_file string")
    assert [r[0] for r in df.select(files.file_event_id()).collect()] == [12, None]


def write_csv(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_ingest_is_incremental_and_refuses_other_headers(spark, tmp_path):
    schema = spark.createDataFrame([], "time_stamp string, asset_id int, s_avg double").schema
    root, out = tmp_path / "land", str(tmp_path / "out")
    header = "time_stamp,asset_id,s_avg"

    def run():
        ingest.ingest(ingest.raw_stream(spark, str(root), "A", schema), f"{out}/t", f"{out}/c")

    write_csv(root / "farm=A" / "turbine=1" / "a.csv", [header, "2024-01-01 00:00:00,1,1.5"])
    write_csv(root / "farm=A" / "event_info" / "e.csv", ["event_id,event_label", "1,anomaly"])
    run()
    write_csv(root / "farm=A" / "turbine=2" / "b.csv", [header, "2024-01-01 00:00:00,2,2.5"])
    run()
    run()
    got = sorted((r.asset_id, r.s_avg, r.farm) for r in spark.read.parquet(f"{out}/t").collect())
    assert got == [(1, 1.5, "A"), (2, 2.5, "A")]
    write_csv(root / "farm=A" / "turbine=3" / "c.csv", ["time_stamp,s_avg,asset_id", "2024-01-01 00:00:00,3.5,3"])
    with pytest.raises(Exception):
        run()


def test_columns_are_added_as_they_appear(spark, tmp_path):
    root, out = tmp_path / "land", str(tmp_path / "out")

    def run():
        ingest.ingest_evolving(spark, str(root), "A", f"{out}/t", f"{out}/schema", f"{out}/c")

    write_csv(root / "farm=A" / "turbine=1" / "a.csv", ["time_stamp,asset_id,x", "2024-01-01 00:00:00,1,1.5"])
    run()
    write_csv(root / "farm=A" / "turbine=2" / "b.csv", ["time_stamp,y,asset_id", "2024-01-01 00:00:00,7,2"])
    run()
    rows = tables.read_table(spark, f"{out}/t", merge=True).orderBy("asset_id").collect()
    assert [(r.asset_id, r.x, r.y) for r in rows] == [(1, 1.5, None), (2, None, 7)]
    assert ingest.stored_schema(spark, f"{out}/schema").names == ["time_stamp", "asset_id", "x", "y"]


def test_rollup_stream_agrees_with_batch_where_windows_are_final(spark, folder):
    rows = spark.createDataFrame(
        [("A", 1, T0 + timedelta(minutes=37 * i), float(i % 11)) for i in range(400)],
        "farm string, asset_id bigint, time_stamp timestamp, v double")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    out = rollup.event_time_rollup(stream, "v", "24 hours", "6 hours")
    ingest.run_available(out.writeStream.format("parquet").option("path", f"{folder}/out"), f"{folder}/c")
    final = spark.read.parquet(f"{folder}/out")
    want = rollup.event_time_rollup(rows, "v", "24 hours", "6 hours")
    assert final.count() > 20
    assert final.select(want.columns).exceptAll(want).isEmpty()


def test_latest_state_keeps_silent_turbines(spark, folder):
    schema = "turbineId string, time_stamp timestamp, pitchAngleDeg double, rotorSpeedRpm double"
    for day, turbines in ((0, ["A-1", "A-2"]), (1, ["A-1"])):
        df = spark.createDataFrame([(t, T0 + timedelta(days=day), float(day), 1.0) for t in turbines], schema)
        df.write.mode("append").parquet(f"{folder}/in")
        states = state.latest_states(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), ["pitchAngleDeg", "rotorSpeedRpm"])
        state.keep_states(states, f"{folder}/t", f"{folder}/c")
    got = {r.turbineId: (r.updatedAt, r.pitchAngleDeg) for r in spark.read.parquet(f"{folder}/t").collect()}
    assert got == {"A-1": (T0 + timedelta(days=1), 1.0), "A-2": (T0, 0.0)}


def test_serving_table_is_sorted_for_range_reads(spark, folder):
    r = spark.range(5000).select(
        F.concat(F.lit("A-"), F.col("id") % 7).alias("turbine_id"), F.timestamp_seconds("id").alias("time"),
        F.lit("s").alias("sensor"), F.rand(1).alias("value"), F.lit("").alias("unit"))
    tables.write_serving(r, folder + "/t")
    back = spark.read.parquet(folder + "/t")
    assert back.count() == 5000
    plan = serving.telemetry(back, "A-3", F.lit(T0), F.lit(T0))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(turbine_id,A-3)" in plan


def test_an_older_row_never_replaces_a_newer_one(spark, folder):
    path = f"{folder}/newest"
    rows = lambda *r: spark.createDataFrame(r, "k string, day int, at int, v int")
    put = lambda df: tables.upsert(df, path, ["k", "day"], [F.col("at").desc()], ["day"])
    put(rows(("a", 0, 2, 20), ("b", 0, 5, 50)))
    put(rows(("a", 0, 1, 10), ("b", 0, 6, 60)))
    put(rows(("b", 0, 6, 61)))
    got = {r.k: (r["at"], r.v) for r in tables.read_table(spark, path).collect()}
    assert got == {"a": (2, 20), "b": (6, 61)}


def test_files_with_other_headers_lose_no_row(spark, folder):
    from pathlib import Path

    root = Path(folder) / "landing" / "farm=A" / "turbine=T1"
    root.mkdir(parents=True)
    (root / "1.csv").write_text("time_stamp,asset_id,x\n2024-01-01 00:00:00,1,5\n")
    (root / "2.csv").write_text("asset_id,x,time_stamp\n1,6,2024-01-01 00:10:00\n")
    (root / "3.csv").write_text("1,7,2024-01-01 00:20:00\n1,8,2024-01-01 00:30:00\n")
    table = f"{folder}/t"
    ingest.ingest_evolving(
        spark, f"{folder}/landing", "A", table, f"{folder}/schema", f"{folder}/c", pattern="turbine=*/*.csv"
    )
    stored = spark.read.option("mergeSchema", True).parquet(table)
    assert sorted(r.x for r in stored.collect()) == [5, 6]
    assert spark.read.parquet(f"{table}_quarantine").count() == 2


def test_first_load_of_an_upsert_is_not_cached(spark, folder, monkeypatch):
    """Without a table the rows are read once, by the write; with one they are read twice."""
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string").withColumn("day", F.lit(1))
    kept, plain = [], type(rows).persist

    def spied(self, *args, **kwargs):
        kept.append(self)
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(type(rows), "persist", spied)
    for n in (0, 1):
        tables.upsert(rows, f"{folder}/t", ["k"], [F.col("at").desc()], ["day"])
        assert len(kept) == n
        got = spark.read.parquet(f"{folder}/t").select("k", "at", "v").collect()
        assert sorted(tuple(r) for r in got) == [(1, 2, "b"), (2, 1, "c")]
