"""Gold health index by due days, and jobs that fail apart."""

import time
from datetime import date

from pyspark.sql import functions as F

from vanewatch.operators import health
from vanewatch.sources import tables
from vanewatch.streaming import gold, state


def features(spark, shift=0.0, days=12):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 21600)
    rows = spark.range(days * 4).crossJoin(spark.sql("SELECT explode(array('A', 'B')) AS farm, 7L AS asset_id"))
    return rows.select("farm", "asset_id", at.alias("time_stamp"), (F.sin("id") + F.col("id") / 50 + shift).alias("x"),
                       F.to_date(at).alias("day"))


def test_only_due_days_are_derived_again(spark, folder):
    path, out = f"{folder}/features", f"{folder}/gold"
    tables.overwrite_partitions(features(spark), path, ["farm", "day"])
    read = lambda: spark.read.parquet(path)
    assert len(gold.refresh_health(spark, read(), ["x"], out)) == 24
    assert gold.refresh_health(spark, read(), ["x"], out) == []
    last = F.col("day") >= F.lit("2024-01-11").cast("date")
    tables.overwrite_partitions(features(spark, 5.0).where(last & (F.col("farm") == "B")), path, ["farm", "day"])
    assert gold.refresh_health(spark, read(), ["x"], out) == [("B", date(2024, 1, 11)), ("B", date(2024, 1, 12))]
    tables.drop_partition(spark, f"{path}/farm=A/day=2024-01-05")
    assert gold.refresh_health(spark, read(), ["x"], out) == []
    got = {(r.farm, r.day): round(r.health, 9) for r in spark.read.parquet(f"{out}/health").collect()}
    want = {(r.farm, r.day): round(r.health, 9) for r in health.health_series(read(), ["x"]).collect()}
    assert got == want and len(got) == 23


def test_a_failing_component_leaves_the_others(spark):
    done = []

    def work(component):
        if component == "b":
            raise ValueError("no sensors")
        time.sleep(0.05)
        done.append((component, spark.range(3).count()))

    got = {r.component: (r.ok, r.error) for r in gold.isolated(spark, "job", ["a", "b", "c"], work).collect()}
    assert got == {"a": (True, None), "b": (False, "ValueError: no sensors"), "c": (True, None)}
    assert sorted(done) == [("a", 3), ("c", 3)]


def test_a_failing_scorer_keeps_former_predictions_and_raises_no_alert(spark, folder):
    schema = "turbineId string, component string, faultProbability double, rulHoursP50 double, predicted_at timestamp"
    config = spark.createDataFrame([], "component string, faultProbabilityThreshold double, rulHoursP50Threshold double")
    broken = set()

    def scorer(name):
        def score(batch):
            if name in broken:
                raise RuntimeError(name)
            return batch.where(F.col("component") == name)
        return score

    def arrive(hour, p):
        rows = [("T1", c, p, 500.0) for c in ("gearbox", "pitch")]
        df = spark.createDataFrame(rows, "turbineId string, component string, faultProbability double, rulHoursP50 double")
        df.withColumn("predicted_at", F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        state.score_components_on_arrival(stream, {c: scorer(c) for c in ("gearbox", "pitch")}, config, f"{folder}/out", f"{folder}/c")

    arrive(1, 0.1)
    assert tables.read_table(spark, f"{folder}/out/alerts") is None
    broken.add("pitch")
    arrive(2, 0.95)
    assert {r.component for r in spark.read.parquet(f"{folder}/out/alerts").collect()} == {"gearbox"}
    kept = {r.component: r.faultProbability for r in spark.read.parquet(f"{folder}/out/predictions").collect()}
    assert kept == {"gearbox": 0.95, "pitch": 0.1}
    outcomes = {(r._batch, r.component): r.ok for r in spark.read.parquet(f"{folder}/out/outcomes").collect()}
    assert outcomes == {(0, "gearbox"): True, (0, "pitch"): True, (1, "gearbox"): True, (1, "pitch"): False}
