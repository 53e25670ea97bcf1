"""Keyed tables whose number of partitions is their own property."""

import os

from pyspark.sql import functions as F

from vanewatch.sources import tables
from vanewatch.streaming import state


def rows(spark, lo, hi, at):
    return spark.range(lo, hi).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(at).alias("at"), F.col("id").alias("v"))


def held(spark, path):
    return {r.id: r.at for r in tables.read_table(spark, path).collect()}


def test_partitions_belong_to_the_table(spark, folder):
    path, newest = f"{folder}/t", [F.desc("at")]
    state.upsert_keyed(rows(spark, 0, 200, 1), path, ["id"], newest, partitions=40)
    assert state.key_partitions(spark, path) == 40
    state.upsert_keyed(rows(spark, 190, 210, 2), path, ["id"], newest)  # follows the table, not its default
    assert held(spark, path) == {**{f"k{i}": 1 for i in range(190)}, **{f"k{i}": 2 for i in range(190, 210)}}
    used = [d for d in os.listdir(path) if d.startswith("_part=")]
    assert len(used) > state.KEY_PARTITIONS


def test_a_small_batch_leaves_other_partitions_alone(spark, folder):
    path = f"{folder}/t"
    state.upsert_keyed(rows(spark, 0, 200, 1), path, ["id"], [F.desc("at")], partitions=40)
    files = lambda: {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    state.upsert_keyed(rows(spark, 5, 6, 2), path, ["id"], [F.desc("at")])
    assert len(before - files()) == 1


def test_redealt_tables_keep_their_rows(spark, folder):
    path = f"{folder}/t"
    state.upsert_keyed(rows(spark, 0, 50, 1), path, ["id"], [F.desc("at")])
    state.redeal_keys(spark, path, ["id"], 5)
    assert state.key_partitions(spark, path) == 5 and len(held(spark, path)) == 50
    state.upsert_keyed(rows(spark, 0, 60, 2), path, ["id"], [F.desc("at")])
    assert held(spark, path) == {f"k{i}": 2 for i in range(60)}
    assert len([d for d in os.listdir(path) if d.startswith("_part=")]) == 5
    state.redeal_keys(spark, f"{folder}/none", ["id"], 5)
