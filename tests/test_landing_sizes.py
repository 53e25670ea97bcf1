"""Files and listing tasks that do not grow with the number of turbines."""

from pyspark.sql import functions as F

from vanewatch.plans import q_ingest
from vanewatch.session import PINNED, SETTINGS, prepare
from vanewatch.streaming import lattice


def turbines(spark, n):
    return spark.range(n).select(
        F.lit("A").alias("farm"), F.timestamp_seconds("id").alias("time_stamp"), F.col("id").alias("asset_id"), "id",
        F.lit("train").alias("train_test"), F.lit(1).alias("status_type_id"),
        *[F.col("id").cast("double").alias(c) for c in q_ingest.fv.SENSORS])


def test_turbines_share_folders_and_keep_all_rows(spark, tmp_path):
    rows = turbines(spark, 3 * q_ingest.FOLDERS)
    q_ingest.land(rows, str(tmp_path / "shared"))
    q_ingest.land(rows, str(tmp_path / "own"), per_turbine=True)
    assert len(list((tmp_path / "shared" / "farm=A").iterdir())) == q_ingest.FOLDERS
    assert len(list((tmp_path / "own" / "farm=A").iterdir())) == rows.count()
    for kind in ("shared", "own"):
        got = q_ingest.files.scan_csv(spark, str(tmp_path / kind), "A", schema=q_ingest.RAW_SCHEMA)
        assert sorted(r.asset_id for r in got.select("asset_id").collect()) == list(range(rows.count()))


def test_listing_does_not_take_a_task_per_path(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.conf.set(key, "10000")
    assert key in PINNED and prepare(spark).conf.get(key) == SETTINGS[key] == "48"


def test_levels_of_odd_numbers(spark):
    texts = ["7", " 7 ", "+7", "-0", "5000000000", "99999999999999999999", "1.0", "1e3", "0x1F", "NaN", "Infinity", "1d", "", "a", None, "٣"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lattice._level(F.col("t")).alias("n"))
    plain = F.col("t").try_cast
    want = F.when(F.col("t").isNull(), 0).when(plain("int").isNotNull(), 1).when(plain("bigint").isNotNull(), 2).when(
        plain("double").isNotNull(), 3).otherwise(4)
    assert [r.t for r in frame.where(F.col("n") != want).collect()] == []
