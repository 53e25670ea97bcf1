"""Session settings and shared scratch locations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Tasks that list files; by default one for every path, up to 10,000 for each scan or micro-batch.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "48",
}
PINNED = (
    "spark.sql.session.timeZone", "spark.sql.sources.partitionOverwriteMode",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism",
)


def build_session(app: str = "vanewatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the run-time SQL settings the operators rely on; every clock is UTC."""
    for key in PINNED:
        spark.conf.set(key, SETTINGS[key])
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither the setting nor a
    context-level folder exists is one made, and a temporary one only in local mode: other
    executors could not read it back elsewhere.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="vanewatch-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run of ``label``."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(spark: SparkSession, df):
    """Materialise ``df`` in the reliable checkpoint folder."""
    checkpoint_root(spark)
    return df.checkpoint(eager=True)
