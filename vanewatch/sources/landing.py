"""Routing of landed objects by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.domain import LANDING_PATTERN


def routed(manifest: DataFrame) -> DataFrame:
    """Decode keys and decide per object: ``triggered``, ``skipped`` or ``rejected``, and why.

    Every record gets a row; a bad one never holds up the others.
    """
    missing = (F.coalesce(F.length("bucket"), F.lit(0)) == 0) | (
        F.coalesce(F.length("key"), F.lit(0)) == 0
    )
    decoded = manifest.withColumn("_raw", F.col("key")).withColumn("key", F.try_url_decode("_raw"))
    fits = F.col("key").rlike(LANDING_PATTERN)
    undecodable = F.col("key").isNull()
    outcome = (
        F.when(missing | undecodable, "rejected").when(fits, "triggered").otherwise("skipped")
    )
    reason = (
        F.when(missing, "record is missing bucket name or object key")
        .when(undecodable, "key is not a valid encoding")
        .when(~fits, "key does not match bronze prefix pattern")
    )
    routed_ = decoded.withColumn("outcome", outcome).withColumn("reason", reason)
    is_ours = F.col("outcome") == "triggered"
    return (
        routed_.withColumn("farm", F.when(is_ours, F.regexp_extract("key", r"^farm=([ABC])/", 1)))
        .withColumn("turbine", F.when(is_ours, F.regexp_extract("key", r"^farm=[ABC]/turbine=([^/]+)/", 1)))
        .drop("_raw")
    )


def affected(routed_objects: DataFrame) -> DataFrame:
    """The (farm, turbine) pairs whose data has to be reprocessed."""
    return (
        routed_objects.where("outcome = 'triggered'")
        .groupBy("farm", "turbine")
        .agg(F.count(F.lit(1)).alias("n_objects"))
    )
