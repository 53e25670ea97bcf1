"""Ranks and picks that never gather one group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key. Spark limits the groups before the shuffle, so copies stay local."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def numbered(
    df: DataFrame, group: list[str], bucket: Column, order: list, name: str
) -> DataFrame:
    """Row number inside ``group``, where ``bucket`` never decreases along ``order``.

    Rows are numbered inside (group, bucket) only; the sizes of the earlier buckets, a small
    table from a map-side combined count, give the offset. A null group is a group of its own,
    and a null order key comes first, so no row is lost.
    """
    tagged = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        tagged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_offset")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = tagged.withColumn("_local", F.row_number().over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return (
        local.join(offsets, same)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_offset", "_local", *[f"_of_{k}" for k in keys])
    )


def every_nth(
    df: DataFrame, group: list[str], order: str, stride: Column | int, bucket_rows: int = 100_000
) -> DataFrame:
    """Rows 0, n, 2n, ... of each group in ``order``, an increasing number such as a row id."""
    step = stride if isinstance(stride, Column) else F.lit(stride)
    ranked = numbered(
        df, group, F.floor(F.col(order) / F.lit(bucket_rows)), [order], "_row"
    )
    return ranked.where(F.pmod(F.col("_row") - 1, step) == 0).drop("_row")


def first_share(
    df: DataFrame, group: str, keys: list[str], percent: int, seed: str, name: str, digits: int = 4
) -> DataFrame:
    """Flag the ``percent`` of each group whose hashed key sorts first, rounded up.

    The last hash inside the share is looked up per group: counts per hash prefix point to the
    prefix holding it, and only rows with that prefix are sorted. The rows themselves are
    compared with that one value and are never shuffled. Groups are classes of a training set;
    the two broadcast tables have one row for each.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    hashed = df.withColumn("_md5", digest).withColumn(
        "_prefix", F.conv(F.substring("_md5", 1, digits), 16, 10).cast("int")
    )
    upto = Window.partitionBy(group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    edges = (
        hashed.groupBy(group, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_wanted", F.floor((F.sum("_n").over(whole) * percent + 99) / 100))
        .where("_upto >= _wanted AND _upto - _n < _wanted")
        .select(group, "_prefix", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_k"))
    )
    inside = Window.partitionBy(group, "_prefix").orderBy("_md5")
    last = (
        hashed.select(group, "_prefix", "_md5")
        .join(F.broadcast(edges), [group, "_prefix"])
        .withColumn("_rn", F.row_number().over(inside))
        .where("_rn = _k")
        .select(group, F.col("_md5").alias("_last"))
    )
    return (
        hashed.join(F.broadcast(last), group, "left")
        .withColumn(name, F.coalesce(F.col("_md5") <= F.col("_last"), F.lit(False)))
        .drop("_md5", "_prefix", "_last")
    )
