"""Lookups that hold up when one key owns a large share of the rows.

Three rules run through this module:

* a side is broadcast only after its size was measured; beyond the bound the same result
  comes from a shuffle join,
* a shuffle join on a key that may be hot is salted or carries a time bucket in its key,
* interval lookups first turn overlapping intervals into disjoint ones, so every row meets at
  most one of them and nothing has to be de-duplicated afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanewatch.functions.clock import time_bucket

BROADCAST_BYTES = 64 * 1024 * 1024
DAY = 86400
MONTH = 30 * DAY


def measured_bytes(df: DataFrame, copies: Column | None = None) -> int:
    """Size of a frame from one aggregate pass: 16 bytes a field plus the text it holds.

    ``copies`` is how often each row is going to be repeated.
    """
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    total = width if copies is None else width * copies
    return df.agg(F.sum(total).alias("n")).first()["n"] or 0


def broadcast_within(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured size allows it, else leave the join to a shuffle."""
    return F.broadcast(df) if limit > 0 and measured_bytes(df) <= limit else df


def salted(df: DataFrame, salt_on: list[str], salts: int) -> DataFrame:
    """Spread equal keys over ``salts`` sub-keys; derived from the row, so a retry repeats it."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))


def replicate(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def attach(
    rows: DataFrame,
    dimension: DataFrame,
    keys: list[str],
    salt_on: list[str],
    how: str = "left",
    salts: int = 32,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Equi-join big ``rows`` with a smaller ``dimension`` whose keys may be hot in ``rows``.

    A row with a null key matches nothing. Such rows may be nearly all there are, so they are
    spread over all tasks instead of the few pieces of a hot key.
    """
    if broadcast_bytes > 0 and measured_bytes(dimension) <= broadcast_bytes:
        return rows.join(F.broadcast(dimension), keys, how)
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    anywhere = F.xxhash64(*salt_on)
    return (
        salted(rows, salt_on, salts)
        .withColumn("_salt", F.when(missing, anywhere).otherwise(F.col("_salt")))
        .join(replicate(dimension, salts), [*keys, "_salt"], how)
        .drop("_salt")
    )


def _after(column: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(column) + F.lit(1))


def prior_max(
    df: DataFrame,
    keys: list[str],
    clock: str,
    order: list[str],
    value: str,
    name: str,
    chunk_seconds: int = MONTH,
) -> DataFrame:
    """Largest ``value`` among the rows of the same key that come earlier in ``order``.

    ``order`` starts with ``clock``. The running maximum is taken per time chunk and the
    maxima of earlier chunks are carried in, so no task sees one key's whole history.
    """
    chunked = df.withColumn("_chunk", time_bucket(clock, chunk_seconds))
    before = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.max(value).alias("_top"))
        .withColumn("_carry", F.max("_top").over(earlier))
        .drop("_top")
    )
    return (
        chunked.withColumn(name, F.max(value).over(before))
        .join(carry, [*keys, "_chunk"])
        .withColumn(name, F.greatest(name, "_carry"))
        .drop("_chunk", "_carry")
    )


def fits_in_buckets(
    spans: DataFrame, bucket_seconds: int, limit: int, lo: str = "_lo", hi: str = "_hi"
) -> bool:
    """Can the spans, one copy per time bucket they touch, be broadcast."""
    touched = time_bucket(hi, bucket_seconds) - time_bucket(lo, bucket_seconds) + 1
    return limit > 0 and measured_bytes(spans, touched) <= limit


def first_started_segments(
    events: DataFrame, keys: list[str], event_id: str, start: str, end: str
) -> DataFrame:
    """Cut closed windows so that each instant belongs to the earliest-started window over it.

    Ordered by (start, id), an instant at or after ``start`` is already covered by an earlier
    window exactly if it is not past the largest earlier end. What is left of a window is one
    closed segment ``[_lo, _hi]`` beginning right after that end.
    """
    usable = events.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    ordered = prior_max(usable, keys, start, [start, event_id], end, "_covered")
    lo = F.greatest(F.col(start), _after(F.col("_covered")))
    return (
        ordered.withColumn("_lo", lo)
        .withColumn("_hi", F.col(end))
        .where(F.col("_lo") <= F.col("_hi"))
        .drop("_covered")
    )


def next_start_segments(
    events: DataFrame, keys: list[str], event_id: str, start: str, horizon_seconds: int
) -> DataFrame:
    """Closed segment of instants whose next event start, within the horizon, is this one."""
    ordered = prior_max(
        events.where(F.col(start).isNotNull()), keys, start, [start, event_id], start, "_previous"
    )
    reach = F.timestamp_seconds(F.unix_seconds(start) - F.lit(horizon_seconds))
    last = F.timestamp_micros(F.unix_micros(start) - F.lit(1))
    return (
        ordered.withColumn("_lo", F.greatest(reach, F.col("_previous")))
        .withColumn("_hi", last)
        .where(F.col("_lo") <= F.col("_hi"))
        .drop("_previous")
    )


def interval_lookup(
    rows: DataFrame,
    segments: DataFrame,
    keys: list[str],
    clock: str,
    small: bool,
    how: str = "left",
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Join each row to the segments ``[_lo, _hi]`` of its key that hold its clock.

    Both sides get the number of a time bucket, which makes this an equi-join with a range
    check inside one bucket: a broadcast hash join if the segments were measured to be
    ``small``, a shuffle on (keys, bucket) otherwise, where even a hot key is spread over its
    buckets. With disjoint segments a row finds at most one.
    """
    spans = F.sequence(time_bucket("_lo", bucket_seconds), time_bucket("_hi", bucket_seconds))
    by_bucket = segments.withColumn("_bucket", F.explode(spans))
    right = (F.broadcast(by_bucket) if small else by_bucket).alias("seg")
    left = rows.withColumn("_bucket", time_bucket(clock, bucket_seconds)).alias("row")
    condition = F.col("row._bucket") == F.col("seg._bucket")
    for key in keys:
        condition = condition & (F.col(f"row.{key}") == F.col(f"seg.{key}"))
    condition = condition & F.col(f"row.{clock}").between(F.col("seg._lo"), F.col("seg._hi"))
    extra = [c for c in segments.columns if c not in {*keys, "_lo", "_hi"}]
    clash = sorted(set(extra) & set(rows.columns))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    return left.join(right, condition, how).select(
        *[F.col(f"row.{c}") for c in rows.columns], *[F.col(f"seg.{c}") for c in extra]
    )
