"""Rolling per-asset statistics over time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.domain import META_COLUMNS, ROLLING_HOURS
from vanewatch.functions.clock import time_bucket
from vanewatch.operators.joins import attach

HOUR = 3600
PANE = 300
DENSE_ROWS = 5000  # per key and three-day chunk; ten-minute readings make 432


def with_halo(
    df: DataFrame, clock: str, chunk_seconds: int, reach_seconds: int
) -> DataFrame:
    """Assign rows to fixed time chunks and copy the rows a neighbour's windows reach into.

    Looking back ``reach_seconds`` from a chunk only reaches the last rows of the chunk before
    it, so those are copied forward and marked ``_halo``. A key's history is thereby spread
    over many tasks while every window still sees all its rows.
    """
    if chunk_seconds < reach_seconds:
        raise ValueError("a chunk must be at least as long as the longest window")
    second = F.unix_seconds(clock)
    chunk = F.floor(second / F.lit(chunk_seconds)).cast("bigint")
    late = F.pmod(second, F.lit(chunk_seconds)) >= F.lit(chunk_seconds - reach_seconds)
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("halo"))
    next_one = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("halo"))
    copies = F.when(late, F.array(own, next_one)).otherwise(F.array(own))
    return (
        df.withColumn("_second", second)
        .withColumn("_copy", F.explode(copies))
        .withColumns({"_chunk": F.col("_copy.chunk"), "_halo": F.col("_copy.halo")})
        .drop("_copy")
    )


def rolling_features(
    df: DataFrame,
    sensors: list[str],
    keep: list[str] | None = None,
    hours: list[int] | None = None,
    keys: list[str] | None = None,
    chunk_hours: int = 3 * 24,
    dense_rows: int = DENSE_ROWS,
) -> DataFrame:
    """``{sensor}_avg_{h}h`` and sample-deviation ``{sensor}_std_{h}h`` per row.

    A window of h hours covers the rows of the same asset from exactly h hours earlier up to
    and including the row's own second. All horizons share one shuffle and one sort.

    A sliding frame costs its length per row, which is fine for ten-minute readings and
    quadratic for a key that reports far more often. One count per key and chunk finds those
    keys; their rows, if any, go through :func:`_dense_statistics` instead.
    """
    hours = hours or ROLLING_HOURS
    keys = keys or ["farm", "asset_id"]
    keep = META_COLUMNS if keep is None else keep
    carried = list(dict.fromkeys([*keys, "time_stamp", *keep, *sensors]))
    rows = df.select(*carried)
    chunk = time_bucket("time_stamp", chunk_hours * HOUR)
    busy = rows.groupBy(*keys, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    dense = busy.where(F.col("_n") > dense_rows).select(*keys).distinct()
    if dense.isEmpty():
        return _sliding_statistics(rows, sensors, keep, hours, keys, chunk_hours)
    flag = dense.withColumn("_dense", F.lit(True))
    flagged = attach(rows, flag, keys, ["time_stamp"])
    few = flagged.where(F.col("_dense").isNull()).drop("_dense")
    many = flagged.where(F.col("_dense")).drop("_dense")
    return _sliding_statistics(few, sensors, keep, hours, keys, chunk_hours).unionByName(
        _dense_statistics(many, sensors, keep, hours, keys, chunk_hours)
    )


def _sliding_statistics(
    rows: DataFrame, sensors: list[str], keep: list[str], hours: list[int], keys: list[str],
    chunk_hours: int,
) -> DataFrame:
    spread = with_halo(rows, "time_stamp", chunk_hours * HOUR, max(hours) * HOUR)
    base = Window.partitionBy(*keys, "_chunk").orderBy("_second")
    statistics = []
    for h in hours:
        frame = base.rangeBetween(-h * HOUR, Window.currentRow)
        for sensor in sensors:
            statistics.append(F.avg(sensor).over(frame).alias(f"{sensor}_avg_{h}h"))
            statistics.append(F.stddev_samp(sensor).over(frame).alias(f"{sensor}_std_{h}h"))
    return spread.select(*keep, "_halo", *statistics).where(~F.col("_halo")).drop("_halo")


class _Moments:
    """Columns holding count, mean and squared deviations of one sensor, and how they add up."""

    def __init__(self, n: Column, mean: Column, dev: Column):
        zero = F.lit(0.0)
        self.n = F.coalesce(n.cast("double"), zero)
        self.mean, self.dev = F.coalesce(mean, zero), F.coalesce(dev, zero)

    @classmethod
    def named(cls, name: str) -> _Moments:
        return cls(*[F.col(f"{name}.{part}") for part in ("n", "mean", "dev")])

    @classmethod
    def of(cls, sensor: str) -> _Moments:
        n = F.count(sensor)
        return cls(n, F.avg(sensor), F.var_pop(sensor) * n)

    @classmethod
    def over(cls, parts: _Moments, frame, centre: Column) -> _Moments:
        """Sum of parts over a frame; deviations are taken from a nearby centre first."""
        n = F.sum(parts.n).over(frame)
        mean = F.try_divide(F.sum(parts.n * parts.mean).over(frame), n)
        off = parts.mean - centre
        dev = F.sum(parts.dev + parts.n * off * off).over(frame) - n * (mean - centre) * (mean - centre)
        return cls(n, mean, F.greatest(dev, F.lit(0.0)))

    def centre(self, frame) -> Column:
        """A value near the parts of a frame; NaN and infinite parts have no say in it."""
        finite = F.abs(self.mean) < F.lit(float("inf"))  # NaN sorts above all numbers
        n = F.sum(F.when(finite, self.n)).over(frame)
        return F.coalesce(F.try_divide(F.sum(F.when(finite, self.n * self.mean)).over(frame), n), F.lit(0.0))

    def __add__(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        mean = self.mean + F.coalesce(F.try_divide(gap * other.n, n), F.lit(0.0))
        cross = F.coalesce(F.try_divide(gap * gap * self.n * other.n, n), F.lit(0.0))
        return _Moments(n, mean, self.dev + other.dev + cross)

    def packed(self, name: str) -> Column:
        return F.struct(self.n.alias("n"), self.mean.alias("mean"), self.dev.alias("dev")).alias(name)

    def average(self) -> Column:
        return F.when(self.n > 0, self.mean)

    def deviation(self) -> Column:
        return F.when(self.n > 1, F.sqrt(self.dev / (self.n - 1)))


def _dense_statistics(
    rows: DataFrame, sensors: list[str], keep: list[str], hours: list[int], keys: list[str],
    chunk_hours: int,
) -> DataFrame:
    """The same statistics in time proportional to the rows, for keys with very many.

    A window whose length is a multiple of a pane is the end of one pane, some whole panes and
    the beginning of another. Rows are first combined per second. Beginnings and ends are
    running sums inside a pane, an end being looked up by a probe placed in that older pane;
    whole panes are few. No task holds more of a key than a pane or the panes of a chunk.
    """
    timed = rows.withColumn("_second", F.unix_seconds("time_stamp"))
    timed = timed.withColumn("_pane", F.floor(F.col("_second") / PANE).cast("bigint"))
    names = {s: f"m{i}" for i, s in enumerate(sensors)}
    seconds = timed.groupBy(*keys, "_second", "_pane").agg(
        *[_Moments.of(s).packed(m) for s, m in names.items()]
    )

    # Inside panes: records of their own pane, probes into the pane each horizon begins in.
    places = [F.struct(F.col("_pane").alias("at"), F.lit(0).alias("hours"))] + [
        F.struct((F.col("_pane") - h * HOUR // PANE).alias("at"), F.lit(h).alias("hours")) for h in hours
    ]
    placed = seconds.withColumn("_p", F.explode(F.array(*places))).withColumn(
        "_offset", F.col("_second") - F.col("_pane") * PANE
    )
    is_row = F.col("_p.hours") == 0
    placed = placed.withColumns({m: F.when(is_row, F.col(m)) for m in names.values()})
    pane = Window.partitionBy(*keys, "_p.at")
    to_here = pane.orderBy("_offset").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = pane.orderBy(F.desc("_offset")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edges = []
    for m in names.values():
        parts = _Moments.named(m)
        centre = parts.centre(pane)
        edges.append(_Moments.over(parts, to_here, centre).packed(f"{m}_begin"))
        edges.append(_Moments.over(parts, from_here, centre).packed(f"{m}_end"))
    marked = placed.select(*keys, "_second", "_pane", "_p", *edges)
    picked = []
    for m in names.values():
        picked.append(F.any_value(F.when(is_row, F.col(f"{m}_begin")), True).alias(f"{m}_begin"))
        for h in hours:
            here = F.when(F.col("_p.hours") == h, F.col(f"{m}_end"))
            picked.append(F.any_value(here, True).alias(f"{m}_end_{h}"))
    ends = marked.groupBy(*keys, "_second", "_pane").agg(*picked)

    # Whole panes between.
    panes = timed.groupBy(*keys, "_pane").agg(*[_Moments.of(s).packed(m) for s, m in names.items()])
    panes = with_halo(
        panes.withColumn("_start", F.timestamp_seconds(F.col("_pane") * PANE)),
        "_start", chunk_hours * HOUR, max(hours) * HOUR,
    )
    chunk = Window.partitionBy(*keys, "_chunk")
    whole = []
    for m in names.values():
        parts = _Moments.named(m)
        centre = parts.centre(chunk)
        for h in hours:
            frame = chunk.orderBy("_pane").rangeBetween(-(h * HOUR // PANE) + 1, -1)
            whole.append(_Moments.over(parts, frame, centre).packed(f"{m}_mid_{h}"))
    between = panes.select(*keys, "_pane", "_halo", *whole).where(~F.col("_halo")).drop("_halo")

    results = []
    for s, m in names.items():
        for h in hours:
            total = _Moments.named(f"{m}_end_{h}") + _Moments.named(f"{m}_mid_{h}") + _Moments.named(f"{m}_begin")
            results.append(total.average().alias(f"{s}_avg_{h}h"))
            results.append(total.deviation().alias(f"{s}_std_{h}h"))
    per_second = ends.join(between, [*keys, "_pane"]).select(*keys, "_second", *results)
    return timed.join(per_second, [*keys, "_second"]).select(
        *keep, *[f"{s}_{a}_{h}h" for h in hours for s in sensors for a in ("avg", "std")]
    )


def rolling_features_long(
    readings: DataFrame, hours: list[int] | None = None, chunk_hours: int = 3 * 24
) -> DataFrame:
    """The same statistics for one row per (farm, asset, time, sensor, value).

    For farms with hundreds of columns: the plan stays small and sensors spread over tasks.
    """
    return rolling_features(
        readings,
        ["value"],
        ["farm", "asset_id", "time_stamp", "sensor"],
        hours,
        ["farm", "asset_id", "sensor"],
        chunk_hours,
    )


def recompute_scope(changed: DataFrame, reach_hours: int = max(ROLLING_HOURS)) -> DataFrame:
    """Days whose features a set of changed rows can influence: their own and the reach after."""
    first = F.to_date("time_stamp")
    last = F.to_date(F.timestamp_seconds(F.unix_seconds("time_stamp") + reach_hours * HOUR))
    return changed.select(
        "farm", "asset_id", F.explode(F.sequence(first, last)).alias("day")
    ).distinct()
