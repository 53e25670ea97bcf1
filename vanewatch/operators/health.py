"""Daily health series per asset, damped-trend fits and forecasts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.domain import FORECAST_DAYS, MIN_TREND_DAYS
from vanewatch.functions.clock import day_of
from vanewatch.operators.simplex import minimised

ASSET = ["farm", "asset_id"]


def daily_means(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.groupBy(*ASSET, day_of("time_stamp").alias("day")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )


def z_scores(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Per asset z-scores with the population deviation; a constant sensor has none.

    Windows here and below run over one row per asset and day.
    """
    w = Window.partitionBy(*ASSET)
    score = {
        c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0))
        for c in columns
    }
    return daily.withColumns(score)


def mean_of_present(columns: list[str]) -> Column:
    present = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.try_divide(reduce(lambda a, b: a + b, present), n)


def health_index(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Negated mean z-score per day: higher is healthier."""
    return z_scores(daily, columns).select(*ASSET, "day", (-mean_of_present(columns)).alias("health"))


def filled(series: DataFrame) -> DataFrame:
    """Fill gaps from the day before, leading gaps from the day after."""
    w = Window.partitionBy(*ASSET).orderBy("day")
    last = F.last("health", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("health", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return series.withColumn("health", F.coalesce(last, first))


def health_series(features: DataFrame, columns: list[str]) -> DataFrame:
    return filled(health_index(daily_means(features, columns), columns))


def trend_candidates(series: DataFrame, min_days: int = MIN_TREND_DAYS) -> DataFrame:
    """Number of days per asset and why an asset is not fitted, if it is not."""
    return series.groupBy(*ASSET).agg(
        F.count(F.lit(1)).alias("n_days"), F.count("health").alias("n_present")
    ).withColumn(
        "skip_reason",
        F.when(F.col("n_days") < min_days, "too few days").when(
            F.col("n_present") == 0, "no values"
        ),
    )


def series_arrays(series: DataFrame, min_days: int = MIN_TREND_DAYS) -> DataFrame:
    """One array of daily values per asset that can be fitted; days bound its length."""
    points = F.array_sort(F.collect_list(F.struct("day", "health")))
    return (
        series.groupBy(*ASSET)
        .agg(points.alias("_points"), F.count(F.lit(1)).alias("n_days"))
        .where((F.col("n_days") >= min_days) & F.element_at("_points", 1)["health"].isNotNull())
        .select(*ASSET, "n_days", F.col("_points.health").alias("values"))
    )


def _smooth(values: Column, alpha: Column, beta: Column, phi: Column) -> Column:
    """Fold a series into the level, trend and squared error of damped additive smoothing.

    It starts from the first value with no trend; every later value is first predicted as
    level + phi * trend, then level and trend are corrected.
    """
    start = F.struct(
        F.element_at(values, 1).alias("level"),
        F.lit(0.0).alias("trend"),
        F.lit(0.0).alias("sse"),
    )

    def step(state: Column, x: Column) -> Column:
        expected = state["level"] + phi * state["trend"]
        level = alpha * x + (F.lit(1.0) - alpha) * expected
        trend = beta * (level - state["level"]) + (F.lit(1.0) - beta) * phi * state["trend"]
        error = x - expected
        return F.struct(
            level.alias("level"),
            trend.alias("trend"),
            (state["sse"] + error * error).alias("sse"),
        )

    return F.aggregate(F.slice(values, 2, F.size(values)), start, step)


def trend_fit(
    arrays: DataFrame,
    alphas: list[float] = (0.2, 0.5, 0.8),
    betas: list[float] = (0.1, 0.3),
    phis: list[float] = (0.8, 0.9, 0.98),
) -> DataFrame:
    """Best damped-trend parameters of each asset over a grid, with the fit's RMSE.

    Every (series, parameters) pair is folded on its own row; rows of an asset are already
    together, so picking the best needs no shuffle. Equal errors (to nine digits) go to the
    smaller parameters.
    """
    grid = F.array(
        *[
            F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("alpha", "beta", "phi"), point)])
            for point in product(alphas, betas, phis)
        ]
    )
    tried = arrays.withColumn("_g", F.explode(grid)).select(*ASSET, "n_days", "values", "_g.*")
    folded = tried.withColumn(
        "_fit", _smooth(F.col("values"), F.col("alpha"), F.col("beta"), F.col("phi"))
    )
    candidate = F.struct(
        F.round("_fit.sse", 9).alias("rounded"), "alpha", "beta", "phi", "_fit.level", "_fit.trend",
        "_fit.sse",
    )
    best = folded.groupBy(*ASSET, "n_days").agg(F.min(candidate).alias("_best"))
    fields = [f"_best.{n}" for n in ("alpha", "beta", "phi", "level", "trend")]
    rmse = F.sqrt(F.col("_best.sse") / F.col("n_days"))
    return best.select(*ASSET, "n_days", *fields, rmse.alias("fit_rmse"))


#: Box of (alpha, beta, phi) of the optimiser; fixed values, the damping as in the grid above.
TREND_LOW, TREND_HIGH = np.array([1e-4, 1e-4, 0.8]), np.array([0.9999, 0.9999, 0.98])
TREND_STARTS = np.array(list(product((0.05, 0.2, 0.5, 0.8, 0.95), (0.01, 0.1, 0.3, 0.7), (0.8, 0.9, 0.98))))
#: Errors have several minima; the simplex runs from so many of the best starts.
TREND_RUNS = 5
#: Series that one numpy batch holds.
SERIES_BATCH = 500


class _Series:
    """Series of different lengths side by side; their errors under damped smoothing."""

    def __init__(self, values: list):
        self.lengths = np.array([len(v) for v in values])
        self.data = np.zeros((max(self.lengths), len(values)))
        for i, v in enumerate(values):
            self.data[: len(v), i] = v

    def solved(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sse, level, trend) at the end of each series, with the best start for its parameters.

        The errors are linear in the level and trend before the first day, so their best values
        follow from two-by-two normal equations. Three runs of the recursion give them: the data
        from a zero start, and the two unit starts without data.
        """
        alpha, beta, phi = points.T
        level, trend = np.zeros((3, len(alpha))), np.zeros((3, len(alpha)))
        level[1], trend[2] = 1.0, 1.0
        errors, whole, both = np.empty((len(self.data), 3, len(alpha))), self.lengths.min(), alpha * beta
        for t, row in enumerate(self.data):
            faded = phi * trend
            expected = level + faded
            error = np.negative(expected, out=errors[t])
            error[0] += row
            if t < whole:
                level, trend = expected + alpha * error, faded + both * error
            else:  # some series have ended
                open_ = t < self.lengths
                error *= open_
                level, trend = np.where(open_, expected + alpha * error, level), np.where(open_, faded + both * error, trend)
        square = np.empty((3, 3, len(alpha)))
        for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
            square[i, j] = square[j, i] = np.einsum("tn,tn->n", errors[:, i], errors[:, j])
        a, b, c = square[1, 1], square[1, 2], square[2, 2]
        p, q = -square[0, 1], -square[0, 2]
        det = a * c - b * b
        safe = det > 1e-12 * np.maximum(a * c, 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            l0 = np.where(safe, (c * p - b * q) / det, p / np.maximum(a, 1e-300))
            b0 = np.where(safe, (a * q - b * p) / det, 0.0)
        sse = square[0, 0] - 2 * (l0 * p + b0 * q) + l0 * l0 * a + 2 * l0 * b0 * b + b0 * b0 * c
        mix = lambda s: s[0] + l0 * s[1] + b0 * s[2]
        return np.maximum(sse, 0.0), mix(level), mix(trend)


def _best_trends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), SERIES_BATCH):
            part = frame.iloc[at : at + SERIES_BATCH]
            series = _Series(list(part["values"]))
            loss = lambda points: series.solved(points)[0]  # noqa: B023, E731
            tried = np.stack([loss(np.tile(s, (len(part), 1))) for s in TREND_STARTS])
            ranked = np.argsort(tried, axis=0, kind="stable")
            first, again = np.array([0.1, 0.1, 0.04]), np.array([0.02, 0.02, 0.01])
            runs = [minimised(loss, TREND_STARTS[ranked[k]], first, TREND_LOW, TREND_HIGH, 80) for k in range(TREND_RUNS)]
            best = np.argmin([r[1] for r in runs], axis=0)
            point = np.stack([r[0] for r in runs])[best, np.arange(len(part))]
            point, _ = minimised(loss, point, again, TREND_LOW, TREND_HIGH)
            sse, level, trend = series.solved(point)
            yield part.drop(columns="values").assign(
                alpha=point[:, 0], beta=point[:, 1], phi=point[:, 2], level=level, trend=trend,
                fit_rmse=np.sqrt(sse / part["n_days"].to_numpy()),
            )


def trend_optimum(arrays: DataFrame) -> DataFrame:
    """Damped-trend parameters of least squared error, start level and start trend included.

    Columns as of ``trend_fit``. Series are independent, so they are optimised where they lie,
    some hundred side by side. The simplex starts from the best points of a coarse grid and once
    more from its best result, so an error is never above the grid's. They are few and small for
    their cost, so they are dealt over all cores, whatever their bytes would suggest.
    """
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema if f.name != "values")
    numbers = ", ".join(f"{n} double" for n in ("alpha", "beta", "phi", "level", "trend", "fit_rmse"))
    tasks = 2 * arrays.sparkSession.sparkContext.defaultParallelism
    return arrays.repartition(tasks, *ASSET).mapInPandas(_best_trends, f"{keys}, {numbers}")


def trend_forecast(fits: DataFrame, days: int = FORECAST_DAYS) -> DataFrame:
    """Values of the next ``days`` days: the trend's share fades by ``phi`` each day."""
    def value(h: Column) -> Column:
        phi = F.col("phi")
        fade = F.when(phi == 1.0, h.cast("double")).otherwise(
            phi * (F.lit(1.0) - F.pow(phi, h)) / (F.lit(1.0) - phi)
        )
        return F.col("level") + F.col("trend") * fade

    return fits.withColumn("forecast", F.transform(F.sequence(F.lit(1), F.lit(days)), value))


def fit_rmse(df: DataFrame, keys: list[str], actual: str, fitted: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col(actual) - F.col(fitted), 2))).alias("rmse")
    )


def sustained_offset(
    daily: DataFrame, column: str, threshold: float, min_days: int
) -> DataFrame:
    """Runs of consecutive days on which a value stays off the asset's mean by a threshold."""
    w = Window.partitionBy(*ASSET)
    by_day = w.orderBy("day")
    off = F.abs(F.col(column) - F.avg(column).over(w)) > threshold
    flagged = daily.withColumn("_off", off).where("_off")
    island = F.date_sub(F.to_date("day"), F.row_number().over(by_day))
    return (
        flagged.withColumn("_island", island)
        .groupBy(*ASSET, "_island")
        .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n_days"))
        .where(F.col("n_days") >= min_days)
        .drop("_island")
    )
