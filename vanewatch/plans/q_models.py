"""Queries over health series, training sets, metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanewatch.domain import QUANTILES
from vanewatch.operators import faults, health, learning, rolling, rul, sensors
from vanewatch.plans import fleet_view as fv
from vanewatch.plans import training
from vanewatch.plans.fleet_view import sql
from vanewatch.plans.q_rows import rounded
from vanewatch.plans.registry import query
from vanewatch.session import work_path
from vanewatch.sources import tables
from vanewatch.streaming import gold

DAILY = [f"{s}_avg_24h" for s in fv.FEATURED]
MIN_DAYS = 20  # the shared tables span thirty days, most assets miss a few
ROUNDS, DEPTH = 4, 3  # of classifier_checks; the other model queries take those of the library


def day_features(spark, sf_dir):
    keep = ["farm", "asset_id", "time_stamp"]
    return rolling.rolling_features(fv.scada(spark, sf_dir), fv.FEATURED, keep, [24])


@query("daily_component_means", sql("""
    SELECT farm, asset_id, day, round(sensor_1_avg_avg_24h, 6) AS sensor_1_avg_avg_24h,
      round(sensor_2_avg_avg_24h, 6) AS sensor_2_avg_avg_24h FROM daily""", "daily"))
def daily_component_means(spark, sf_dir):
    return rounded(health.daily_means(day_features(spark, sf_dir), DAILY), DAILY)


@query("asset_zscore", sql("""
    SELECT farm, asset_id, day, round(z1, 6) AS sensor_1_avg_avg_24h, round(z2, 6) AS sensor_2_avg_avg_24h FROM health""", "health"))
def asset_zscore(spark, sf_dir):
    return rounded(health.z_scores(health.daily_means(day_features(spark, sf_dir), DAILY), DAILY), DAILY)


@query("health_index", sql("SELECT farm, asset_id, day, round(health, 6) AS health FROM health", "health"))
def health_index(spark, sf_dir):
    daily = health.daily_means(day_features(spark, sf_dir), DAILY)
    return rounded(health.health_index(daily, DAILY), ["health"])


@query("health_fill", sql("""
    SELECT farm, asset_id, day, round(coalesce(
      last_value(h IGNORE NULLS) OVER (PARTITION BY farm, asset_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(h IGNORE NULLS) OVER (PARTITION BY farm, asset_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS health
    FROM (SELECT *, CASE WHEN health <= 0.25 THEN health END AS h FROM health)""", "health"))
def health_fill(spark, sf_dir):
    """Very healthy days are blanked and filled from their neighbours."""
    series = health.health_index(health.daily_means(day_features(spark, sf_dir), DAILY), DAILY)
    gaps = series.withColumn("health", F.when(F.col("health") <= 0.25, F.col("health")))
    return rounded(health.filled(gaps), ["health"])


@query("health_daily", sql("SELECT farm, asset_id, day, round(health, 6) AS health FROM series", "series"))
def health_daily(spark, sf_dir):
    return rounded(health.health_series(day_features(spark, sf_dir), DAILY), ["health"])


@query("gold_health_index", sql("""
    SELECT farm, asset_id, day, round(health, 6) AS health, day >= TIMESTAMP '2024-01-20' AND farm = 'B' AS rewritten FROM series""", "series"))
def gold_health_index(spark, sf_dir):
    """The stored index after a second run, in which the features of one farm's last days had changed."""
    root = work_path(spark, "gold")
    rows = day_features(spark, sf_dir).withColumn("day", F.to_date("time_stamp"))
    late = (F.col("farm") == "B") & (F.col("day") >= F.lit("2024-01-20").cast("date"))
    wrong = {c: F.when(late, F.col(c) * 3 + 7).otherwise(F.col(c)) for c in DAILY}
    tables.overwrite_partitions(rows.withColumns(wrong), f"{root}/features", ["farm", "day"])
    gold.refresh_health(spark, spark.read.parquet(f"{root}/features"), DAILY, root)
    tables.overwrite_partitions(rows.where(late), f"{root}/features", ["farm", "day"])
    again = gold.refresh_health(spark, spark.read.parquet(f"{root}/features"), DAILY, root)
    found = spark.createDataFrame(again, "farm string, day date").select("farm", F.col("day").cast("timestamp").alias("day"))
    stored = rounded(spark.read.parquet(f"{root}/health"), ["health"])
    return stored.join(F.broadcast(found.withColumn("rewritten", F.lit(True))), ["farm", "day"], "left").select(
        "farm", "asset_id", "day", "health", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


@query("trend_candidates", sql(f"""
    SELECT farm, asset_id, count(*) AS n_days, count(health) AS n_present,
      CASE WHEN count(*) < {MIN_DAYS} THEN 'too few days' WHEN count(health) = 0 THEN 'no values' END AS skip_reason
    FROM series GROUP BY ALL""", "series"))
def trend_candidates(spark, sf_dir):
    return health.trend_candidates(health.health_series(day_features(spark, sf_dir), DAILY), MIN_DAYS)


FIT_SQL = f"""
    + grid AS (SELECT a, b, p FROM (VALUES (0.2::DOUBLE), (0.5), (0.8)) x(a), (VALUES (0.1::DOUBLE), (0.3)) y(b), (VALUES (0.8::DOUBLE), (0.9), (0.98)) z(p)),
    ser AS MATERIALIZED (SELECT * FROM series WHERE n_days >= {MIN_DAYS}),
    fold(farm, asset_id, n_days, a, b, p, pos, level, trend, sse) AS (
      SELECT farm, asset_id, n_days, a, b, p, 1::BIGINT, health, 0.0::DOUBLE, 0.0::DOUBLE FROM ser, grid WHERE pos = 1 AND health IS NOT NULL
      UNION ALL
      SELECT f.farm, f.asset_id, f.n_days, f.a, f.b, f.p, s.pos,
        f.a * s.health + (1 - f.a) * (f.level + f.p * f.trend),
        f.b * ((f.a * s.health + (1 - f.a) * (f.level + f.p * f.trend)) - f.level) + (1 - f.b) * f.p * f.trend,
        f.sse + pow(s.health - (f.level + f.p * f.trend), 2)
      FROM fold f JOIN ser s ON s.farm = f.farm AND s.asset_id = f.asset_id AND s.pos = f.pos + 1),
    fits AS (SELECT * FROM fold WHERE pos = n_days
      QUALIFY row_number() OVER (PARTITION BY farm, asset_id ORDER BY round(sse, 9), a, b, p) = 1)"""


def fits(spark, sf_dir):
    series = health.health_series(day_features(spark, sf_dir), DAILY)
    return health.trend_fit(health.series_arrays(series, MIN_DAYS))


@query("trend_fit", sql(f"""{FIT_SQL}
    SELECT farm, asset_id, n_days, a AS alpha, b AS beta, p AS phi, round(level, 6) AS level, round(trend, 6) AS trend,
      round(sqrt(sse / n_days), 6) AS fit_rmse FROM fits""", "series", recursive=True))
def trend_fit(spark, sf_dir):
    return rounded(fits(spark, sf_dir), ["level", "trend", "fit_rmse"])


@query("trend_optimum", sql(f"""{FIT_SQL}
    SELECT farm, asset_id, n_days, round(sqrt(sse / n_days), 6) AS grid_rmse, true AS no_worse, true AS inside FROM fits""",
    "series", recursive=True))
def trend_optimum(spark, sf_dir):
    """The optimiser next to the grid: its error is never above the grid's, its parameters are in their box."""
    series = health.health_series(day_features(spark, sf_dir), DAILY)
    arrays = fv.stored(spark, health.series_arrays(series, MIN_DAYS), "series")
    best = health.trend_optimum(arrays).select(*health.ASSET, "alpha", "beta", "phi", F.col("fit_rmse").alias("best"))
    inside = F.col("alpha").between(0, 1) & F.col("beta").between(0, 1) & F.col("phi").between(0.8, 0.98)
    return health.trend_fit(arrays).select(*health.ASSET, "n_days", "fit_rmse").join(best, health.ASSET).select(
        *health.ASSET, "n_days", F.round("fit_rmse", 6).alias("grid_rmse"),
        (F.col("best") <= F.col("fit_rmse") + 1e-9).alias("no_worse"), inside.alias("inside"))


@query("trend_forecast", sql(f"""{FIT_SQL}
    SELECT farm, asset_id, h AS day_ahead, round(level + trend * p * (1 - pow(p, h)) / (1 - p), 6) AS value
    FROM fits, generate_series(1, 14) g(h)""", "series", recursive=True))
def trend_forecast(spark, sf_dir):
    f = health.trend_forecast(fits(spark, sf_dir))
    return f.select("farm", "asset_id", F.posexplode("forecast").alias("pos", "value")).select(
        "farm", "asset_id", (F.col("pos") + 1).alias("day_ahead"), F.round("value", 6).alias("value"))


@query("fit_rmse", sql("""
    SELECT farm, asset_id, round(sqrt(avg(pow(sensor_1_avg - sensor_2_avg, 2))), 6) AS rmse FROM scada GROUP BY ALL""", "scada"))
def fit_rmse(spark, sf_dir):
    """Error of one sensor as a fit of another."""
    return rounded(health.fit_rmse(fv.scada(spark, sf_dir), ["farm", "asset_id"], "sensor_1_avg", "sensor_2_avg"), ["rmse"])


@query("median_impute", sql("""
    SELECT id, round(coalesce(sensor_4_avg, (SELECT median(sensor_4_avg) FROM scada)), 6) AS sensor_4_avg,
      coalesce(sensor_3, (SELECT median(sensor_3) FROM scada)) AS sensor_3 FROM scada""", "scada"))
def median_impute(spark, sf_dir):
    rows = fv.scada(spark, sf_dir).select("id", "sensor_3", "sensor_4_avg")
    medians = learning.exact_medians(rows, ["sensor_3", "sensor_4_avg"])
    return rounded(learning.imputed(rows, medians), ["sensor_4_avg"])


@query("stratified_split", sql("""
    SELECT id, status_type_id AS label, row_number() OVER (PARTITION BY status_type_id ORDER BY md5('42|' || id))
      <= (count(*) OVER (PARTITION BY status_type_id) * 20 + 99) // 100 AS is_test FROM scada""", "scada"))
def stratified_split(spark, sf_dir):
    rows = fv.scada(spark, sf_dir).select("id", F.col("status_type_id").alias("label"))
    return learning.split_flag(rows, ["id"])


@query("class_inventory", sql("""
    SELECT label, n_rows, row_number() OVER (ORDER BY label) - 1 AS class_index FROM (
      SELECT coalesce(c.category, 'healthy') AS label, count(*) AS n_rows FROM tagged t
      LEFT JOIN (SELECT DISTINCT farm, event_id, category FROM faults) c ON t.farm = c.farm AND t.event_id = c.event_id
      GROUP BY ALL)""", "tagged", "faults"))
def class_inventory(spark, sf_dir):
    labelled = faults.labelled_features(fv.tagged(spark, sf_dir), fv.stored_faults(spark, sf_dir))
    return learning.class_inventory(labelled)


@query("trainable_gate", sql("""
    SELECT component, count(DISTINCT label) AS n_classes, count(hours) AS n_rul_rows,
      CASE WHEN count(DISTINCT label) < 2 THEN 'only one class present' END AS skip_classifier,
      CASE WHEN count(hours) = 0 THEN 'no rows before an event' WHEN count(hours) < 10 THEN 'too few rows to split' END AS skip_quantiles
    FROM (SELECT "turbineId" AS component, CASE WHEN "faultProbability" > 0.97 THEN 'fault' ELSE 'healthy' END AS label,
      CASE WHEN "rulHoursP50" < 10 THEN "rulHoursP50" END AS hours FROM predictions) GROUP BY component""", "predictions"))
def trainable_gate(spark, sf_dir):
    """Which groups of predictions would make a training set."""
    rows = fv.predictions(spark, sf_dir).select(
        F.col("turbineId").alias("component"),
        F.when(F.col("faultProbability") > 0.97, "fault").otherwise("healthy").alias("label"),
        F.when(F.col("rulHoursP50") < 10, F.col("rulHoursP50")).alias("hours_to_failure"),
    )
    return learning.trainable(rows)


def guesses(spark, sf_dir):
    """Statuses and a guess at them from the code."""
    code = F.floor(F.col("sensor_2_avg") / 20)
    return fv.scada(spark, sf_dir).select(
        F.col("status_type_id").cast("string").alias("label"), code.cast("string").alias("prediction"))


REPORT_SQL = """
    SELECT c.class, coalesce(hits / nullif(called, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
      coalesce(2 * hits / nullif(called + support, 0), 0) AS f1, support FROM (
      SELECT k.class, count(*) FILTER (g.label = k.class AND g.prediction = k.class)::DOUBLE AS hits,
        count(*) FILTER (g.prediction = k.class) AS called, count(*) FILTER (g.label = k.class) AS support
      FROM (SELECT DISTINCT CAST(status_type_id AS VARCHAR) AS class FROM scada UNION
        SELECT DISTINCT CAST(CAST(floor(sensor_2_avg / 20) AS INTEGER) AS VARCHAR) FROM scada) k,
      (SELECT CAST(status_type_id AS VARCHAR) AS label, CAST(CAST(floor(sensor_2_avg / 20) AS INTEGER) AS VARCHAR) AS prediction FROM scada) g
      GROUP BY k.class) c"""


@query("classification_report", sql(f"""
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({REPORT_SQL})""", "scada"))
def classification_report(spark, sf_dir):
    return rounded(learning.classification_report(guesses(spark, sf_dir)), ["precision", "recall", "f1"])


@query("macro_f1", sql(f"SELECT round(avg(f1), 6) AS macro_f1 FROM ({REPORT_SQL})", "scada"))
def macro_f1(spark, sf_dir):
    return rounded(learning.macro_f1(guesses(spark, sf_dir)), ["macro_f1"])


@query("pinball_loss", sql("""
    SELECT farm, """ + ", ".join(
    f"round(avg(greatest({a} * (sensor_1_avg - sensor_2_avg), ({a} - 1) * (sensor_1_avg - sensor_2_avg))), 6) AS {n}"
    for n, a in QUANTILES.items()) + " FROM scada GROUP BY farm", "scada"))
def pinball_loss(spark, sf_dir):
    losses = [F.round(F.avg(learning.pinball("sensor_1_avg", "sensor_2_avg", a)), 6).alias(n) for n, a in QUANTILES.items()]
    return fv.scada(spark, sf_dir).groupBy("farm").agg(*losses)


def stored_features(spark, sf_dir):
    """Gold features as a table: models read them many times over."""
    from vanewatch.session import work_path
    from vanewatch.sources.tables import overwrite

    path = work_path(spark, "features")
    overwrite(fv.features(spark, sf_dir), path, ["farm"])
    return spark.read.parquet(path)


@query("fault_classifier")
def fault_classifier(spark, sf_dir):
    """Held-out rows with their label, the predicted class and the fault probability."""
    f = stored_features(spark, sf_dir)
    labelled = faults.labelled_features(f, fv.stored_faults(spark, sf_dir))
    model, scored = learning.fit_classifier(labelled, sensors.feature_columns(f), training.KEYS)
    return scored.select(*training.KEYS, "label", "prediction", model.fault_probability().alias("fault_probability"))


@query("classifier_checks", sql("""
    SELECT label, is_test, count(*) AS n_rows, true AS sums_to_one, true AS likeliest, true AS known_class FROM (
      SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id))
        <= (count(*) OVER (PARTITION BY label) * 20 + 99) // 100 AS is_test
      FROM (SELECT id, CASE WHEN sensor_2_avg > 60 THEN 'high' WHEN sensor_1_avg > 50 THEN 'mid' ELSE 'healthy' END AS label FROM scada))
    WHERE is_test GROUP BY ALL""", "scada"))
def classifier_checks(spark, sf_dir):
    """What every fitted classifier must hold on the rows it has not seen, counted per class."""
    rows = fv.scada(spark, sf_dir).withColumn(
        "label", F.when(F.col("sensor_2_avg") > 60, "high").when(F.col("sensor_1_avg") > 50, "mid").otherwise("healthy"))
    columns = ["sensor_1_avg", "sensor_2_avg", "sensor_4_avg"]
    model, scored = learning.fit_classifier(rows.select("id", "label", *columns), columns, ["id"], ROUNDS, depth=DEPTH)
    p, names = F.col("class_probability"), F.array(*[F.lit(c) for c in model.classes])
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    at = F.array_position(names, F.col("prediction")).cast("int")
    return scored.groupBy("label", "is_test").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.every((F.abs(total - 1) < 1e-9) & (F.array_min(p) >= 0)).alias("sums_to_one"),
        F.every(F.element_at(p, at) == F.array_max(p)).alias("likeliest"),
        F.every(at > 0).alias("known_class"))


@query("rul_quantile")
def rul_quantile(spark, sf_dir):
    """Held-out rows with their hours to failure and the three predicted quantiles."""
    f = stored_features(spark, sf_dir)
    labels = rul.rul_labels(fv.tagged(spark, sf_dir), fv.stored_faults(spark, sf_dir))
    labelled = rul.labelled_for_rul(f, labels)
    _, scored = learning.fit_rul(labelled, sensors.feature_columns(f), training.KEYS, QUANTILES)
    return scored.select(*training.KEYS, "hours_to_failure", "rul_p10", "rul_p50", "rul_p90")


@query("rul_checks", sql("""
    SELECT (count(*) * 20 + 99) // 100 AS n_rows, true AS ordered, true AS outer_shares, true AS beats_a_constant
    FROM scada WHERE sensor_1_avg IS NOT NULL""", "scada"))
def rul_checks(spark, sf_dir):
    """What fitted quantiles must hold on the rows they have not seen: order, shares and a lower loss than one number."""
    rows = fv.scada(spark, sf_dir).where("sensor_1_avg IS NOT NULL").select(
        "id", (F.col("sensor_1_avg") + F.col("sensor_2_avg") * 3).alias("hours_to_failure"), "sensor_2_avg", "sensor_4_avg")
    _, scored = learning.fit_rul(rows, ["sensor_2_avg", "sensor_4_avg"], ["id"], QUANTILES)
    middle = scored.agg(F.median("hours_to_failure").alias("m"))
    actual = F.col("hours_to_failure")
    loss = F.avg(learning.pinball("hours_to_failure", "rul_p50", 0.5))
    return scored.crossJoin(F.broadcast(middle)).agg(  # one row
        F.count(F.lit(1)).alias("n_rows"),
        F.every((F.col("rul_p10") <= F.col("rul_p50")) & (F.col("rul_p50") <= F.col("rul_p90"))).alias("ordered"),
        (F.avg((actual <= F.col("rul_p90")).cast("int")).between(0.8, 1.0)
         & F.avg((actual <= F.col("rul_p10")).cast("int")).between(0.0, 0.2)).alias("outer_shares"),
        (loss < F.avg(learning.pinball("hours_to_failure", "m", 0.5))).alias("beats_a_constant"))


def trained(spark, sf_dir):
    f = stored_features(spark, sf_dir)
    fault_table = fv.stored_faults(spark, sf_dir)
    labels = rul.rul_labels(fv.tagged(spark, sf_dir), fault_table)
    return f, training.train_component(f, fault_table, labels, "gearbox", MIN_DAYS)


@query("batch_score")
def batch_score(spark, sf_dir):
    """One prediction row per turbine, with its forecast as JSON."""
    f, models = trained(spark, sf_dir)
    as_of = F.lit("2024-02-01").cast("timestamp")
    rows = training.score(f, models, "gearbox", fv.ranks(spark, sf_dir), as_of)
    return rows.withColumn("forecastSeries", F.to_json("forecastSeries"))


@query("training_report")
def training_report(spark, sf_dir):
    _, models = trained(spark, sf_dir)
    return models.report.withColumn("params", F.to_json("params"))


@query("fault_probability", sql("""
    SELECT id, round(1 - sensor_2_avg / 100, 4) AS fault_probability FROM scada""", "scada"))
def fault_probability(spark, sf_dir):
    """One minus the healthy share of a class distribution, here made from the code."""
    healthy = F.col("sensor_2_avg") / 100
    model = learning.FaultClassifier(["fault", "healthy"], None, {}, [])
    rows = fv.scada(spark, sf_dir).select("id", F.array(1 - healthy, healthy).alias("class_probability"))
    return rows.select("id", model.fault_probability().alias("fault_probability"))
