"""The jobs of a fleet from landed files to alerts, called in order.

Landing folder::

    farm=A/turbine=17/*.csv          readings
    farm=A/event_info/*.csv          labelled events
    feature_description/farm=A/*.csv sensor descriptions

Every job can be run again; bronze and silver only handle what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanewatch.domain import (
    COMPONENT_KEYWORDS, FARMS, META_COLUMNS, MIN_TREND_DAYS, RUL_HORIZON_HOURS, TRAINING_OTHER,
    TRAINING_TAXONOMY,
)
from vanewatch.functions.taxonomy import Taxonomy
from vanewatch.operators import cleaning, faults, learning, rolling, rul, sensors, serving, tagging
from vanewatch.operators.alerting import evaluated
from vanewatch.operators.joins import broadcast_within
from vanewatch.plans import training
from vanewatch.schemas import ALERT_CONFIG, FAULT_EVENTS, RUL_LABELS
from vanewatch.sources import files, tables
from vanewatch.streaming.ingest import ingest_evolving, stored_schema, table_schema, upsert_silver
from vanewatch.streaming.gold import isolated, refresh_health
from vanewatch.streaming.state import upsert_keyed


@dataclass
class Fleet:
    """Where a fleet's files and tables are and how its data is to be read."""

    spark: SparkSession
    landing: str
    lake: str
    farms: list[str] = field(default_factory=lambda: list(FARMS))
    source_tz: str = "UTC"
    tag_by: Sequence[str] = ("farm",)
    components: Taxonomy = field(default_factory=lambda: dict(COMPONENT_KEYWORDS))
    taxonomy: Taxonomy = field(default_factory=lambda: dict(TRAINING_TAXONOMY))
    other: str = TRAINING_OTHER
    qualify_sensors: bool = False

    def path(self, *parts: str) -> str:
        return "/".join([self.lake.rstrip("/"), *parts])

    def read(self, *parts: str, schema: str | None = None) -> DataFrame | None:
        path = self.path(*parts)
        if tables.exists(self.spark, tables.schema_path(path)):
            return tables.read_evolving(self.spark, path)
        return tables.read_table(self.spark, path, schema, merge=True)

    def events(self, farm: str) -> DataFrame:
        raw = files.scan_event_info(self.spark, f"{self.landing}/farm={farm}/event_info/*.csv")
        return tagging.parsed_events(raw.withColumn("farm", F.lit(farm)), self.source_tz)

    def descriptions(self, farm: str) -> DataFrame:
        path = f"{self.landing}/feature_description/farm={farm}/*.csv"
        return files.scan_feature_description(self.spark, path)


def bronze(fleet: Fleet, farm: str) -> None:
    ingest_evolving(
        fleet.spark, fleet.landing, farm, fleet.path("bronze", farm), fleet.path("schemas", farm),
        fleet.path("checkpoints", "bronze", farm),
    )


def silver(fleet: Fleet, farm: str) -> None:
    """Clean, tag and upsert the new bronze rows, then renew the farm's id map."""
    known = stored_schema(fleet.spark, fleet.path("schemas", farm))
    if known is None:
        return
    schema = T.StructType([f for f in table_schema(known) if f.name != "_batch"])
    events = fleet.events(farm).withColumn("file_event_id", F.col("event_id").try_cast("int"))
    upsert_silver(
        fleet.spark, fleet.path("bronze", farm), schema, events, fleet.path("silver", farm),
        fleet.path("checkpoints", "silver", farm), fleet.source_tz, fleet.tag_by,
    )
    ids = serving.turbine_ranks(fleet.read("silver", farm))
    tables.overwrite_partitions(ids, fleet.path("turbine_ids"), ["farm"])


def component_columns(fleet: Fleet, farm: str, component: str, rows: DataFrame) -> list[str]:
    words = {component: fleet.components[component]}
    wanted = sensors.component_sensors(fleet.descriptions(farm), words)
    return sensors.column_list(sensors.resolved_columns(wanted, rows))


def _farm_features(fleet: Fleet, farm: str, component: str, rows: DataFrame) -> DataFrame | None:
    columns = component_columns(fleet, farm, component, rows)
    if not columns:
        return None
    out = rolling.rolling_features(rows, columns, [*META_COLUMNS, "day"])
    if fleet.qualify_sensors:
        out = cleaning.qualified(out, farm, sensors.feature_columns(out))
    return out


def features(fleet: Fleet, component: str) -> None:
    """Rolling features of one component over all farms that have its sensors."""
    found = []
    for farm in fleet.farms:
        rows = fleet.read("silver", farm)
        out = None if rows is None else _farm_features(fleet, farm, component, rows)
        if out is not None:
            found.append(out)
    if found:
        target = fleet.path("features", component)
        tables.overwrite(cleaning.union_farms(found), target, ["farm", "day"])


def refresh_features(fleet: Fleet, component: str, farm: str, changed: DataFrame) -> None:
    """Recompute only the days that changed readings (farm, asset, time) can influence.

    A day needs the readings of the day before for its windows; days are few, so the two day
    lists are small and prune the partitions of silver.
    """
    days = rolling.recompute_scope(changed).select("day").distinct()
    needed = days.select(F.explode(F.array("day", F.date_sub("day", 1))).alias("day")).distinct()
    rows = fleet.read("silver", farm).join(broadcast_within(needed), "day", "left_semi")
    out = _farm_features(fleet, farm, component, rows)
    if out is not None:
        due = out.join(broadcast_within(days), "day", "left_semi")
        tables.overwrite_partitions(due, fleet.path("features", component), ["farm", "day"])


def fault_events(fleet: Fleet) -> None:
    found = []
    for farm in fleet.farms:
        rows = fleet.read("silver", farm)
        if rows is not None:
            found.append(faults.fault_events(
                fleet.events(farm), faults.event_assets(rows), fleet.taxonomy, fleet.other))
    if found:
        tables.overwrite(cleaning.union_farms(found, evolving=False), fleet.path("fault_events"))


def rul_labels(fleet: Fleet, horizon_hours: int = RUL_HORIZON_HOURS) -> None:
    events = fleet.read("fault_events", schema=FAULT_EVENTS)
    rows = [r.select("farm", "asset_id", "time_stamp", "event_id")
            for r in (fleet.read("silver", f) for f in fleet.farms) if r is not None]
    if rows:
        labels = rul.rul_labels(cleaning.union_farms(rows), events, horizon_hours)
        tables.overwrite(labels, fleet.path("rul_labels"), ["farm"])


def serving_readings(fleet: Fleet) -> DataFrame | None:
    """The bounded long table behind telemetry reads: the prediction slice of all components."""
    ids = fleet.read("turbine_ids")
    found = []
    for farm in fleet.farms:
        rows = fleet.read("silver", farm)
        if rows is None:
            continue
        columns = sorted({c for comp in fleet.components for c in component_columns(fleet, farm, comp, rows)})
        if columns:
            found.append(serving.sensor_readings(rows, ids, columns))
    if not found:
        return None
    tables.write_serving(cleaning.union_farms(found), fleet.path("sensor_readings"))
    return fleet.read("sensor_readings")


def train(
    fleet: Fleet, rounds: int = learning.ROUNDS, depth: int = learning.MAX_DEPTH,
    min_days: int = MIN_TREND_DAYS,
) -> None:
    """Train and save the models of each component that has features, and keep the metrics."""
    events = fleet.read("fault_events", schema=FAULT_EVENTS)
    labels = fleet.read("rul_labels", schema=RUL_LABELS)

    def one(component: str) -> None:
        table = fleet.read("features", component)
        if table is not None:
            models = training.train_component(table, events, labels, component, min_days, rounds, depth)
            models.save(fleet.spark, fleet.path("models", component))
            tables.overwrite(models.report, fleet.path("training_report", f"component={component}"))

    return _apart(fleet, "train", one)


def _apart(fleet: Fleet, job: str, work: Callable[[str], None]) -> DataFrame:
    """``work`` for each component, isolated from the others; the stored outcome of each."""
    outcomes = isolated(fleet.spark, job, fleet.components, work)
    tables.overwrite(outcomes.drop("job"), fleet.path("outcomes", f"job={job}"))
    return outcomes


def predict(fleet: Fleet, as_of: Column) -> DataFrame:
    """Score every turbine's latest features with the saved models; the outcome per component.

    A component that lacks one of its models gets no predictions. One that fails leaves the
    others' predictions and its own former ones.
    """
    ids = fleet.read("turbine_ids")

    def one(component: str) -> None:
        table = fleet.read("features", component)
        saved = fleet.path("models", component)
        if table is not None and tables.exists(fleet.spark, saved):
            models = training.ComponentModels.load(fleet.spark, saved)
            scored = training.score(table, models, component, ids, as_of)
            tables.overwrite(scored.drop("component"), fleet.path("predictions", f"component={component}"))

    return _apart(fleet, "predict", one)


def health_index(fleet: Fleet, component: str) -> list[tuple]:
    """Bring the component's gold health index up to date; the (farm, day) pairs that were due."""
    path = fleet.path("features", component)
    if not tables.exists(fleet.spark, path):
        return []
    table = fleet.spark.read.parquet(path)
    return refresh_health(fleet.spark, table, sensors.day_average_columns(table), fleet.path("gold_health", component))


def alerts(fleet: Fleet, as_of: Column, config: DataFrame | None = None) -> None:
    """Evaluate the latest predictions and keep the alerts by turbine and component."""
    predictions = fleet.read("predictions")
    if predictions is None:
        return
    if config is None:
        config = fleet.spark.createDataFrame([], ALERT_CONFIG)
    found = evaluated(predictions.withColumn("predicted_at", as_of), config, "predicted_at")
    upsert_keyed(found, fleet.path("alerts"), ["id"], [F.col("createdAt").desc()])


def run(fleet: Fleet, as_of: Column, **training_options: int) -> DataFrame:
    """All jobs once; returns how training and scoring of each component went."""
    for farm in fleet.farms:
        bronze(fleet, farm)
        silver(fleet, farm)
    for component in fleet.components:
        features(fleet, component)
        health_index(fleet, component)
    fault_events(fleet)
    rul_labels(fleet)
    serving_readings(fleet)
    outcomes = train(fleet, **training_options).unionByName(predict(fleet, as_of))
    alerts(fleet, as_of)
    return outcomes
