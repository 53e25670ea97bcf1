"""Boundary cases of cleaning, tagging, rolling windows and labels."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vanewatch.operators import cleaning, rolling, rul, tagging
from vanewatch.operators.ranking import every_nth, first_share, newest_per_key, numbered

T0 = datetime(2024, 1, 1)
EVENT = "farm string, asset_id bigint, event_id string, event_label string, event_description string, event_start timestamp, event_end timestamp"


def at(hours=0.0, seconds=0.0):
    return T0 + timedelta(hours=hours, seconds=seconds)


def rows_at(spark, clocks, asset=1):
    return spark.createDataFrame(
        [("A", asset, t, i) for i, t in enumerate(clocks)], "farm string, asset_id bigint, time_stamp timestamp, id bigint"
    )


def events_of(spark, spans, asset=1):
    return spark.createDataFrame(
        [("A", asset, str(n), "anomaly", "text", a, b) for n, (a, b) in spans.items()], EVENT
    )


def test_bad_rows_are_dropped_without_failing(spark):
    raw = spark.createDataFrame(
        [("A", 1, "2024-01-01 00:00:00", "0"), ("A", 1, "2024-01-01 00:10:00", "7"), ("A", 1, "2024-01-01 00:20:00", "x"),
         ("A", 1, None, "0"), ("A", 1, "bad", "0"), ("A", None, "2024-01-01 00:30:00", "0")],
        "farm string, asset_id bigint, time_stamp string, status_type_id string",
    ).withColumns({"_ingested_at": F.current_timestamp(), "_source_file": F.lit("f")})
    out = cleaning.clean(raw).collect()
    assert [(r.time_stamp, r.status_type_id) for r in out] == [(T0, 0)]


def test_zone_conversion(spark):
    raw = spark.createDataFrame([("2024-07-01 12:00:00",), ("2024-01-01 12:00:00",)], "time_stamp string")
    got = {r.time_stamp for r in cleaning.with_utc_clock(raw, "Europe/Berlin").collect()}
    assert got == {datetime(2024, 7, 1, 10), datetime(2024, 1, 1, 11)}


def test_newest_reading_wins_and_files_break_ties(spark):
    df = spark.createDataFrame(
        [("A", 1, T0, at(1), "a", 1.0), ("A", 1, T0, at(2), "a", 2.0), ("A", 1, T0, at(2), "b", 3.0)],
        "farm string, asset_id bigint, time_stamp timestamp, _ingested_at timestamp, _source_file string, v double",
    )
    once = cleaning.newest_reading(df)
    assert [r.v for r in once.collect()] == [3.0]
    assert cleaning.newest_reading(once).collect() == once.collect()


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_window_ends_belong_to_the_event(spark, limit):
    rows = rows_at(spark, [at(9.99), at(10), at(11), at(12), at(12.01)])
    out = tagging.tag_events(rows, events_of(spark, {7: (at(10), at(12))}), broadcast_bytes=limit)
    assert [r.event_id for r in out.orderBy("id").collect()] == [None, "7", "7", "7", None]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_overlaps_go_to_the_earliest_start_then_lowest_id(spark, limit):
    spans = {"b": (at(0), at(50)), "a": (at(0), at(30)), "c": (at(20), at(90)), "d": (at(25), at(26))}
    rows = rows_at(spark, [at(1), at(30), at(30.5), at(50), at(51), at(90), at(91)])
    out = tagging.tag_events(rows, events_of(spark, spans), broadcast_bytes=limit)
    assert [r.event_id for r in out.orderBy("id").collect()] == ["a", "a", "b", "b", "c", "c", None]


def test_strict_tagging_looks_at_the_asset(spark):
    events = events_of(spark, {7: (at(0), at(5))}, asset=2)
    rows = rows_at(spark, [at(1)])
    assert tagging.tag_events(rows, events).first().event_id is None
    assert tagging.tag_events(rows, events, by=["farm"]).first().event_id == "7"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    spans=st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 1500)), min_size=1, max_size=12),
    clocks=st.lists(st.integers(0, 3600), min_size=1, max_size=12, unique=True),
)
def test_tagging_agrees_with_brute_force(spark, spans, clocks):
    events = {f"{i:02d}": (at(a), at(a + d)) for i, (a, d) in enumerate(spans)}
    out = tagging.tag_events(rows_at(spark, [at(c) for c in clocks]), events_of(spark, events))
    got = {r.time_stamp: r.event_id for r in out.collect()}
    assert out.count() == len(clocks)
    for c in clocks:
        over = [(a, i) for i, (a, b) in events.items() if a <= at(c) <= b]
        assert got[at(c)] == (min(over)[1] if over else None)


def test_rul_boundaries(spark):
    events = events_of(spark, {"1": (at(1000), at(1001))})
    rows = rows_at(spark, [at(1000), at(280), at(279.99), at(999)])
    for limit in (0, 1 << 20):
        out = {r.id: r.hours_to_failure for r in rul.next_failure(rows, events, 720, limit).collect()}
        assert out == {1: 720.0, 3: 1.0}


def test_rul_takes_the_nearest_event(spark):
    events = events_of(spark, {"far": (at(50), at(60)), "near": (at(10), at(12)), "same": (at(10), at(11))})
    out = rul.next_failure(rows_at(spark, [at(0), at(10), at(11)]), events).orderBy("id").collect()
    assert [(r.next_event_id, r.hours_to_failure) for r in out] == [("near", 10.0), ("far", 40.0), ("far", 39.0)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(starts=st.lists(st.integers(0, 3000), min_size=1, max_size=15), clocks=st.lists(st.integers(0, 3000), min_size=1, max_size=10, unique=True))
def test_rul_agrees_with_brute_force(spark, starts, clocks):
    events = events_of(spark, {f"{i:02d}": (at(s), at(s + 1)) for i, s in enumerate(starts)})
    out = rul.next_failure(rows_at(spark, [at(c) for c in clocks]), events, 720).collect()
    want = {}
    for c in clocks:
        later = [(s, f"{i:02d}") for i, s in enumerate(starts) if c < s <= c + 720]
        if later:
            want[at(c)] = (min(later)[1], float(min(later)[0] - c))
    assert {r.time_stamp: (r.next_event_id, r.hours_to_failure) for r in out} == want


def test_rul_joins_features_although_their_event_id_is_null(spark):
    features = rows_at(spark, [at(0)]).withColumn("event_id", F.lit(None).cast("string"))
    labels = rul.next_failure(features.drop("event_id"), events_of(spark, {"1": (at(5), at(6))}))
    out = rul.labelled_for_rul(features, labels).collect()
    assert [r.hours_to_failure for r in out] == [5.0]


def test_rul_is_looked_up_on_feature_rows(spark):
    features = rows_at(spark, [at(0), at(1), at(7)]).withColumn("event_id", F.when(F.col("id") == 1, "0"))
    out = rul.labelled_features(features, events_of(spark, {"1": (at(5), at(6))})).collect()
    assert [(r.id, r.hours_to_failure) for r in out] == [(0, 5.0)]


def features_of(spark, clocks, values, **options):
    df = rows_at(spark, clocks).withColumn("v", F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") + 1).cast("int")))
    keep = ["farm", "asset_id", "time_stamp", "id"]
    return rolling.rolling_features(df, ["v"], keep, **options).orderBy("id").collect()


@pytest.mark.parametrize("dense", [0, 10**9])
def test_frame_edge_is_included(spark, dense):
    out = features_of(spark, [at(0), at(seconds=3600), at(seconds=3601)], [1.0, 3.0, 5.0], dense_rows=dense)
    assert [r.v_avg_1h for r in out] == [1.0, 2.0, 4.0]
    assert out[0].v_std_1h is None and abs(out[1].v_std_1h - 2**0.5) < 1e-12


@pytest.mark.parametrize("dense", [0, 10**9])
def test_frames_reach_over_chunk_borders(spark, dense):
    clocks = [at(10 * i) for i in range(40)]
    out = features_of(spark, clocks, [float(i) for i in range(40)], chunk_hours=24, dense_rows=dense)
    assert len(out) == 40
    for i, r in enumerate(out):
        window = [float(j) for j in range(max(0, i - 2), i + 1)]
        assert abs(r.v_avg_24h - sum(window) / len(window)) < 1e-9


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 200_000), st.one_of(st.none(), st.floats(-100, 100))), min_size=1, max_size=40))
def test_dense_path_equals_sliding_path(spark, points):
    df = spark.createDataFrame(
        [("A", 1, at(seconds=t), i, v) for i, (t, v) in enumerate(points)],
        "farm string, asset_id bigint, time_stamp timestamp, id bigint, v double")
    keep = ["farm", "asset_id", "time_stamp", "id"]
    a, b = (rolling.rolling_features(df, ["v"], keep, dense_rows=n).orderBy("id").collect() for n in (0, 10**9))
    assert len(a) == len(b) == len(points)
    for x, y in zip(a, b):
        for column in ("v_avg_1h", "v_std_1h", "v_avg_24h", "v_std_24h"):
            assert (x[column] is None) == (y[column] is None)
            assert x[column] is None or abs(x[column] - y[column]) < 1e-5


def test_recompute_scope_reaches_into_the_next_day(spark):
    out = rolling.recompute_scope(rows_at(spark, [at(12)])).collect()
    assert sorted(str(r.day) for r in out) == ["2024-01-01", "2024-01-02"]


def test_numbers_run_across_buckets(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    out = numbered(df, ["g"], F.floor(F.col("id") / 7), ["id"], "n").collect()
    assert all(r.n == (r.id + 1 if r.g == "hot" else r.id - 899) for r in out)


def test_every_nth_starts_with_the_first_row(spark):
    df = spark.range(10, 30).withColumn("f", F.lit("x"))
    assert [r.id for r in every_nth(df, ["f"], "id", 8, bucket_rows=5).orderBy("id").collect()] == [10, 18, 26]


def test_share_is_exact_and_repeatable(spark):
    df = spark.range(1003).withColumn("label", F.when(F.col("id") < 1000, "a").otherwise("b"))
    first = first_share(df, "label", ["id"], 20, "42", "t", digits=2)
    counts = {r.label: r.n for r in first.groupBy("label").agg(F.count_if("t").alias("n")).collect()}
    assert counts == {"a": 200, "b": 1}
    again = first_share(df.repartition(7), "label", ["id"], 20, "42", "t", digits=3)
    assert first.where("t").select("id").exceptAll(again.where("t").select("id")).isEmpty()


def test_copies_are_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = newest_per_key(df, ["k"], [F.col("id").desc()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_one_nan_spoils_only_its_own_windows(spark):
    clocks = [at(seconds=600 * i) for i in range(100)]
    values = [float("nan") if i == 50 else float(i % 7) for i in range(100)]
    counts = []
    for dense in (0, 10**9):
        out = features_of(spark, clocks, values, dense_rows=dense)
        counts.append(sum(r["v_std_1h"] is not None and r["v_std_1h"] != r["v_std_1h"] for r in out))
    assert counts == [7, 7]


def test_null_groups_and_keys_are_numbered(spark):
    from vanewatch.operators.ranking import every_nth, numbered

    rows = [("f", 1), ("f", 2), (None, 1), (None, None), ("f", None)]
    df = spark.createDataFrame(rows, "file string, id long")
    got = numbered(df, ["file"], F.floor(F.col("id") / 10), ["id"], "n").collect()
    assert sorted((r.file or "", r.n) for r in got) == [("", 1), ("", 2), ("f", 1), ("f", 2), ("f", 3)]
    assert every_nth(df, ["file"], "id", 1).count() == 5
