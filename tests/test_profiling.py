"""Correlations and medians of many columns at once, against numpy."""

import numpy as np
import pytest

from vanewatch.operators import learning, profiling


def wide(spark, n, width, seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + rng.normal(size=(n, 1)) + offset
    x[rng.random((n, width)) < 0.1] = np.nan
    x[:, width - 1] = 4.0
    farms = ["A" if i % 3 else "B" for i in range(n)]
    rows = [(f, *[None if np.isnan(v) else float(v) for v in r]) for f, r in zip(farms, x)]
    names = [f"s{i}" for i in range(width)]
    schema = "farm string, " + ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(rows, schema).repartition(3), names, np.array(farms), x


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_correlation_of_present_pairs(spark, monkeypatch, offset):
    monkeypatch.setattr(profiling, "GRAM_BLOCK", 3)
    df, names, farms, x = wide(spark, 240, 8, offset=offset)
    got = {(r.farm, r.sensor_a, r.sensor_b): r["corr"] for r in profiling.correlation(df, names).collect()}
    assert len(got) == 2 * 28
    for (farm, a, b), value in got.items():
        u, v = x[farms == farm][:, int(a[1:])], x[farms == farm][:, int(b[1:])]
        both = ~np.isnan(u) & ~np.isnan(v)
        if b == "s7":
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-6)


def test_plan_does_not_grow_with_the_pairs(spark):
    df, names, _, _ = wide(spark, 60, 300)
    out = profiling.correlation(df, names)
    assert out.count() == 2 * 300 * 299 // 2
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_medians_of_many_columns(spark):
    df, names, _, x = wide(spark, 501, 40, seed=3)
    heavy = df.withColumn("tied", df["s0"] * 0 + 7)
    got = learning.exact_medians(heavy, [*names, "tied"])
    for i, c in enumerate(names):
        assert got[c] == pytest.approx(np.nanmedian(x[:, i]), abs=0)
    assert got["tied"] == 7.0
    assert learning.exact_medians(df.where("false"), names[:2]) == {"s0": None, "s1": None}
