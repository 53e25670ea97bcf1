"""How often training touches its rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from vanewatch.operators import boosting, learning


def test_a_round_evaluates_every_row_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(values: pd.Series) -> pd.Series:
        seen.add(len(values))
        return values

    plain = learning.QuantileModel.add_to
    monkeypatch.setattr(learning.QuantileModel, "add_to", lambda self, df, name: plain(self, df, name).withColumn(
        name, counted(name)))
    rows = learning.assembled(spark.range(200).selectExpr("CAST(id AS double) AS x", "CAST(id * 2 AS double) AS y"), ["x"])
    model, loss = learning.fit_quantile(rows.where("x % 5 > 0"), rows.where("x % 5 = 0"), "y", ["x"], {"x": 0.0}, 0.5, 3, 0.5, 2)
    assert len(model.trees) == 3 and loss < 50
    assert seen.value == 200 * 4  # before the first round and after each of three


def test_blocks_of_a_batch_are_read_in_place():
    rng = np.random.default_rng(0)
    bins, scores = rng.integers(0, 32, (40, 3)).astype(np.uint8), rng.random((40, 2))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(np.arange(40, dtype=np.int32)),
         pa.array(rng.random(40) < 0.5), pa.array(list(scores), pa.list_(pa.float64()))],
        ["bins", "target", "is_test", "scores"])
    for part, at in ((batch, slice(0, 40)), (batch.slice(7, 20), slice(7, 27))):
        got = boosting._matrix(part)
        assert (got[0] == bins[at]).all() and (got[3] == scores[at]).all() and got[1].tolist() == list(range(40))[at]
