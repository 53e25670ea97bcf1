"""Multi-class gradient boosting from histograms of binned features.

Columns are cut into bins once and the binned rows are written as a table. Every level of a round's
trees, one tree per class, is one pass: tasks add up gradients by (class, node, column, bin), Spark
sums them, and the best split of each node follows from running sums over the bins. Only the chosen
splits reach the driver. Trees are rows of arrays, so a model of any number of rounds is scored by
one expression. Running scores are kept with the rows, renewed every round and written every
``RENEW`` rounds. Rows that fit one task are fitted there, see ``one_task``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.operators import one_task
from vanewatch.operators.one_task import placed, probabilities
from vanewatch.session import work_path

BINS = 32
RENEW = 20
#: Keeps a leaf of nearly certain rows from taking an endless step.
DAMPING = 1e-3

ROWS = "bins binary, target int, is_test boolean, scores array<double>"
SUMS = "tree int, node int, feature int, bin int, g double, h double, n long"


@dataclass
class Trees:
    """``rounds`` x classes trees in heap order: node i leads to 2i + 1 and 2i + 2."""

    depth: int
    feature: list = field(default_factory=list)  # by round: classes x nodes, -1 for a leaf
    bin: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.feature)

    def cut(self, a: int, b: int) -> Trees:
        return Trees(self.depth, self.feature[a:b], self.bin[a:b], self.value[a:b])

    def added(self, bins: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """``scores`` (rows x classes) plus what the trees give for the binned rows."""
        scores = scores.copy()
        for feature, cut, value in zip(self.feature, self.bin, self.value):
            for k in range(scores.shape[1]):
                scores[:, k] += np.asarray(value[k])[placed(bins, feature[k], cut[k], self.depth)]
        return scores


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Increasing cut points of each column, from one pass of mergeable quantile sketches."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = df.agg(*[F.percentile_approx(f"`{c}`", shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [sorted({float(v) for v in found[f"c{i}"] or []}) for i in range(len(columns))]


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: how many cut points lie below it."""
    return np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


@dataclass
class Boosted:
    """Binned columns, the score every row starts from, and the trees."""

    edges: list[list[float]]
    base: list[float]
    trees: Trees

    def class_probability(self, features: Column) -> Column:
        """Probability of each class, from an array of the columns' values."""
        edges, base, trees = self.edges, np.array(self.base), self.trees

        @F.pandas_udf("array<double>")
        def evaluate(values: pd.Series) -> pd.Series:
            matrix = np.stack(values.to_numpy()) if len(values) else np.empty((0, len(edges)))
            scores = trees.added(binned(matrix, edges), np.tile(base, (len(values), 1)))
            return pd.Series(list(probabilities(scores)))

        return evaluate(features)

    def to_json(self) -> dict:
        listed = [[[np.asarray(x).tolist() for x in r] for r in part] for part in
                  (self.trees.feature, self.trees.bin, self.trees.value)]
        return {"edges": self.edges, "base": list(self.base), "depth": self.trees.depth, "trees": listed}

    @classmethod
    def from_json(cls, about: dict) -> Boosted:
        return cls(about["edges"], about["base"], Trees(about["depth"], *about["trees"]))


def byte_rows(batch: pa.RecordBatch) -> np.ndarray:
    """``bins`` of a batch, rows x columns, read in place."""
    held = batch.column("bins").cast(pa.large_binary())  # rows of one length, end to end in the value buffer
    ends = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + batch.num_rows + 1]
    return np.frombuffer(held.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(batch.num_rows, -1)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bins, targets, test flags, scores) of a batch."""
    scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    is_test = batch.column("is_test").to_numpy(zero_copy_only=False)
    return byte_rows(batch), batch.column("target").to_numpy(), is_test, scores


def binned_rows(edges: list[list[float]]):
    """Frames with ``bins`` in place of ``values``, the other columns as they are."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                held = binned(np.stack(frame.pop("values").to_numpy()), edges)
                frame.insert(0, "bins", [row.tobytes() for row in held])
                yield frame

    return run


def _prepared(edges: list[list[float]], base: list[float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in binned_rows(edges)(frames):
            yield frame.assign(scores=[list(base)] * len(frame))

    return run


def _renewed(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, _, _, scores = _matrix(batch)
                fresh = pa.array(list(trees.added(bins, scores)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], fresh], ["bins", "target", "is_test", "scores"])

    return run


def _in_task(width: int, *how):
    """All rounds over a table of prepared rows."""
    def train(table: pa.Table) -> dict:
        bins, target, is_test, scores = _matrix(table.to_batches()[0])
        trees, losses = one_task.grow_classes(bins, target, is_test, scores[0].tolist(), *how, width=width)
        return {"trees": [[part.tolist() for part in tree] for tree in trees], "losses": losses}

    return train


def _level_sums(grown: Trees, level: int, classes: int):
    """Gradients of the training rows by (class, node, column, bin); at level 0 also the test loss.

    ``grown`` holds the trees of this round as far as they are; rows in finished leaves are left out.
    """
    first, width = 2**level - 1, 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss, tests = None, 0.0, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            bins, target, is_test, scores = _matrix(batch)
            p = probabilities(scores)
            own = p[np.arange(len(p)), target]
            loss, tests = loss - np.log(np.maximum(own[is_test], 1e-15)).sum(), tests + int(is_test.sum())
            bins, p, target = bins[~is_test], p[~is_test], target[~is_test]
            n_columns = bins.shape[1]
            if sums is None:
                sums = np.zeros((3, classes, width * n_columns * BINS))
            for k in range(classes):
                node = placed(bins, grown.feature[0][k], grown.bin[0][k], level) - first
                here = np.flatnonzero(node >= 0)
                g, h = (p[:, k] - (target == k))[here], (p[:, k] * (1 - p[:, k]))[here]
                for f in range(n_columns):
                    at = (node[here] * n_columns + f) * BINS + bins[here, f]
                    for i, weight in enumerate((g, h, None)):
                        sums[i, k] += np.bincount(at, weight, minlength=sums.shape[2])
        if sums is None:
            return
        k, at = np.nonzero(sums[2])
        n_columns = sums.shape[2] // (width * BINS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(x) for x in (
                    np.append(k, -1).astype(np.int32), np.append(at // (n_columns * BINS) + first, 0).astype(np.int32),
                    np.append(at // BINS % n_columns, 0).astype(np.int32), np.append(at % BINS, 0).astype(np.int32),
                    np.append(sums[0, k, at], loss), np.append(sums[1, k, at], 0.0),
                    np.append(sums[2, k, at], tests).astype(np.int64),
                )
            ],
            ["tree", "node", "feature", "bin", "g", "h", "n"],
        )

    return run


def _splits(sums: DataFrame, least_rows: int) -> DataFrame:
    """Best split of every (tree, node) with the sums left of it, and the sums of the node."""
    cell = Window.partitionBy("tree", "node", "feature")
    left = cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = sums.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    running = total.select(
        "tree", "node", "feature", "bin",
        *[F.sum(c).over(left).alias(f"{c}_left") for c in ("g", "h", "n")],
        *[F.sum(c).over(cell).alias(f"{c}_all") for c in ("g", "h", "n")],
    )
    worth = lambda g, h: g * g / (h + F.lit(DAMPING))
    g_right, h_right = F.col("g_all") - F.col("g_left"), F.col("h_all") - F.col("h_left")
    gain = worth(F.col("g_left"), F.col("h_left")) + worth(g_right, h_right) - worth(F.col("g_all"), F.col("h_all"))
    allowed = (F.col("n_left") >= least_rows) & (F.col("n_all") - F.col("n_left") >= least_rows)
    ranked = F.struct(
        F.when(allowed & (F.col("tree") >= 0), gain).otherwise(-1.0).alias("gain"), (-F.col("feature")).alias("f"),
        (-F.col("bin")).alias("b"), "g_left", "h_left", "g_all", "h_all", "n_all",
    )
    return running.groupBy("tree", "node").agg(F.max(ranked).alias("best")).select("tree", "node", "best.*")


def fit(
    data: DataFrame, columns: list[str], classes: int, rounds: int, learning_rate: float, depth: int,
    least_rows: int, patience: int,
) -> tuple[Boosted, list[float]]:
    """Boost all classes together; returns the model and the test loss before each round.

    ``data`` has the columns without gaps, ``target`` (class number) and ``is_test``. Fitting stops
    after ``patience`` rounds without a lower loss on the test rows, and the rounds after the
    lowest are cut off. Without test rows all rounds are fitted and kept.
    """
    spark = data.sparkSession
    train = data.where("NOT is_test")
    edges = bin_edges(train, columns)
    base = [0.0] * classes
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])

    def written(df: DataFrame) -> DataFrame:
        path = work_path(spark, "boosting")
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = written(
        data.select(values.alias("values"), "target", "is_test").mapInPandas(_prepared(edges, base), ROWS)
    )
    if one_task.fits(rows.count(), len(columns), classes):
        train_all = _in_task(BINS, rounds, learning_rate, depth, least_rows, patience, DAMPING)
        found = one_task.run(rows, train_all)
        parts = [[np.asarray(tree[i]) for tree in found["trees"]] for i in range(3)]
        return Boosted(edges, base, Trees(depth, *parts)), found["losses"]
    trees, losses, old = Trees(depth), [], None
    nodes = 2 ** (depth + 1) - 1

    def level_splits(grown: Trees, level: int) -> list:
        return _splits(rows.mapInArrow(_level_sums(grown, level, classes), SUMS), least_rows).collect()

    for done in range(rounds + 1):
        if done:
            fresh = rows.mapInArrow(_renewed(trees.cut(done - 1, done)), ROWS)
            old, rows = rows, written(fresh) if done % RENEW == 0 else fresh.persist(StorageLevel.MEMORY_AND_DISK)
        feature, cut = np.full((classes, nodes), -1), np.zeros((classes, nodes), dtype=np.int64)
        value = np.zeros((classes, nodes))
        grown = Trees(depth, [feature], [cut], [value])
        for level in range(depth):
            found = level_splits(grown, level)
            if old is not None:
                old, _ = None, old.unpersist()  # the first pass has filled its successor
            tests = [r for r in found if r["tree"] < 0]
            if level == 0 and tests and tests[0]["n_all"]:
                losses.append(tests[0]["g_all"] / tests[0]["n_all"])
                best = int(np.argmin(losses))
                if done == rounds or done - best >= patience:
                    rows.unpersist()
                    return Boosted(edges, base, trees.cut(0, best)), losses
            elif level == 0 and done == rounds:
                rows.unpersist()
                return Boosted(edges, base, trees), losses
            split_any = False
            for r in found:
                k, node = r["tree"], r["node"]
                if k < 0:
                    continue
                step = lambda g, h: -learning_rate * g / (h + DAMPING)
                if level == 0:
                    value[k, 0] = step(r["g_all"], r["h_all"])
                if r["gain"] > 1e-12:
                    split_any = True
                    feature[k, node], cut[k, node] = -r["f"], -r["b"]
                    value[k, 2 * node + 1] = step(r["g_left"], r["h_left"])
                    value[k, 2 * node + 2] = step(r["g_all"] - r["g_left"], r["h_all"] - r["h_left"])
            if not split_any:
                break
        trees.feature.append(feature)
        trees.bin.append(cut)
        trees.value.append(value)
    return Boosted(edges, base, trees), losses
